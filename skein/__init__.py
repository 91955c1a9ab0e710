"""skein: hybrid retrieval over document corpora, expressed as Spark DataFrames."""
