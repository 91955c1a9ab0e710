"""Fixed values of the engine: they decide results, so they are stated here as they must be."""

from __future__ import annotations

EMBED_DIM = 512
EMBEDDER_ID = "hash-v1-d512"
RRF_K = 60.0
STRATEGY_TOP_K = 40
FUSED_TOP_K = 30
HIGH_VECTOR = 0.45
STALE_DAYS = 45
AUTHORITY_WEIGHT = 0.08
#: (amplitude, decay in days) of the recency prior, for temporal questions and others.
RECENCY_TEMPORAL, RECENCY_BASE = (0.25, 30.0), (0.02, 90.0)
EXCLUDED_DIRS = ("test", "attachments", ".raw")
BOOSTED_DIRS, BOOST = ("originals", "concepts", "writing"), 1.3
DEMOTED_DIRS = {"chat": 0.6, "daily": 0.6, "media": 0.7, "archive": 0.5}
TEMPORAL_DIRS = ("chat", "daily")
DF_GATE = 0.6
MIN_PREFIX = 3
MAX_QUERY_WORDS = 24
COST_STEM, COST_TYPO = 1, 2
FARTHEST = 8
ADJACENT_BOOST, INJECT, HOP_DECAY = 1.15, 0.5, 0.6
HUB_EDGES, MAX_INJECTED = 64, 32
ALIAS_BOOST, TITLE_BOOST = 1.6, 1.4
SNIPPET_BYTES = 320
CHUNK_TARGET, CHUNK_MAX = 1200, 2000
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_UNKNOWN = 3
#: (token budget, hops, results) by mode.
MODES = {"conservative": (2000, 1, 5), "balanced": (6000, 1, 10), "tokenmax": (16000, 2, 20)}
#: (lexical, vector) by intent.
STRATEGY_WEIGHTS = {"entity": (1.2, 1.0), "event": (1.2, 1.0), "temporal": (1.0, 1.0), "general": (1.0, 1.1)}
STEM_RULES = (("ies", "y"), ("sses", "ss"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("es", ""), ("s", ""))
SENTENCE_LEADERS = ("The", "A", "An", "Should", "What", "When", "Who", "Whom", "How", "Why", "Is", "Are", "Will", "Can", "Could", "Does", "Do", "Did")
VALID_TYPES = ("note", "session", "group", "person", "place", "venue", "event", "organization", "company", "product", "contact")

# Patterns that decide intents, edge types and links; \b and \w are Unicode-aware where they are used.
ENTITY_LEAD = r"^(who is|who works|who's|where does|what does .{1,40} do|tell me about)\b"
TEMPORAL = (
    r"\b(yesterday|today|tomorrow|tonight|last (week|month|year|night)|this (week|month|year|quarter)|recent(ly)?|\d+ (days?|weeks?|months?) ago"
    r"|since (19|20)\d\d|in (19|20)\d\d|january|february|march|april|may|june|july|august|september|october|november|december|\d{4}-\d{2}-\d{2})\b"
)
EVENT = r"\b(meeting|conference|launch(ed)?|demo day|series [a-d]\b|funding round|summit|hackathon|keynote|offsite)\b"
HEDGES = (
    r"\b(not|never|considered|considering|consider|might|may|maybe|plans? to|planning|wants? to|hopes? to|almost|declined"
    r"|won't|wouldn't|didn't|doesn't|hasn't|isn't|wasn't|denies|denied|rumored)\b"
)
EDGE_RULES = (
    ("founded", r"\b(co-?founded|founded|founder of|started the company)\b"),
    ("invested_in", r"\b(invested in|investor in|backed|led .{0,24}(seed|series [a-d]))\b"),
    ("works_at", r"\b(works? at|working at|joined|employed (at|by)|(ceo|cto|cfo|vp|head of \w+) (of|at)|runs \w+ at)\b"),
    ("advises", r"\b(advis(es|or|ing)|mentors?)\b"),
    ("attended", r"\b(attended|spoke at|presented at|went to|met\b.{0,60}\b(at|during))\b"),
)
MD_LINK = r"\[([^\]]+)\]\(([^)\s]+)\)"
MD_LINK_ANGLE = r"\[([^\]]+)\]\(<([^>]+)>\)"
WIKILINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
TYPED_QUOTE = r"^>\s*\*\*([a-z][a-z_]*):?\*\*[^\n]*?\[([^\]]*)\]\(<?([^)>\s]+)>?\)"


def knobs(mode: str, intent: str) -> tuple[int, int, int]:
    """(token budget, hops, results); questions about an entity look two hops far."""
    if mode not in MODES:
        raise ValueError(f"unknown mode `{mode}` ({'|'.join(MODES)})")
    budget, hops, results = MODES[mode]
    return budget, max(hops, 2) if intent == "entity" else hops, results
