"""Settings and the numeric constants of the retrieval semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

# Changing any of these changes results.
CHUNK_TOKENS = 900
CHUNK_OVERLAP = 0.15
BYTES_PER_TOKEN = 4
BREAK_WINDOW_TOKENS = 200
VECTOR_SEARCH_MIN_SCORE = 0.3
NO_MIN_SCORE = -2.0
SEARCH_LIMIT = 20
QUERY_LIMIT = 10
CANDIDATE_LIMIT = 40
BACKEND_LIMIT = 20
RRF_K = 60.0
COLLECTION_CANDIDATE_FACTOR = 10
VECTOR_OVERFETCH = 3
FIELD_WEIGHTS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
ENTRY_WEIGHTS = {"id": 1.0, "content": 1.0, "tags": 1.0, "article_path": 1.0}
CHUNK_WEIGHTS = {"heading": 1.0, "content": 1.0}
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
ORIGINAL_WEIGHT = 2.0
EXPANSION_WEIGHT = 1.0
SNIPPET_CHARS = 180
EMBED_SEGMENT_CHARS = 5000

# A frame is broadcast only when its row count has a bound no larger than this.
BROADCAST_MAX_ROWS = 200_000


@dataclass(frozen=True)
class Settings:
    """Options of a corpus store. Non-positive chunk values mean the default."""

    chunk_tokens: int = CHUNK_TOKENS
    chunk_overlap: float = CHUNK_OVERLAP
    stemmer: str = "porter"
    metric: str = "l2"
    uri_scheme: str = "doc"
    default_pattern: str = "**/*.md"
    docs_per_shard: int = 2_000_000
    rows_per_posting_file: int = 50_000_000
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.chunk_tokens <= 0:
            object.__setattr__(self, "chunk_tokens", CHUNK_TOKENS)
        if self.chunk_overlap <= 0:
            object.__setattr__(self, "chunk_overlap", CHUNK_OVERLAP)
        if self.stemmer not in ("porter", "none"):
            raise ValueError(f"unknown stemmer {self.stemmer!r}")
        if self.metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {self.metric!r}")
