"""Sizes, thresholds and limits that decide results."""

# passages
TARGET_CHARS = 900
MAX_CHARS = 1600
WINDOW_CHARS = 2000
TABLE_MARKER = "[TABLE]"

# uploads
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
ALLOWED_SUFFIXES = (".pdf", ".htm", ".html", ".xhtml")

# retrieval
CANDIDATE_POOL = 25
RERANK_CANDIDATES = 50
CONTEXT_PASSAGES = 8
ANCHOR_SLOTS = 3
SECTION_SLOTS = 4
RRF_K = 60
RELEVANCE_THRESHOLD = -2.0
ESCALATE_ABOVE = -3.0
ESCALATE_BELOW = -1.0
ESCALATION_FACTOR = 2
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
MIN_IDF = 1e-4

# structure
STATEMENT_THRESHOLD = 0.6
MAX_LABEL_OFFSET = 40
MIN_AGREEING_PAGES = 3
TOC_ITEM_COUNT = 4

# verification
RECONSTRUCT_REL = 0.003
RECONSTRUCT_ABS = 0.015

# answers
EXCERPT_CHARS = 240
CONSIDERED = 3
TOKEN_SET_MATCH = 55.0
