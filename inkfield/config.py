"""Default parameters (fixed values that results depend on)."""

CHUNK_SIZE = 1200
CHUNK_OVERLAP = 120
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
EMBED_MAX_CHARS = 1800
EMBED_BATCH_ROWS = 32
CONTEXT_MAX_CHARS = 8000
QUERY_PROMPT = "Represent this sentence for searching relevant passages: "

IVF_LISTS = 256
IVF_PROBES = 16
PQ_SUBSPACES = 64
PQ_BITS = 8

SEARCH_K = 3
BENCH_K = 5
MAX_REVISIONS = 2

SEGMENT_CHARS = 400
SEGMENT_CHARS_MIN = 64
SEGMENT_SOFT_CHARS = 24
SEGMENT_SOFT_CHARS_MIN = 8
SEGMENT_SEPARATORS = (". ", "! ", "? ", ".\n", "!\n", "?\n", ".\t", "!\t", "?\t")

KEYWORD_MAX_CHARS = 256
DOCUMENT_SUFFIXES = ("txt", "pdf", "docx")
TEXT_ENCODINGS = ("utf-8", "cp1252", "latin-1", "ascii")
ROLES = ("user", "assistant")
