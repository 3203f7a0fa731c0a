"""Engine parameters.

Fixed values: these must equal the behaviour being reproduced, so they are
stated here together and in plain form.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------
CHUNK_SIZE = 1024
CHUNK_OVERLAP = 256
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SUMMARY_SEPARATORS = ("\n\n", "\n")
MAX_CHUNKS = 100_000
MAX_BYTES = 40_000
BYTES_OVERHEAD = 33  # interpreter object header counted with the payload
UPSERT_BATCH = 50
ENCODE_BATCH = 32
TOP_K = 10
RERANK_TOP_N = 10
SCORE_THRESHOLD = 0.5
TOKEN_BUDGET = 5_120
MEMORY_TURNS = 5
CONTEXTS_SHOWN = 6
HIST_BINS = 20
EMBED_DIM = 768
QA_MAX_LENGTH = 512
QA_TEST_SHARE = 0.2
GAZETTE_ROOT = "https://www.boe.es"
CLASS_LETTERS = ("A", "C")
CLASS_CHAR_INDEX = 27  # 0-based position of the class letter in an item url
COURT_ROOT = "https://www.poderjudicial.es"
SPANISH_MONTHS = (
    ("enero", "01"), ("febrero", "02"), ("marzo", "03"), ("abril", "04"),
    ("mayo", "05"), ("junio", "06"), ("julio", "07"), ("agosto", "08"),
    ("septiembre", "09"), ("octubre", "10"), ("noviembre", "11"),
    ("diciembre", "12"),
)
SUMMARY_LABELS = (
    "Fecha de ejecución",
    "Documentos encontrados",
    "Número de tokens usados",
)
REPORT_FIELDS = ("Fecha", "Título", "URL", "Puntuación")
# BM25 constants of the default pair scorer
BM25_K1 = 1.2
BM25_B = 0.75
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    separators: tuple[str, ...] = CHUNK_SEPARATORS
    # None: no cap; MAX_CHUNKS is the value to pass where the cap is wanted
    max_chunks: int | None = None
    max_bytes: int = MAX_BYTES
    upsert_batch: int = UPSERT_BATCH
    top_k: int = TOP_K
    rerank_top_n: int = RERANK_TOP_N
    score_threshold: float = SCORE_THRESHOLD
    token_budget: int = TOKEN_BUDGET
    memory_turns: int = MEMORY_TURNS
    contexts_shown: int = CONTEXTS_SHOWN
    hist_bins: int = HIST_BINS
    keywords: tuple[str, ...] = field(default_factory=tuple)
    full_extraction: bool = True
    class_letters: tuple[str, ...] = CLASS_LETTERS
    # Exact top-k: largest query matrix (n x dim x 8 bytes, scored in double)
    # shipped to every executor as a broadcast variable; larger query sets
    # are split into blocks that are co-grouped with vector blocks instead.
    query_block_bytes: int = 64 * 1024 * 1024
    # Memory budget of one scoring group in the exact block strategy. The
    # shuffle of that strategy is V*NQ + Q*NV bytes; for a fixed budget it
    # is smallest when queries and vectors each get half of it.
    block_group_bytes: int = 512 * 1024 * 1024
    # Target bytes of vectors per sub-block in the approximate strategy.
    vector_block_bytes: int = 128 * 1024 * 1024
