"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op4_ivfpq
from .bpe import op6_bpe
from .embedding_dedup import OP8_SQL, op8_epsilon_grid
from .line_dedup import op5_line_chunks
from .mixing import op10_mixing
from .pii import op9_pii
from .simhash import op1_simhash
from .suffix_dedup import OP3_SQL, op3_suffix
from .toxicity import op2_toxicity
from .warc import OP7_SQL, op7_revisits

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_suffix": op3_suffix,
    "op4_ivfpq": op4_ivfpq,
    "op5_line_chunks": op5_line_chunks,
    "op6_bpe": op6_bpe,
    "op7_revisits": op7_revisits,
    "op8_epsilon_grid": op8_epsilon_grid,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_suffix": OP3_SQL, "op7_revisits": OP7_SQL, "op8_epsilon_grid": OP8_SQL}
