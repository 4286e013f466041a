"""The queries of this package by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from .caps import OP1_SQL, op1_embedding_near_dedup
from .chat import OP5_SQL, op5_chat_format
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .langid import op10_language_id
from .minhash import OP9_SQL, op9_ngram_jaccard_join
from .mixing import OP6_SQL, op6_mixing
from .packing import op7_packing
from .paragraphs import op8_substring_dedup
from .sharding import op4_sharding
from .suffixes import OP2_SQL, op2_suffix_array_dedup

QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_suffix_array_dedup, op3_exact_dedup, op4_sharding, op5_chat_format, op6_mixing, op7_packing, op8_substring_dedup, op9_ngram_jaccard_join, op10_language_id)}
SQL = {"op1_embedding_near_dedup": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_mixing": OP6_SQL, "op9_ngram_jaccard_join": OP9_SQL}
