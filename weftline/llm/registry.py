"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op6_bpe
from .language_id import op2_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .merkle import op3_fingerprints
from .neighbours import op5_neighbours
from .packing import op1_packing
from .sharding import op8_sharding
from .simhash import op4_simhash
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .suffix_dedup import OP10_SQL, op10_suffix_dedup

QUERIES = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_simhash": op4_simhash,
    "op5_neighbours": op5_neighbours,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = {
    "op7_line_dedup": OP7_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_suffix_dedup": OP10_SQL,
}
