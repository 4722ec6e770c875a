"""The registered queries of this folder, and their SQL where SQL can state them."""

from __future__ import annotations

from . import op01_secrets, op02_line_dedup, op03_chat_format, op06_jaccard_join, op11_repair
from . import op13_vector_codes as vector_codes
from .op01_secrets import op1_secrets
from .op02_line_dedup import op2_line_dedup
from .op03_chat_format import op3_chat_format
from .op04_packing import op4_packing
from .op05_token_counts import op5_token_counts
from .op06_jaccard_join import op6_jaccard_join
from .op07_neighbours import op7_nearest
from .op08_pii import op8_pii
from .op09_toxicity import op9_toxicity
from .op10_decontaminate import op10_decontamination
from .op11_repair import op11_conversation_repair
from .op12_mixing import op12_mixing
from .op13_vector_codes import op13_vector_codes

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_nearest": op7_nearest,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_mixing": op12_mixing,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secrets": op01_secrets.SQL,
    "op2_line_dedup": op02_line_dedup.SQL,
    "op3_chat_format": op03_chat_format.SQL,
    "op6_jaccard_join": op06_jaccard_join.SQL,
    "op11_conversation_repair": op11_repair.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
