"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bilinear import op11_bilinear
from .decontaminate import op1_decontaminate
from .divergence import ORACLE_SQL as OP13_SQL
from .divergence import op13_divergence
from .jaccard_join import op10_jaccard_join
from .langmix import op5_langmix
from .line_templates import ORACLE_SQL as OP6_SQL
from .line_templates import op6_line_templates
from .media import op4_media
from .packing import op8_packing
from .suffix_dedup import op9_suffix_dedup
from .token_store import op7_token_store
from .toxicity import op3_toxicity
from .url_rules import op2_url_rules
from .whitening import op12_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_rules": op2_url_rules,
    "op3_toxicity": op3_toxicity,
    "op4_media": op4_media,
    "op5_langmix": op5_langmix,
    "op6_line_templates": op6_line_templates,
    "op7_token_store": op7_token_store,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_bilinear": op11_bilinear,
    "op12_whitening": op12_whitening,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op6_line_templates": OP6_SQL, "op13_divergence": OP13_SQL}
