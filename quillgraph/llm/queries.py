"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe_codec import op5_bpe_codec
from .centroid_clusters import OP13_SQL, op13_centroid_clusters
from .decontamination import op4_decontamination
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .near_dedup import op1_near_dedup
from .packing import op12_packing
from .quality_crf import op7_quality_crf
from .quality_rules import OP6_SQL, op6_quality_rules
from .sharding import op8_sharding
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .token_counts import op2_token_counts
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_crf": op7_quality_crf,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_packing": op12_packing,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
