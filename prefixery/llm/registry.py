"""Queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .burst_trie import op12_burst_trie
from .byte_ctw import op8_byte_ctw
from .decontaminate import op7_decontaminate
from .jaccard_join import OP5_SQL, op5_jaccard_join, op5_jaccard_links
from .license_scan import op10_license_scan
from .quality_classifier import op1_quality_classifier
from .quality_rules import op2_quality_rules
from .secret_scan import op6_secret_scan
from .source_mixing import op3_source_mixing
from .superminhash import op11_superminhash
from .token_attribution import op9_token_attribution
from .token_blocks import op4_token_blocks
from .whitening import op13_whitening

QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_quality_rules, op3_source_mixing, op4_token_blocks, op5_jaccard_join, op5_jaccard_links,
    op6_secret_scan, op7_decontaminate, op8_byte_ctw, op9_token_attribution, op10_license_scan,
    op11_superminhash, op12_burst_trie, op13_whitening)}
ORACLES = {"op5_jaccard_join": OP5_SQL}
