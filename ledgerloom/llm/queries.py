"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .content_sort import OP7_SQL, op7_content_sort
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard_join import op10_jaccard_join
from .mixing import op2_pfair_mixing
from .packing import op3_best_fit_packing
from .repetition import op4_suffix_repetition
from .secrets import op9_secret_scan
from .suffix_dedup import op8_suffix_dedup
from .token_counts import op5_token_counts
from .token_files import op1_token_files
from .toxicity import op6_toxicity
from .whitening import op12_whitening

REGISTRY = {q.__name__: q for q in (
    op1_token_files, op2_pfair_mixing, op3_best_fit_packing, op4_suffix_repetition, op5_token_counts, op6_toxicity,
    op7_content_sort, op8_suffix_dedup, op9_secret_scan, op10_jaccard_join,
    op11_byte_bpe, op12_whitening, op13_hard_negatives)}

ORACLES = {"op7_content_sort": OP7_SQL, "op13_hard_negatives": OP13_SQL}
