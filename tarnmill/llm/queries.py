"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann_search import op6_nearest
from .byte_bpe import op10_byte_bpe
from .jaccard_join import ORACLE as JACCARD_SQL
from .jaccard_join import op1_jaccard
from .packing import op8_packing
from .secret_scan import op9_secrets
from .substring_dedup import ORACLE as SUBSTRING_SQL
from .substring_dedup import op7_substring
from .token_counts import op3_token_counts
from .topk_search import ORACLE as TOPK_SQL
from .topk_search import op2_exact_topk
from .toxicity import op4_toxicity
from .url_filter import op5_url_filter

QUERIES = {f.__name__: f for f in (op1_jaccard, op2_exact_topk, op3_token_counts, op4_toxicity, op5_url_filter, op6_nearest, op7_substring, op8_packing, op9_secrets, op10_byte_bpe)}

ORACLES: dict[str, str] = {"op1_jaccard": JACCARD_SQL, "op2_exact_topk": TOPK_SQL, "op7_substring": SUBSTRING_SQL}
