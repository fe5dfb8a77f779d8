"""The registry of this subpackage: query name -> callable, and the SQL that checks it."""

from __future__ import annotations

from .q_lm import op8_lm_scoring
from .q_media import op10_media_columns
from .q_neardup import OP3_SQL, op3_minhash_near_dedup
from .q_packing import op1_best_fit_packing
from .q_pieces import op2_sentencepiece
from .q_quality import op4_quality_rules
from .q_tokens import op5_token_counts
from .q_toxicity import op6_toxicity
from .q_urls import OP9_SQL, op9_url_filter
from .q_warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filter": op9_url_filter,
    "op10_media_columns": op10_media_columns,
}
# The others learn models, draw at random, call tokenizers or encode files; tests hold them
# against brute force instead.
ORACLES = {"op3_minhash_near_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op9_url_filter": OP9_SQL}
