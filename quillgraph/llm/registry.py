"""The corpus queries and their SQL twins."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .fingerprint import op2_fingerprint
from .lm_score import op5_lm_score
from .mixing import op4_mixing
from .ngram_join import OP10_SQL, op10_ngram_jaccard
from .pii import op8_pii
from .quality import op7_quality
from .secret_scan import op1_secret_scan
from .url_filter import OP3_SQL, op3_url_filter
from .warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_fingerprint": op2_fingerprint,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_lm_score": op5_lm_score,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op6_warc": OP6_SQL, "op10_ngram_jaccard": OP10_SQL}
