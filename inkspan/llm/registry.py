"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from .exact_dedup import OP8_SQL, op8_exact_dedup
from .hamerly import OP11_SQL, op11_hamerly
from .language_id import op6_language
from .line_dedup import OP12_SQL, op12_line_dedup
from .packing import op3_packing
from .pii import op10_pii
from .quality import op9_quality
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op2_simhash
from .suffix_dedup import op7_suffix_dedup
from .warc import OP5_SQL, op5_warc_revisits
from .weighted_sampling import op4_weighted_sampling
from .whitening import op13_whitening

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_weighted_sampling": op4_weighted_sampling,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_language": op6_language,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_pii": op10_pii,
    "op11_hamerly": op11_hamerly,
    "op12_line_dedup": op12_line_dedup,
    "op13_whitening": op13_whitening,
}
SQL = {"op5_warc_revisits": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op11_hamerly": OP11_SQL, "op12_line_dedup": OP12_SQL}
