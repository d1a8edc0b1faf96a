"""Queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from .bpe import op5
from .exact_dedup import SQL6, op6
from .fingerprints import op9
from .html_text import op1
from .language_id import op10
from .minhash_dedup import SQL7, op7
from .mixing import op2
from .periodic_runs import op12
from .secret_scan import SQL3, op3
from .sharding import op11
from .spelling import op13
from .suffix_dedup import SQL8, op8
from .url_filter import op4


def queries() -> dict:
    return {
        "op1_html_text": op1, "op2_mixing": op2, "op3_secret_scan": op3, "op4_url_filter": op4, "op5_bpe": op5, "op6_exact_dedup": op6, "op7_minhash_dedup": op7,
        "op8_suffix_dedup": op8, "op9_fingerprints": op9, "op10_language_id": op10, "op11_sharding": op11, "op12_periodic_runs": op12, "op13_spelling": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": SQL3, "op6_exact_dedup": SQL6, "op7_minhash_dedup": SQL7, "op8_suffix_dedup": SQL8}
