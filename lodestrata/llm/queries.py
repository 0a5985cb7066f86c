"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .decontaminate import op7_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .importance import OP12_SQL, op12_importance
from .language import op3_language
from .license_scan import op11_license_scan
from .line_dedup import op1_line_dedup
from .media import op4_media_columns
from .near_dup import OP5_SQL, op5_minhash_near_dup
from .packing import op8_best_fit_packing
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .token_store import op6_token_output
from .toxicity import op2_toxicity
from .url_filter import op10_url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_language": op3_language,
        "op4_media_columns": op4_media_columns,
        "op5_minhash_near_dup": op5_minhash_near_dup,
        "op6_token_output": op6_token_output,
        "op7_decontamination": op7_decontamination,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_license_scan": op11_license_scan,
        "op12_importance": op12_importance,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dup": OP5_SQL, "op9_substring_dedup": OP9_SQL, "op12_importance": OP12_SQL, "op13_source_divergence": OP13_SQL}
