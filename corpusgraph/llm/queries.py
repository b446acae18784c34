"""Queries of the operators over the driver's tables; SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP5_SQL, op5_benchmark_containment
from .divergence import OP11_SQL, op11_source_divergence
from .fingerprints import op6_multiset_fingerprints
from .language_id import op12_language_id
from .licenses import OP2_SQL, op2_license_templates
from .near_dedup import OP7_SQL, op7_near_duplicates
from .packing import op8_best_fit_packing
from .quality import op4_quality_classifier
from .ranked_search import OP13_SQL, op13_ranked_search
from .sharding import op1_hilbert_sharding
from .token_counts import op3_token_counts
from .toxicity import op9_toxicity
from .url_templates import OP10_SQL, op10_url_templates


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_sharding": op1_hilbert_sharding,
        "op2_license_templates": op2_license_templates,
        "op3_token_counts": op3_token_counts,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_containment": op5_benchmark_containment,
        "op6_multiset_fingerprints": op6_multiset_fingerprints,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_toxicity": op9_toxicity,
        "op10_url_templates": op10_url_templates,
        "op11_source_divergence": op11_source_divergence,
        "op12_language_id": op12_language_id,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_templates": OP2_SQL, "op5_benchmark_containment": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op10_url_templates": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_ranked_search": OP13_SQL}
