"""The queries of the subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .codes import op12_vector_codes
from .decontam import op9_template_decontamination
from .langid import op10_language_id
from .licenses import op11_license_templates
from .neardup import op8_minhash_neardup
from .neighbours import op1_vantage_point_search
from .packing import op2_best_fit_packing
from .secrets import op4_secret_scan
from .substring import op7_substring_dedup
from .toolcalls import OP3_SQL, op3_tool_call_linking
from .urlfilter import op6_link_trust_filter
from .variants import op13_spelling_variants
from .warc import op5_arc_to_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_vantage_point_search, op2_best_fit_packing, op3_tool_call_linking, op4_secret_scan, op5_arc_to_warc, op6_link_trust_filter,
        op7_substring_dedup, op8_minhash_neardup, op9_template_decontamination, op10_language_id, op11_license_templates, op12_vector_codes, op13_spelling_variants,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_tool_call_linking": OP3_SQL, "op5_arc_to_warc": sql.OP5, "op6_link_trust_filter": sql.OP6,
        "op7_substring_dedup": sql.OP7, "op8_minhash_neardup": sql.OP8, "op9_template_decontamination": sql.op9(),
        "op11_license_templates": sql.op11(), "op12_vector_codes": sql.op12(), "op13_spelling_variants": sql.OP13,
    }
