"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .chaining import op4_collinear_chains
from .clean_lines import OP6_SQL, op6_line_rules
from .decontaminate import op5_cgk_decontamination
from .packing import op10_best_fit_packing
from .pii import op9_weak_pii
from .quality import op2_subword_quality
from .simhash import op7_simhash_bk
from .suffix_dedup import OP3_SQL, op3_suffix_array
from .tool_calls import OP1_SQL, op1_tool_calls
from .urls import op8_url_language_model

QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_subword_quality": op2_subword_quality,
    "op3_suffix_array": op3_suffix_array,
    "op4_collinear_chains": op4_collinear_chains,
    "op5_cgk_decontamination": op5_cgk_decontamination,
    "op6_line_rules": op6_line_rules,
    "op7_simhash_bk": op7_simhash_bk,
    "op8_url_language_model": op8_url_language_model,
    "op9_weak_pii": op9_weak_pii,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE = {"op1_tool_calls": OP1_SQL, "op3_suffix_array": OP3_SQL, "op6_line_rules": OP6_SQL}
