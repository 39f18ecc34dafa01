"""Registry of the text queries and of the SQL that checks them."""

from __future__ import annotations

from boxquery.llm import decontam, filter_audit, importance, line_dedup, mixing, quality_rules, substrings, warc
from boxquery.llm.decontam import op6_decontaminate
from boxquery.llm.filter_audit import op12_filter_audit
from boxquery.llm.importance import op11_importance_resampling
from boxquery.llm.line_dedup import op8_line_dedup
from boxquery.llm.mixing import op2_mix_sources
from boxquery.llm.near_dedup import op7_near_dedup
from boxquery.llm.packing import op13_best_fit_packing
from boxquery.llm.quality_model import op9_quality_classifier
from boxquery.llm.quality_rules import op10_host_rules
from boxquery.llm.repeats import op1_remove_repeats
from boxquery.llm.substrings import op5_substring_dedup
from boxquery.llm.token_counts import op4_token_counts
from boxquery.llm.warc import op3_warc_round_trip

QUERIES = {f.__name__: f for f in (op1_remove_repeats, op2_mix_sources, op3_warc_round_trip, op4_token_counts, op5_substring_dedup, op6_decontaminate, op7_near_dedup, op8_line_dedup, op9_quality_classifier, op10_host_rules, op11_importance_resampling, op12_filter_audit, op13_best_fit_packing)}
ORACLE_SQL = {"op2_mix_sources": mixing.ORACLE_SQL, "op3_warc_round_trip": warc.ORACLE_SQL, "op5_substring_dedup": substrings.ORACLE_SQL, "op6_decontaminate": decontam.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op10_host_rules": quality_rules.ORACLE_SQL, "op11_importance_resampling": importance.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
