"""The operators' queries and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from candlework.llm.ann import op8_nearest_neighbours
from candlework.llm.chat import OP10_SQL, op10_chat_formatting
from candlework.llm.collocations import OP11_SQL, op11_phrase_collocations
from candlework.llm.licenses import OP13_SQL, op13_license_scans
from candlework.llm.mixing import op4_mixing
from candlework.llm.packing import op1_best_fit_packing
from candlework.llm.quality import op3_quality_rules
from candlework.llm.simhash import op2_simhash_near_dedup
from candlework.llm.spelling import OP12_SQL, op12_spelling_variants
from candlework.llm.suffix import op7_suffix_array_dedup
from candlework.llm.token_counts import op5_token_counts
from candlework.llm.token_files import op6_token_files
from candlework.llm.urls import op9_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_simhash_near_dedup,
        op3_quality_rules,
        op4_mixing,
        op5_token_counts,
        op6_token_files,
        op7_suffix_array_dedup,
        op8_nearest_neighbours,
        op9_url_filters,
        op10_chat_formatting,
        op11_phrase_collocations,
        op12_spelling_variants,
        op13_license_scans,
    )
}
ORACLE_SQL = {"op10_chat_formatting": OP10_SQL, "op11_phrase_collocations": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_license_scans": OP13_SQL}
