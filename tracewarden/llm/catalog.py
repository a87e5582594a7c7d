"""The operators' queries by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import fill_in_middle, grid_join, jaccard_join, periodic_runs, suffix_arrays, super_kmers
from tracewarden.llm.language_id import op10_language_id
from tracewarden.llm.mixing import op1_pivotal_mixing
from tracewarden.llm.outliers import op8_robust_outliers
from tracewarden.llm.packing import op4_bin_slack_packing
from tracewarden.llm.quality_ranking import op6_quality_ranking
from tracewarden.llm.toxicity import op13_toxicity
from tracewarden.llm.warc_zip import op3_warc_zip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivotal_mixing": op1_pivotal_mixing,
    "op2_grid_order_join": grid_join.op2_grid_order_join,
    "op3_warc_zip": op3_warc_zip,
    "op4_bin_slack_packing": op4_bin_slack_packing,
    "op5_super_kmers": super_kmers.op5_super_kmers,
    "op6_quality_ranking": op6_quality_ranking,
    "op7_suffix_arrays": suffix_arrays.op7_suffix_arrays,
    "op8_robust_outliers": op8_robust_outliers,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_toxicity": op13_toxicity,
}

STATEMENTS: dict[str, str] = {
    "op2_grid_order_join": grid_join.ORACLE,
    "op5_super_kmers": super_kmers.ORACLE,
    "op7_suffix_arrays": suffix_arrays.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
