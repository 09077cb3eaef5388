"""Queries of the training-data operators, over the whole tables that the driver names, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .best_fit import op11_best_fit_packing
from .jaccard import op2_jaccard_join
from .line_runs import OP1_SQL, op1_line_runs
from .mixing import op10_flow_mix
from .negatives import OP12_SQL, op12_split_point_tree
from .packing import op7_nnls_packing
from .repair import op13_run_length_repair
from .secrets import op5_linked_secrets
from .sharding import op4_feistel_shards
from .toxicity import op3_toxic_segments
from .unit_dedup import op9_repeated_units
from .vectors import op6_collision_neighbours, op8_rotated_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_runs": op1_line_runs,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_feistel_shards": op4_feistel_shards,
    "op5_linked_secrets": op5_linked_secrets,
    "op6_collision_neighbours": op6_collision_neighbours,
    "op7_nnls_packing": op7_nnls_packing,
    "op8_rotated_codes": op8_rotated_codes,
    "op9_repeated_units": op9_repeated_units,
    "op10_flow_mix": op10_flow_mix,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_split_point_tree": op12_split_point_tree,
    "op13_run_length_repair": op13_run_length_repair,
}

ORACLES: dict[str, str] = {
    "op1_line_runs": OP1_SQL,
    "op12_split_point_tree": OP12_SQL,
}
