"""Connected components whose tables are scratch tables of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of longs, as operators.graph.components gives it; its tables go with clear_scratch()."""
    return graph.components(edges, lambda df: materialize(df, "labels"))
