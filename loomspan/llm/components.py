"""Connected components, with the column names that the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomspan.operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, any order);
    root is the component's smallest node."""
    return components(edges, "a", "b").withColumnRenamed("component", "root")
