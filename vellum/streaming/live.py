"""Filters and projections on streaming DataFrames: the compiled columns are the same as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.projection import project
from ..plans.filters import compile_filter


def live_find(stream: DataFrame, spec: dict | None = None, projection: dict | None = None) -> DataFrame:
    return project(stream.filter(compile_filter(spec, stream.schema)), projection)
