"""A collection: a DataFrame with the query language of a document database.

Everything returns a DataFrame (or a number, where the name says so); Catalyst plans it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import DuplicateKeyError, EngineError
from .functions.compare import negate
from .functions.ids import object_id
from .operators import updates
from .operators.pipeline import Pipeline, _ordered, sort_columns
from .operators.projection import id_of, project
from .plans.filters import check, compile_filter


class PreparedFilter:
    """A filter that is checked once and reused."""

    def __init__(self, spec: dict):
        import copy

        self.spec = copy.deepcopy(spec)
        check(self.spec)

    def __call__(self, schema):
        return compile_filter(self.spec, schema)


class Collection:
    """Documents of one schema. id_col: the key, where there is one; it orders what has no other order."""

    def __init__(self, df: DataFrame, id_col: str | None = None):
        self.df, self.id_col = df, id_col

    def where(self, spec) -> DataFrame:
        return self.df.filter(spec(self.df.schema) if isinstance(spec, PreparedFilter) else compile_filter(spec, self.df.schema))

    def find(self, spec=None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
        """limit <= 0: all rows."""
        df = self.where(spec)
        ties = [F.col(self.id_col).asc_nulls_first()] if self.id_col and (sort or skip or limit > 0) else []
        if sort or ties:
            df = df.orderBy(*_ordered(sort_columns(df, sort or {})), *ties)
        if skip > 0:
            df = df.offset(skip)
        if limit > 0:
            df = df.limit(limit)
        return project(df, *id_of(df.schema, projection, (self.id_col,) if self.id_col else ()))

    def find_one(self, spec=None, projection: dict | None = None, sort: dict | None = None) -> DataFrame:
        return self.find(spec, projection, sort, limit=1)

    def find_by_id(self, key) -> DataFrame:
        return self.where({self.id_col: key}).limit(1)

    def read_by_id(self, key, reader: Callable):
        """What reader makes of the row with that key; None where there is none."""
        row = self.find_by_id(key).first()
        return None if row is None else reader(row)

    def count(self, spec=None) -> int:
        return self.where(spec).count()

    def counted(self, spec=None, name: str = "n") -> DataFrame:
        """The number of matching documents as one row."""
        return self.where(spec).agg(F.count(F.lit(1)).alias(name))

    def visit(self, spec, visitor: Callable) -> int:
        """Calls visitor with rows, by key, until it returns False; the number of calls."""
        n = 0
        for row in self.find(spec, sort={self.id_col: 1} if self.id_col else None).toLocalIterator():
            n += 1
            if visitor(row) is False:
                break
        return n

    def explain(self, spec=None) -> str:
        """Catalyst's plan of a filter: what is pushed to the scan and what is read."""
        return self.where(spec)._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def aggregate(self, stages: list[dict]) -> DataFrame:
        return Pipeline(stages).run(self.df, (self.id_col,) if self.id_col else ())

    def _first(self, matches):
        """matches, but only of the matching row with the smallest key."""
        if not self.id_col:
            raise EngineError("one document can only be told from others by a key")
        first = self.df.filter(matches).agg(F.min(self.id_col)).first()[0]
        return matches & F.coalesce(F.col(self.id_col) == F.lit(first), F.lit(False))

    def update(self, spec, update: dict, upsert: bool = False, one: bool = False) -> Collection:
        """The collection after update_many (or update_one / replace_one: the smallest key first)."""
        operators = updates.validate(update, self.id_col or "_id")
        matches = compile_filter(spec, self.df.schema)
        matches = self._first(matches) if one or not operators else matches
        df = updates.apply(self.df, matches, update) if operators else updates.replace(self.df, matches, update, self.id_col or "_id")
        if upsert:
            df = df.unionByName(updates.upsert(self.df, spec, update, self.id_col or "_id"), allowMissingColumns=True)
        return Collection(df, self.id_col)

    def update_result(self, spec, update: dict, upsert: bool = False, one: bool = False) -> DataFrame:
        """One row of what update() would do: matched, modified and inserted (1 for an upsert) documents."""
        operators = updates.validate(update, self.id_col or "_id")
        matches = compile_filter(spec, self.df.schema)
        matches = self._first(matches) if one or not operators else matches
        found = updates.outcome(self.df, matches, update, self.id_col or "_id")
        return found.withColumn("inserted", (F.lit(upsert) & (F.col("matched") == 0)).cast("long"))

    def delete_result(self, spec, one: bool = False) -> DataFrame:
        """One row: how many documents delete() would remove."""
        n = self.counted(spec, "deleted")
        return n.select(F.least("deleted", F.lit(1)).cast("long").alias("deleted")) if one else n

    def delete(self, spec, one: bool = False) -> Collection:
        matches = compile_filter(spec, self.df.schema)
        return Collection(self.df.filter(negate(self._first(matches) if one else matches)), self.id_col)

    def insert(self, rows: DataFrame) -> Collection:
        """The collection with rows added; a key that is null, there already, or twice in rows is an error. Rows without
        a column for a string key get new object ids."""
        if self.id_col and self.id_col not in rows.columns:
            if self.df.schema[self.id_col].dataType.simpleString() != "string":
                raise EngineError(f"rows need a {self.id_col}")
            rows = rows.withColumn(self.id_col, object_id())
        elif self.id_col:
            if not rows.filter(F.col(self.id_col).isNull()).isEmpty():
                raise EngineError(f"{self.id_col} can't be null")
            twice = rows.groupBy(self.id_col).count().filter("count > 1").select(self.id_col)
            there = rows.join(self.df, self.id_col, "left_semi").select(self.id_col)
            if clash := twice.union(there).first():
                raise DuplicateKeyError(f"duplicate key {clash[0]!r}")
        return Collection(self.df.unionByName(rows, allowMissingColumns=True), self.id_col)

    def is_unique(self, *fields: str) -> bool:
        """Whether no two documents share the values of fields; a single null field is left out."""
        rows = self.df.filter(F.col(fields[0]).isNotNull()) if len(fields) == 1 else self.df
        return rows.groupBy(*fields).count().filter("count > 1").isEmpty()
