"""Object ids: 24 hexadecimal digits, of which the first eight are the time in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_id() -> Column:
    """A new id for each row. Ids are made when a plan runs: write the rows before they are used twice."""
    seconds = F.lpad(F.lower(F.hex(F.unix_timestamp())), 8, "0")
    return F.concat(seconds, F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 17, 16))


def made_at(column: Column) -> Column:
    """The time in an object id."""
    return F.timestamp_seconds(F.conv(F.substring(column, 1, 8), 16, 10).cast("long"))
