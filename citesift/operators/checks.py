"""Checks of tables: the rows that break a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What one task counts, about: bytes of its keys, of which each takes ROW_BYTES besides its strings. More of them are more tasks.
TASK_BYTES, ROW_BYTES = 128 << 20, 128


def _counted(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., rows): each key with the number of its rows. A task holds about TASK_BYTES of keys however large the table is: with more, rows are dealt
    by key and a random part, counted, and the counts dealt by key and added up, so that a key of very many rows is spread too."""
    rows = rows.select(*key)
    strings = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in rows.dtypes if kind in ("string", "binary")]
    size = rows.agg(F.coalesce(F.sum(sum(strings, F.lit(ROW_BYTES)).cast("long")), F.lit(0))).first()[0]
    tasks = -(-size // TASK_BYTES)
    if tasks <= 1:
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    part = rows.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)))
    part = part.repartition(tasks, *key, "_part").groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("rows"))
    return part.repartition(tasks, *key).groupBy(*key).agg(F.sum("rows").alias("rows"))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., rows): keys that more than one row has, and keys with a null in them, with the number of rows. Empty if the key is one.

    Rows of one key are counted in parts, so a key of very many rows costs no more than others."""
    n = _counted(rows, *key)
    some_null = F.lit(False)
    for name in key:
        some_null = some_null | F.col(name).isNull()
    return n.filter((F.col("rows") > 1) | some_null)


def missing_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(child key, rows): keys of children that no parent has, nulls among them, with the number of children. Empty if all references hold."""
    asked = _counted(children, child_key)
    known = _counted(parents.select(F.col(parent_key).alias("_parent")), "_parent").select("_parent")
    return asked.join(known, F.col(child_key) == F.col("_parent"), "left_anti")
