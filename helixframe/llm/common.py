"""Small helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import cut_lineage, new_path, tune

#: Rows of an Arrow batch. A batch holds whole texts, so it is kept well below Spark's default.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive settings of the library, and Arrow batches small enough for whole texts."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shaped(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (name=type), cast; what a table lacks is null. Other columns, whatever their names, are left."""
    return df.select(*[(df[c] if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def by_bytes(texts: pd.Series, limit: int) -> Iterator[list[str]]:
    """Consecutive slices of the texts with at most `limit` characters each, or one longer text."""
    slice_, size = [], 0
    for text in texts:
        text = text or ""
        if slice_ and size + len(text) > limit:
            yield slice_
            slice_, size = [], 0
        slice_.append(text)
        size += len(text)
    if slice_:
        yield slice_


def text_key(docs: DataFrame) -> Column:
    """A hash of the whole text: with the id, it names a row up to equal rows."""
    return F.xxhash64(text_of(docs["text"]))


def without(docs: DataFrame, found: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of `docs` that are not in `found` (doc_id, text_key), which is broadcast only if it is counted small."""
    keys = cut_lineage(found.select(F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_text")).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_found_id"]) & (text_key(docs) == keys["_found_text"])
    return docs.join(F.broadcast(keys) if keys.count() <= broadcast_rows else keys, same, "left_anti")


def hot_join(rows: DataFrame, table: DataFrame, key: str, broadcast_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Inner join of rows, of which any share may have one key, with a table of distinct keys.

    The table is written out and counted: it is broadcast if small, and else repeated for each salt of the rows.
    """
    table = cut_lineage(table)
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), key)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, which cuts lineage and is compact on disk."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finite_integers(vector: Column, scale: int, largest: int) -> Column:
    """A struct of an array<double>: parts, floor(scale * x) as integers; ok, whether all components are there and finite; fits,
    whether all parts stay below `largest` in absolute value (parts are null if not)."""
    scaled = F.transform(vector, lambda x: x * F.lit(float(scale)))
    ok = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    fits = F.forall(scaled, lambda x: F.abs(x) < F.lit(float(largest - 1)))
    parts = F.when(ok & fits, F.transform(scaled, lambda x: F.floor(x).cast("int")))
    return F.struct(ok.alias("ok"), F.coalesce(ok & fits, F.lit(False)).alias("fits"), parts.alias("parts"))
