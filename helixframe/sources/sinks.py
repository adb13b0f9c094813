"""Writers, the keyed sequence store and the variant store."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import ordered


def write_text_table(df: DataFrame, path: str, form: str = "tsv") -> None:
    if form == "json":
        df.write.json(path)
    else:
        df.write.option("header", True).option("sep", "\t" if form == "tsv" else ",").csv(path)


def write_per_key(df: DataFrame, path: str, key: str, max_records: int = 5_000_000, writer_records: int = 1_000_000) -> None:
    """One folder per key value. Keys are counted; rows are spread by key and row hash over writers of about `writer_records`
    rows, so that what a task sorts does not grow with the table; smaller keys go over as many writers as the largest at most."""
    counted = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
    part = F.pmod(F.xxhash64(*df.columns), F.lit(-(-(counted["largest"] or 1) // min(max_records, writer_records))))
    tasks = -(-(counted["total"] or 0) // writer_records)
    dealt = df.repartition(tasks, key, part) if tasks > 1 else df.repartition(key, part)  # a number of tasks is not merged again
    dealt.write.option("maxRecordsPerFile", max_records).partitionBy(key).parquet(path)


def chunked(df: DataFrame, order: str, size: int, drop_short: bool = False) -> DataFrame:
    """Chunk number of every row in chunks of `size`; optionally without a short last chunk."""
    numbered = ordered.number_rows(df, order)
    out = numbered.withColumn("chunk", F.floor((F.col("row_no") - 1) / size))
    if drop_short:
        full = df.agg(F.floor(F.count("*") / size).alias("n")).scalar()
        out = out.filter(F.col("chunk") < full)
    return out.drop("row_no")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable random order number per row: sixty bits of a digest that other engines have too."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return df.withColumn("draw", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def store_sequences(records: DataFrame, table: str, path: str, per_bucket: int = 1_000_000) -> None:
    """Bucketed by id, so that lookups join without shuffling the store; the buckets follow from the number of records."""
    buckets = max(1, min(100_000, -(-records.count() // per_bucket)))
    records.write.bucketBy(buckets, "seq_id").sortBy("seq_id").option("path", path).saveAsTable(table)


def look_up_sequences(spark: SparkSession, table: str, ids: DataFrame) -> DataFrame:
    return spark.table(table).join(ids.select("seq_id").distinct(), "seq_id")


def variant_rows(variants: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per annotation of a variant, with the record's canonical annotation.

    variants: (source, chrom, start, var_id, ref, alt, hgvs); hgvs is `gene:transcript:exon:c:p[,...]`
    or '.'. canonical: (gene, canonical_transcript), which may carry a version.
    """
    key = ["source", "chrom", "start", "var_id", "ref", "alt"]
    p = F.split("one", ":")
    rows = (
        variants.filter(F.col("hgvs") != ".")
        .select(*key, F.explode(F.split("hgvs", ",")).alias("one"))
        .select(
            *key, "one", F.get(p, F.lit(0)).alias("gene"), F.get(p, F.lit(1)).alias("transcript"),
            F.get(p, F.lit(2)).alias("exon"), F.get(p, F.lit(3)).alias("chgvs"),
            F.coalesce(F.get(p, F.lit(4)), F.lit("None")).alias("phgvs"),
        )
        .join(canonical, "gene", "left")
    )
    own = F.when(F.col("canonical_transcript").startswith(F.col("transcript")), F.col("one"))
    best = rows.groupBy(*key).agg(F.max(own).alias("canonical"))
    return rows.drop("canonical_transcript", "one").join(best, key)


def query_variants(store: DataFrame, queries: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variants that match on the given columns; rows with a canonical annotation win within a query."""
    hits = queries.select("query_id", *columns).join(store, list(columns))
    any_canonical = hits.groupBy("query_id").agg(F.count("canonical").alias("_n"))
    kept = hits.join(any_canonical, "query_id").filter((F.col("_n") == 0) | F.col("canonical").isNotNull())
    shown = F.coalesce("canonical", F.concat_ws(":", "gene", "transcript", "exon", "chgvs", "phgvs"))
    return kept.select("query_id", "chrom", "start", "var_id", "ref", "alt", shown.alias("annotation")).distinct()


def _meets(conditions: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in conditions.items()], F.lit(True))


def delete_variants(store: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """The store without the rows that meet all conditions; the caller writes it to a new folder."""
    return store.filter(~_meets(conditions))


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_stored(spark: SparkSession, path: str, conditions: dict[str, str], by: str = "chrom") -> int:
    """Delete the rows that meet all conditions from a store written by `write_per_key`; returns how many.

    Only the partitions that hold such rows are written anew, and folders left without rows are removed; the files of
    all others stay. While it runs the store holds a marker `_deletion`; deleting is repeatable, so after a failure
    `finish_deletion` ends it. One deletion at a time; readers may run before or after it, not meanwhile.
    """
    if not conditions:
        raise ValueError("conditions are needed to delete rows")
    store = spark.read.parquet(path)
    gone = _meets(conditions)
    counts = store.groupBy(by).agg(F.count_if(gone).alias("gone"), F.count("*").alias("n")).filter("gone > 0")
    hit = counts.collect()  # at most one row for each folder of the store
    if not hit:
        return 0
    marker = f"{path}/_deletion"
    spark.createDataFrame([(json.dumps([conditions, by]),)], "value string").coalesce(1).write.mode("overwrite").text(marker)
    kept = [r[by] for r in hit if r["gone"] < r["n"]]
    if kept:
        inside = reduce(lambda a, b: a | b, [F.col(by).eqNullSafe(F.lit(v)) for v in kept])
        rest = store.filter(inside).filter(~gone)
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for r in hit:
        if r["gone"] == r["n"]:
            fs, folder = _folder(spark, path)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, names.getPartitionPathString(by, None if r[by] is None else str(r[by]))), True)
    fs, place = _folder(spark, marker)
    fs.delete(place, True)
    return sum(r["gone"] for r in hit)


def finish_deletion(spark: SparkSession, path: str) -> int:
    """End a deletion that failed midway, if the store holds its marker; returns how many rows were still there."""
    fs, place = _folder(spark, f"{path}/_deletion")
    if not fs.exists(place):
        return 0
    texts = [r[0] for r in spark.read.text(f"{path}/_deletion").collect()] if fs.exists(_folder(spark, f"{path}/_deletion/_SUCCESS")[1]) else []
    deleted = delete_stored(spark, path, *json.loads(texts[0])) if texts else 0
    fs.delete(place, True)
    return deleted
