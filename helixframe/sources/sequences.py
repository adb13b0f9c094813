"""FASTA and FASTQ records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.lines import read_numbered_lines


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, sequence). The record separator is the line break before '>', so a large
    file is still split over tasks."""
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path))


def parse_fasta(chunks: DataFrame) -> DataFrame:
    """Records from (value) chunks of one record each; blank lines and '#' lines are skipped."""
    rows = F.filter(
        F.split(F.regexp_replace("value", "^>", ""), "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")
    )
    parsed = chunks.select(rows.alias("r")).filter(F.size("r") > 0)
    header = F.col("r")[0]
    return parsed.select(
        F.regexp_extract(header, r"^(\S+)", 1).alias("name"),
        F.trim(F.regexp_replace(header, r"^\S+", "")).alias("description"),
        F.array_join(F.transform(F.slice("r", 2, F.size("r")), F.trim), "").alias("sequence"),
    )


def short_id(name: Column, stop: str = r"[(|]") -> Column:
    """Identifier up to the first bracket or bar."""
    return F.split(name, stop)[0]


def strip_version(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def keyed_by_both_ids(records: DataFrame) -> DataFrame:
    """Every record under its full and its unversioned id."""
    both = F.array_distinct(F.array(F.col("name"), strip_version(F.col("name"))))
    return records.select(F.explode(both).alias("key"), *records.columns)


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Four lines make a record. What is left of a batch is put before the next one of the same file."""
    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pd.concat([rest, batch], ignore_index=True)
        # A task may read several files; every file starts at a record.
        place = batch.groupby("path", sort=False).cumcount()
        last = batch["path"].iloc[-1]
        over = int((batch["path"] == last).sum() % 4)
        rest = batch.tail(over) if over else None
        if over:
            batch, place = batch.iloc[:-over], place.iloc[:-over]
        parts = [batch["value"][place % 4 == k].reset_index(drop=True) for k in range(4)]
        files = batch["path"][place % 4 == 0].reset_index(drop=True)
        yield pd.DataFrame(
            {"path": files, "header": parts[0], "sequence": parts[1], "plus": parts[2], "quality": parts[3]}
        )


FASTQ = "path string, header string, sequence string, plus string, quality string"


def read_fastq(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """Reads of FASTQ files.

    A gzip file is one split, so its lines arrive in order and are put together inside the task,
    batch by batch. A plain file may be split inside a record; its lines are numbered and grouped
    by record.
    """
    if compressed:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
        return lines.mapInPandas(_assemble, FASTQ)
    lines = read_numbered_lines(spark, path).withColumn("record", F.floor((F.col("line_no") - 1) / 4))
    place = (F.col("line_no") - 1) % 4
    return lines.groupBy("path", "record").agg(
        *[
            F.max(F.when(place == k, F.col("value"))).alias(name)
            for k, name in enumerate(("header", "sequence", "plus", "quality"))
        ]
    ).drop("record")


def header_fields(header: Column) -> list[Column]:
    """lane, read number and the two indexes of `@inst:run:cell:lane:tile:x:y read:filtered:ctrl:i7+i5`."""
    parts = F.split(header, " ")
    detail = F.split(parts[1], ":")
    index = F.split(detail[3], r"\+")
    return [
        F.lpad(F.split(parts[0], ":")[3], 3, "0").alias("lane"), detail[0].alias("read"),
        index[0].alias("i1"), F.get(index, F.lit(1)).alias("i2"),
    ]


def base_composition(reads: DataFrame, pattern: str, groups: int, bases: str = "ACGTN") -> DataFrame:
    """Counts and shares of the bases at each position of each captured group.

    Positions are few, so the map side already reduces the exploded bases to a small table.
    """
    spots = F.explode(
        F.array(
            *[
                F.struct(F.lit(g).alias("grp"), F.regexp_extract("sequence", pattern, g).alias("text"))
                for g in range(1, groups + 1)
            ]
        )
    )
    chars = reads.filter(F.col("sequence").rlike(pattern)).select(spots.alias("s")).select(
        F.col("s.grp").alias("grp"), F.posexplode(F.split("s.text", "")).alias("pos", "base")
    ).filter(F.col("base") != "")
    counted = chars.groupBy("grp", "pos").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("base") == x).alias(x) for x in bases]
    )
    return counted.select("*", *[(F.col(x) / F.col("total")).alias(f"{x}_ratio") for x in bases])


def sequence_lengths(records: DataFrame) -> DataFrame:
    return records.select("name", F.length("sequence").cast("long").alias("length"))
