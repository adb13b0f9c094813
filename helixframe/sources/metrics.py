"""Tool logs to metrics. `lines` are (path, line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.lines import field, file_sample, last_seen

# Log descriptions by metric name and type, in log order.
ALIGNER_METRICS = {
    "total_reads": ("Number of input reads", "long"),
    "average_read_length": ("Average input read length", "double"),
    "unique_mapped": ("Uniquely mapped reads number", "long"),
    "unique_mapped_ratio": ("Uniquely mapped reads %", "double"),
    "average_mapped_read_length": ("Average mapped length", "double"),
    "total_splices": ("Number of splices: Total", "long"),
    "annotated_splices": ("Number of splices: Annotated", "long"),
    "multiple_mapped": ("Number of reads mapped to multiple loci", "long"),
    "multiple_mapped_ratio": ("% of reads mapped to multiple loci", "double"),
    "many_mapped": ("Number of reads mapped to too many loci", "long"),
    "many_mapped_ratio": ("% of reads mapped to too many loci", "double"),
    "chimeric": ("Number of chimeric reads", "long"),
}


def described_values(lines: DataFrame) -> DataFrame:
    """(sample, description, value) of `description | value` lines."""
    p = F.split("value", r"\|")
    return lines.filter(F.size(p) == 2).select(
        file_sample(F.col("path")).alias("sample"), 
        *[F.regexp_replace(field(p, i), r"^\s+|\s+$", "").alias(n) for i, n in ((1, "description"), (2, "text"))],
    )


def aligner_summary(lines: DataFrame) -> DataFrame:
    """One typed row per log, with the mapped total and ratio."""
    rows = described_values(lines)
    number = F.regexp_replace("text", "%$", "")
    aggs = [
        F.max(F.when(F.col("description").contains(text), number)).cast(kind).alias(name)
        for name, (text, kind) in ALIGNER_METRICS.items()
    ]
    wide = rows.groupBy("sample").agg(*aggs)
    return wide.withColumn(
        "mapped", F.col("unique_mapped") + F.col("multiple_mapped") + F.col("many_mapped")
    ).withColumn(
        "mapped_ratio", F.col("unique_mapped_ratio") + F.col("multiple_mapped_ratio") + F.col("many_mapped_ratio")
    )


def section_records(lines: DataFrame, marker: str = "## METRICS", next_n: int = 2) -> DataFrame:
    """(sample, record, metric, value) of the rows after a marker line; the first is the header."""
    placed = last_seen(lines, F.col("value").startswith(marker), "_marker")
    section = placed.withColumn("_k", F.col("line_no") - F.col("_marker")).filter(F.col("_k").between(1, next_n))
    cells = section.select("path", "_marker", "_k", F.posexplode(F.split("value", "\t")).alias("_i", "cell"))
    header = cells.filter("_k = 1").select("path", "_marker", "_i", F.col("cell").alias("metric"))
    return cells.filter("_k > 1").join(header, ["path", "_marker", "_i"]).select(
        file_sample(F.col("path")).alias("sample"), (F.col("_k") - 1).alias("record"), "metric", F.col("cell").alias("value")
    )


def coverage_metrics(lines: DataFrame, suffix: str) -> DataFrame:
    """(sample, metric, value) of `section,group,metric,value[,percent]` lines."""
    p = F.split("value", ",")
    return lines.select(file_sample(F.col("path"), suffix).alias("sample"), field(p, 3).alias("metric"), field(p, 4).alias("value"))


def summary_metrics(lines: DataFrame, suffix: str) -> DataFrame:
    """(sample, metric, value) of the summary section that opens the file; the value is the last field.

    The first line ends with a percentage that is left out.
    """
    p = F.split("value", ",")
    ends = (
        lines.filter(~field(p, 1).endswith("SUMMARY")).groupBy("path").agg(F.min("line_no").alias("_end"))
    )
    kept = lines.join(ends, "path", "left").filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
    last = F.when(F.col("line_no") == 1, F.element_at(p, -2)).otherwise(F.element_at(p, -1))
    return kept.select(file_sample(F.col("path"), suffix).alias("sample"), field(p, 3).alias("metric"), last.alias("value"))


def metric_table(long: DataFrame, samples: list[str]) -> DataFrame:
    """Metrics as rows, samples as columns, matched by metric name."""
    return long.groupBy("metric").pivot("sample", samples).agg(F.first("value"))


def flag_counts(lines: DataFrame) -> DataFrame:
    """`n + m description` lines."""
    p = F.split("value", " ", 4)
    return lines.filter(field(p, 2) == "+").select(
        file_sample(F.col("path")).alias("sample"), "line_no", field(p, 1).cast("long").alias("passed"),
        field(p, 3).cast("long").alias("failed"), field(p, 4).alias("description"),
    )


def alignment_rate(lines: DataFrame) -> DataFrame:
    """Reads and aligned reads from the first line `unaligned aligned too_many total`."""
    p = F.split("value", " ")
    aligned = field(p, 2).cast("long") + field(p, 3).cast("long")
    total = field(p, 4).cast("long")
    return lines.filter("line_no = 1").select(
        file_sample(F.col("path")).alias("sample"), total.alias("total_reads"), aligned.alias("aligned_reads"),
        (aligned / total).alias("aligned_rate"),
    )


def tag_shares(lines: DataFrame, skip: int = 4) -> DataFrame:
    """(sample, group, tags, share) of a read distribution table with a banner, a header and a footer line."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("line_no") > skip + 1).filter(field(p, 3).cast("string").rlike(r"^\d+$")).select(
        file_sample(F.col("path")).alias("sample"), field(p, 1).alias("tag_group"), field(p, 3).try_cast("long").alias("tags")
    )
    totals = rows.groupBy("sample").agg(F.sum("tags").alias("_t"))
    return rows.join(totals, "sample").select("sample", "tag_group", "tags", (F.col("tags") / F.col("_t")).alias("share"))
