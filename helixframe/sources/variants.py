"""VCF lines to nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.sources.lines import field


def info_map(text: Column) -> Column:
    """INFO `k=v;flag` as a map; a flag has the value ``Flagged``."""
    pairs = F.transform(F.split(text, ";"), lambda x: F.split(x, "=", 2))
    return F.map_from_entries(
        F.transform(
            pairs, lambda x: F.struct(F.trim(x[0]), F.coalesce(F.trim(F.get(x, F.lit(1))), F.lit("Flagged")))
        )
    )


def sample_map(format_text: Column, values: Column) -> Column:
    """FORMAT keys with the values of one sample; trailing values may be missing."""
    keys, vals = F.split(format_text, ":"), F.split(values, ":")
    return F.map_from_arrays(F.slice(keys, 1, F.least(F.size(keys), F.size(vals))), F.slice(vals, 1, F.least(F.size(keys), F.size(vals))))


def vcf(lines: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Nested variant records from (value) lines. `samples` are the names of the header line, which is read if none are given:
    one line, so a list of names."""
    if samples is None:
        samples = [r["sample"] for r in header_samples(lines).orderBy("place").collect()]
    p = F.split("value", "\t")
    fixed = [
        field(p, 1).alias("chrom"), field(p, 2).cast("long").alias("pos"), field(p, 3).alias("id"),
        field(p, 4).alias("ref"), F.split(field(p, 5), ",").alias("alt"), field(p, 6).alias("qual"),
        F.split(field(p, 7), ";").alias("filter"), info_map(field(p, 8)).alias("info"),
    ]
    columns = [sample_map(field(p, 9), field(p, 10 + i)) for i in range(len(samples))]
    entries = []
    for name, column in zip(samples, columns):
        entries += [F.lit(name), column]
    maps = F.create_map(*entries) if entries else F.lit(None).cast("map<string,map<string,string>>")
    return lines.filter(~F.col("value").startswith("#")).select(*fixed, maps.alias("samples"))


def field_types(lines: DataFrame) -> DataFrame:
    """(section, id, type) of the INFO, FORMAT and ALT header lines."""
    pattern = r"^##(INFO|FORMAT|ALT)=<"
    return lines.filter(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).alias("section"),
        F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("id"),
        F.nullif(F.regexp_extract("value", r"[<,]Type=([^,>]+)", 1), F.lit("")).alias("type"),
    )


def header_samples(lines: DataFrame) -> DataFrame:
    """Sample names in header order."""
    names = F.split("value", "\t")
    return lines.filter(F.col("value").startswith("#CHROM")).select(
        F.posexplode(F.slice(names, 10, F.size(names))).alias("place", "sample")
    )
