"""Gene models, intervals, taxonomy and id link files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.sources.lines import field


def gtf(lines: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Nine GTF columns with the attributes as a map; optionally only rows of the listed transcripts."""
    p = F.split("value", "\t")
    attrs = F.map_from_arrays(
        F.regexp_extract_all(field(p, 9), F.lit(r'(\w+) "?([^";]*)"?;?'), F.lit(1)),
        F.regexp_extract_all(field(p, 9), F.lit(r'(\w+) "?([^";]*)"?;?'), F.lit(2)),
    )
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(p) == 9)).select(
        field(p, 1).alias("chrom"), field(p, 2).alias("source"), field(p, 3).alias("type"),
        field(p, 4).cast("long").alias("start"), field(p, 5).cast("long").alias("end"), field(p, 6).alias("score"),
        field(p, 7).alias("strand"), field(p, 8).alias("phase"), attrs.alias("attrs"),
    )
    if transcripts is None:
        return rows
    wanted = transcripts.select(F.col(transcripts.columns[0]).alias("_t")).distinct()
    stem = F.split(F.col("attrs")["transcript_id"], r"\.")[0]
    return rows.withColumn("_t", stem).join(wanted, "_t", "left_semi").drop("_t")


def bed(lines: DataFrame, one_based: bool = False) -> DataFrame:
    """0-based half-open intervals; track and comment lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    shift = 1 if one_based else 0
    return lines.filter(~F.col("value").rlike("^(track|#)") & (F.size(p) >= 3)).select(
        field(p, 1).alias("chrom"), (field(p, 2).cast("long") - shift).alias("start"),
        field(p, 3).cast("long").alias("end"), field(p, 4).alias("name"),
    )


def _dump_fields(column: str = "value") -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(column, "\t", ""), r"\|$", ""), r"\|")


def taxonomy_nodes(lines: DataFrame) -> DataFrame:
    p = _dump_fields()
    return lines.select(field(p, 1).alias("tax_id"), field(p, 2).alias("parent_id"), field(p, 3).alias("rank"))


def taxonomy_names(lines: DataFrame, kind: str = "scientific name") -> DataFrame:
    p = _dump_fields()
    return lines.filter(field(p, 4) == kind).select(field(p, 1).alias("tax_id"), field(p, 2).alias("tax_name"))


def taxonomy_merged(lines: DataFrame) -> DataFrame:
    p = _dump_fields()
    return lines.select(field(p, 1).alias("tax_id"), field(p, 2).alias("new_id"))


def accession_taxa(lines: DataFrame) -> DataFrame:
    """(seq_id, tax_id) of classified accessions; the header and taxon 0 are dropped."""
    p = F.split("value", "\t")
    return lines.filter((field(p, 3) != "0") & (field(p, 1) != "accession")).select(
        field(p, 2).alias("seq_id"), field(p, 3).alias("tax_id")
    )


def gene_id_pairs(lines: DataFrame, tax_id: str, source: int, target: int, strip_version: bool = False) -> DataFrame:
    """Distinct (source, target) columns of one taxon's rows; '-' is no value."""
    p = F.split("value", "\t")
    pairs = lines.filter(field(p, 1) == tax_id).select(field(p, source).alias("source"), field(p, target).alias("target"))
    kept = pairs.filter((F.col("source") != "-") & (F.col("target") != "-"))
    if strip_version:
        kept = kept.withColumn("source", F.split("source", r"\.")[0])
    return kept.distinct()


def link_pairs(lines: DataFrame) -> DataFrame:
    """(source, target) of `hsa:1<tab>ko:K1` lines without their prefixes."""
    p = F.split("value", "\t")
    return lines.select(
        field(F.split(field(p, 1), ":"), 2).alias("source"), field(F.split(field(p, 2), ":"), 2).alias("target")
    )


def symbol_registry(table: DataFrame) -> DataFrame:
    """The six columns used from a gene registry download."""
    # Column titles of the download.
    titles = {
        "HGNC ID": "registry_id", "Approved symbol": "symbol", "Approved name": "name",
        "Previous symbols": "previous", "Alias symbols": "alias", "Ensembl gene ID": "gene_id",
    }
    return table.select(*[F.col(f"`{old}`").alias(new) for old, new in titles.items()])


def domain_hits(lines: DataFrame) -> DataFrame:
    """Domain table rows: 22 blank-separated fields and a free description."""
    # Field names in file order.
    names = (
        "family pfam_id domain_len query_id query_accession query_len e_value score bias domain_order domain_num "
        "c_evalue i_evalue i_score i_bias hmm_start hmm_end ali_start ali_end env_start env_end acc description"
    ).split()
    p = F.split("value", r"\s+", 23)
    return lines.filter(~F.col("value").startswith("#")).select(
        *[field(p, i).alias(n) for i, n in enumerate(names, start=1)]
    )


def microsatellite_sites(lines: DataFrame) -> DataFrame:
    """Sites from `chr pos left 14[A] right` lines or ten-column lines."""
    v = F.trim("value")
    p = F.split(v, r"\s+")
    short = v.contains("[") & v.contains("]")
    unit = F.regexp_extract(field(p, 4), r"\[(.*)\]", 1)
    return lines.filter(v != "").select(
        field(p, 1).alias("chrom"),
        field(p, 2).cast("long").alias("pos"),
        F.when(short, unit).otherwise(field(p, 8)).alias("unit"),
        F.when(short, F.regexp_extract(field(p, 4), r"^(\d+)\[", 1)).otherwise(field(p, 5)).cast("int").alias("times"),
        F.when(short, field(p, 3)).otherwise(field(p, 9)).alias("left_flank"),
        F.when(short, field(p, 5)).otherwise(field(p, 10)).alias("right_flank"),
    )


def hotspots(lines: DataFrame) -> DataFrame:
    """Seven-column hotspot rows; rows of another width are skipped."""
    names = ["chrom", "start", "end", "chgvs", "phgvs", "transcript", "gene"]
    p = F.split(F.trim("value"), "\t")
    return lines.filter(F.size(p) == 7).select(*[field(p, i).alias(n) for i, n in enumerate(names, start=1)])


def platform_matrix(samples: DataFrame, probes: DataFrame, sample_names: list[str]) -> DataFrame:
    """(platform, probe) x samples with the probe annotation; samples is (platform, sample, probe, value)."""
    wide = samples.groupBy("platform", "probe").pivot("sample", sample_names).agg(F.first("value"))
    return wide.join(probes, ["platform", "probe"], "left")
