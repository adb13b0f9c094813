"""Sample sheets, comparisons, gene lists and mappings. `lines` are (path, line_no, value) or (value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.sources.lines import checked, field, last_seen


def sample_groups(table: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, scheme, grp) from one column per scheme; a scheme with a single group fails the job."""
    schemes = [c for c in table.columns if c != sample]
    long = table.unpivot([sample], schemes, "scheme", "grp").filter(F.col("grp").isNotNull()).distinct()
    sizes = long.groupBy("scheme").agg(F.countDistinct("grp").alias("_n"))
    message = F.concat(F.lit("all samples share one group in "), F.col("scheme"))
    return long.join(sizes, "scheme").select(
        F.col(sample).alias("sample"), "scheme", checked(F.col("_n") > 1, message, F.col("grp")).alias("grp")
    )


def comparisons(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(ctrl, test); comments and blanks skipped, an unknown name fails the job."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = (
        lines.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .select(field(parts, 1).alias("ctrl"), field(parts, 2).alias("test"))
        .distinct()
    )
    names = known.select(F.col(known.columns[0]).alias("_name")).distinct()
    out = pairs
    for side in ("ctrl", "test"):
        out = out.join(names.withColumnRenamed("_name", side).withColumn(f"_ok_{side}", F.lit(True)), side, "left")
        out = out.withColumn(
            side, checked(F.col(f"_ok_{side}"), F.concat(F.lit("unknown name "), F.col(side)), F.col(side))
        )
    return out.select("ctrl", "test")


def gene_terms(lines: DataFrame) -> DataFrame:
    """(gene, term) pairs; `ko:` and `path:` prefixes go, map terms go, ';' lists are exploded."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = lines.filter(F.size(parts) == 2).select(field(parts, 1).alias("gene"), field(parts, 2).alias("terms"))
    kept = pairs.filter(~(F.col("terms").startswith("path:map") | F.col("terms").startswith("map")))
    return kept.select(
        F.regexp_replace("gene", "^ko:", "").alias("gene"), F.explode(F.split("terms", ";")).alias("term")
    ).select("gene", F.regexp_replace("term", "^path:", "").alias("term")).distinct()


def regulated_genes(lines: DataFrame) -> DataFrame:
    """(gene, direction). Whether there is a direction column is decided by the first line of each file."""
    parts = F.split(F.trim("value"), r"\s+")
    first = lines.groupBy("path").agg(F.min_by(F.size(parts) >= 2, "line_no").alias("_directed"))
    return lines.filter(F.trim("value") != "").join(first, "path").select(
        F.when(F.col("_directed"), field(parts, 1)).otherwise(F.trim("value")).alias("gene"),
        F.when(F.col("_directed"), F.coalesce(field(parts, 2), F.lit(""))).otherwise("").alias("direction"),
    ).distinct()


def metagenes(lines: DataFrame, listed: bool) -> DataFrame:
    """(metagene, gene): either `gene group` lines, or `group g1,g2 g3` lines where a group may occur once."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    if not listed:
        return lines.select(field(parts, 2).alias("metagene"), field(parts, 1).alias("gene")).distinct()
    rows = lines.select(field(parts, 1).alias("metagene"), field(parts, 2).alias("_genes"))
    merged = rows.groupBy("metagene").agg(F.count("*").alias("_n"), F.min("_genes").alias("_genes"))
    message = F.concat(F.lit("metagene given twice: "), F.col("metagene"))
    return merged.select(
        checked(F.col("_n") == 1, message, F.col("metagene")).alias("metagene"),
        F.explode(F.split("_genes", r"[,\s]+")).alias("gene"),
    ).filter(F.col("gene") != "").distinct()


def fastq_sheet(lines: DataFrame) -> DataFrame:
    """(sample, read1 list, read2 list) from `sample a;b c;d` lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        field(parts, 1).alias("sample"),
        F.split(field(parts, 2), ";").alias("read1"),
        F.split(field(parts, 3), ";").alias("read2"),
    )


def class_hierarchy(lines: DataFrame) -> DataFrame:
    """Indented A/B/C lines to one row per C entry with its B and A parents."""
    v = F.col("value")
    kind = F.when(v.startswith("A<"), "A").when(v.startswith("B") & (F.trim(F.substring(v, 2, 10**6)) != ""), "B")
    marked = last_seen(lines, kind == "A", "_a")
    marked = last_seen(marked, kind == "B", "_b")
    text = F.regexp_extract(v, "^A<[^>]*>(.*)</[^>]*>$", 1)
    upper = lines.filter(kind == "A").select("path", F.col("line_no").alias("_a"), text.alias("top"))
    middle = lines.filter(kind == "B").select("path", F.col("line_no").alias("_b"), F.trim(F.expr("substring(value, 2)")).alias("middle"))
    entries = marked.filter(v.startswith("C"))
    message = F.lit("a C line without A and B lines before it")
    parts = F.split(F.trim(v), r"\s+", 3)
    return entries.join(upper, ["path", "_a"], "left").join(middle, ["path", "_b"], "left").select(
        checked(F.col("top").isNotNull() & F.col("middle").isNotNull(), message, field(parts, 2)).alias("code"),
        field(parts, 3).alias("name"), "middle", "top",
    )


def class_conditions(lines: DataFrame) -> DataFrame:
    """(variant_class, gene, protein) from (variant_class, condition), the condition being a list of
    {field, operator, value}. The literal is read as data and never evaluated."""
    schema = "array<struct<field:string,operator:string,value:string>>"
    parsed = lines.withColumn("c", F.from_json("condition", schema, {"allowSingleQuotes": "true"}))

    def values(name: str):
        chosen = F.filter("c", lambda x: x["field"] == name)
        lists = F.transform(
            chosen,
            lambda x: F.when((x["operator"] == "in") | F.lit(name == "gene"), F.split(x["value"], ",")).otherwise(
                F.array(x["value"])
            ),
        )
        return F.flatten(lists)

    return (
        parsed.select("variant_class", F.explode(values("gene")).alias("gene"), values("protein").alias("_p"))
        .select("variant_class", "gene", F.explode("_p").alias("protein"))
        .distinct()
    )


# Patterns of class names.
CLASS_PATTERNS = {
    "exon": r"^(.*) exon ([0-9]+) (.*)",
    "half_known": r"^(.*) ([A-Z][0-9]+[*]?) (.*)",
    "deleterious": r"^([A-Z0-9]+) deleterious mutation",
    "activating": r"^([A-Z0-9]+) activating mutation",
    "mutation": r"^([A-Z0-9]+) mutation$",
    "aberration": r"^([A-Z0-9]+) aberration$",
    "splice": r"^([A-Z0-9]+) splice site mutation",
}


def class_members(classes: DataFrame, kind: str) -> DataFrame:
    """Genes (and exon or half-known position) named in `variant_class`."""
    pattern = CLASS_PATTERNS[kind]
    hits = classes.filter(F.col("variant_class").rlike(pattern))
    gene = F.regexp_extract("variant_class", pattern, 1).alias("gene")
    if kind in ("exon", "half_known"):
        return hits.select(gene, F.regexp_extract("variant_class", pattern, 2).alias("place"), "variant_class").distinct()
    return hits.select(gene).distinct()


def class_parents(lines: DataFrame) -> DataFrame:
    """(class, parent) from three-column rows."""
    parts = F.split(F.trim("value"), "\t")
    return lines.filter(F.size(parts) == 3).select(field(parts, 2).alias("class"), field(parts, 3).alias("parent")).distinct()
