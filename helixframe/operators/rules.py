"""Rule tables applied to variants and proteins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Consequences that truncate a protein.
TRUNCATING = ["frameshift deletion", "frameshift insertion", "frameshift substitution", "stopgain", "stoploss"]


def _flag(df: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    listed = table.select(F.col(table.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def classify_variants(
    variants: DataFrame, exact: DataFrame, half_known: DataFrame, exon: DataFrame, genes: dict[str, DataFrame],
    truncating_genes: DataFrame, depths: DataFrame,
) -> DataFrame:
    """Class and reason of every variant: the first rule of the cascade that gives one.

    variants: (row_id, gene, exon, phgvs, kind, onco, func, exonic_func, clnrevstat, clnsig).
    exact: (variant_class, gene, protein); half_known and exon: (gene, place, variant_class);
    genes: single-column tables deleterious, activating, splice, mutation and aberration.
    depths: (class, depth); of several exact classes the deepest counts.
    """
    v = variants.withColumn("_half", F.regexp_extract("phgvs", "^p.([A-Z][0-9]+[*]?).*", 1))
    for name in ("deleterious", "activating", "splice", "mutation", "aberration"):
        v = _flag(v, genes[name], "gene", f"_{name}")
    v = _flag(v, truncating_genes, "gene", "_truncates")

    deep = exact.join(depths.select(F.col("class").alias("variant_class"), "depth"), "variant_class", "left")
    best = deep.groupBy("gene", "protein").agg(
        F.max_by("variant_class", F.struct(F.coalesce("depth", F.lit(-1)), F.col("variant_class"))).alias("_exact")
    )
    v = v.join(best.withColumnRenamed("protein", "phgvs"), ["gene", "phgvs"], "left")

    def classes(table: DataFrame, key: str, name: str) -> DataFrame:
        # A gene position has a handful of class names.
        return table.groupBy("gene", F.col("place").alias(key)).agg(F.collect_set("variant_class").alias(name))

    v = v.join(classes(half_known, "_half", "_half_set"), ["gene", "_half"], "left")
    v = v.join(classes(exon, "exon", "_exon_set"), ["gene", "exon"], "left")

    gene, kind, consequence = F.col("gene"), F.lower("kind"), F.lower(F.trim("exonic_func"))
    splicing = F.lower("func").contains("splicing")
    pathogenic = F.lower("onco").isin("likely_oncogenic", "oncogenic") | (
        (F.lower("clnrevstat") == "reviewed_by_expert_panel") & F.lower("clnsig").contains("pathogenic")
    )
    truncated = F.col("_truncates") & (splicing | consequence.isin(TRUNCATING))

    def first_of(members: Column, *candidates: Column) -> Column:
        return F.coalesce(*[F.when(F.array_contains(F.coalesce(members, F.array().cast("array<string>")), c), c) for c in candidates])

    def name(*parts) -> Column:
        return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) and not p.startswith("_") else p for p in parts])

    half = first_of(
        F.col("_half_set"),
        F.when(kind == "deletion", name(gene, F.col("_half"), "deletion")),
        F.when(consequence.startswith("frameshift"), name(gene, F.col("_half"), "frame shift")),
        name(gene, F.col("_half"), "mutation"),
    )
    at_exon = first_of(
        F.col("_exon_set"),
        F.when(kind.isin("deletion", "insertion"), name(gene, "exon", F.col("exon"), kind)),
        F.when(pathogenic | truncated, name(gene, "exon", F.col("exon"), "activating mutation")),
        name(gene, "exon", F.col("exon"), "mutation"),
    )
    effect = F.when(F.col("_deleterious"), name(gene, "deleterious mutation")).when(F.col("_activating"), name(gene, "activating mutation"))
    cascade = [
        ("exact", F.col("_exact")), ("half known", half), ("exon", at_exon),
        ("pathogenic", F.when(pathogenic, effect)), ("truncating", F.when(truncated, effect)),
        ("splice", F.when(splicing & F.col("_splice"), name(gene, "splice site mutation"))),
        ("mutation", F.when(F.col("_mutation"), name(gene, "mutation"))),
        ("aberration", F.when(F.col("_aberration"), name(gene, "aberration"))),
    ]
    staged = v.select("row_id", "gene", (pathogenic | truncated).alias("_report"), *[c.alias(f"_c{i}") for i, (_, c) in enumerate(cascade)])
    reason = F.coalesce(*[F.when(F.col(f"_c{i}").isNotNull(), F.lit(r)) for i, (r, _) in enumerate(cascade)], F.lit(""))
    chosen = F.coalesce(*[F.col(f"_c{i}") for i in range(len(cascade))], F.lit(""))
    other = F.when((chosen == "") & F.col("_report"), F.concat_ws(" ", "gene", F.lit("mutation"))).otherwise("")
    return staged.select("row_id", chosen.alias("variant_class"), reason.alias("reason"), other.alias("other_reportable"))


def other_reportable(variants: DataFrame, truncating_genes: DataFrame, deleterious: DataFrame, activating: DataFrame) -> DataFrame:
    """Label of truncating or splicing variants in genes where truncation matters."""
    v = variants
    for table, name in ((truncating_genes, "_t"), (deleterious, "_d"), (activating, "_a")):
        v = _flag(v, table, "gene", name)
    hit = F.col("_t") & (F.lower("func").contains("splicing") | F.lower("exonic_func").isin(TRUNCATING))
    effect = F.when(F.col("_d"), "deleterious mutation").when(F.col("_a"), "activating mutation").otherwise("mutation")
    return v.select("row_id", F.when(hit, F.concat_ws(" ", "gene", effect)).otherwise("").alias("other_reportable"))


def deepest_class(choices: DataFrame, depths: DataFrame) -> DataFrame:
    """(row_id, class) choices to the class that lies deepest; the name decides between equals."""
    joined = choices.join(depths, "class", "left")
    return joined.groupBy("row_id").agg(F.max_by("class", F.struct(F.coalesce("depth", F.lit(-1)), F.col("class"))).alias("class"))


def domain_counts(hits: DataFrame) -> DataFrame:
    """(query_id, domain, n) with the version of the domain cut."""
    return hits.groupBy("query_id", F.split("pfam_id", r"\.")[0].alias("domain")).agg(F.count("*").alias("n"))


#: No protein holds more domains than an int counts.
NO_LIMIT = 2**31 - 1


def parse_family_rules(rules: DataFrame, most: int = NO_LIMIT) -> DataFrame:
    """(family, subfamily, role, domain, low, high) from (family, subfamily, binding, auxiliary, forbidden) text.

    `AP2 (>=2) (PF00847)` asks for a count, `B3 (PF02362)` for any; `most` bounds counts without an upper end.
    """
    text = lambda c: F.regexp_replace(c, "self-build", "PF0000x")
    pattern = r"(?:\(([<>=]*\d+)\)\s+)?\((P[^()]+?)\)"

    def role(column: str, label: str) -> DataFrame:
        entries = F.arrays_zip(
            F.regexp_extract_all(text(column), F.lit(pattern), F.lit(1)).alias("count"),
            F.regexp_extract_all(text(column), F.lit(pattern), F.lit(2)).alias("domain"),
        )
        return rules.select("family", "subfamily", F.lit(label).alias("role"), F.explode(entries).alias("e"))

    every = role("binding", "binding").union(role("auxiliary", "auxiliary")).union(role("forbidden", "forbidden"))
    count = F.col("e.count")
    number = F.regexp_extract(count, r"(\d+)", 1).try_cast("int")
    low = F.when(number.isNull() | count.contains("<"), 1).otherwise(number)
    high = F.when(number.isNull() | count.contains(">"), most).otherwise(number)
    return every.select("family", "subfamily", "role", F.col("e.domain").alias("domain"), low.alias("low"), high.alias("high"))


def judge_families(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, family) by the rules: all binding domains in range, no forbidden one.

    With auxiliary domains in a rule, one of them gives the subfamily, none the family; a
    subfamily takes the place of its family, whichever rule came first.
    """
    key = ["family", "subfamily"]
    role = F.col("role")
    asked = rules.groupBy(*key).agg(F.count_if(role == "binding").alias("_asked"), F.max(role == "auxiliary").alias("_needs")).filter("_asked > 0")
    in_range = F.col("n").between(F.col("low"), F.col("high"))
    # One aggregate over the rows that a rule touches, in place of a join for each role.
    touched = counts.join(rules, "domain").groupBy("query_id", *key).agg(
        F.count_if((role == "binding") & in_range).alias("_met"), F.max(role == "forbidden").alias("_barred"), F.max(role == "auxiliary").alias("_aux"))
    judged = touched.join(asked, key).filter("_met = _asked AND NOT _barred")
    specific = F.col("_aux") | ~F.col("_needs")
    # A family without its subfamily stands unless a rule of that family with an auxiliary domain was met.
    votes = F.array(
        F.struct(F.when(specific, F.col("subfamily")).otherwise(F.col("family")).alias("family"), specific.alias("_specific"), F.lit(False).alias("_over")),
        F.when(F.col("_aux"), F.struct(F.col("family"), F.lit(None).cast("boolean").alias("_specific"), F.lit(True).alias("_over"))))
    named = judged.select("query_id", F.explode(F.filter(votes, lambda v: v.isNotNull())).alias("v")).select("query_id", "v.*")
    told = named.groupBy("query_id", "family").agg(F.max("_specific").alias("_specific"), F.max("_over").alias("_over"))
    return told.filter("_specific OR (_specific IS NOT NULL AND NOT _over)").select("query_id", "family")


def family_by_domain(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """(query_id, family, domain) from a (domain, family) table."""
    return counts.select("query_id", "domain").distinct().join(lookup, "domain")


def best_hits(hits: DataFrame, organism: str) -> DataFrame:
    """One hit per query: the first of the asked organism, else the first; hits carry hit_order."""
    mine = F.lower("organism") == organism.lower()
    w = W.partitionBy("query_id").orderBy(F.when(mine, 0).otherwise(1), "hit_order")
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def family_report(families: DataFrame, domains: DataFrame, best: DataFrame) -> DataFrame:
    """Families with domain scores (best per query and domain) and the best hit, or None and -1."""
    scores = domains.groupBy("query_id", "domain").agg(F.max("score").alias("score"))
    out = families.join(scores, ["query_id", "domain"], "left").join(best.select("query_id", "hit_id", "identity"), "query_id", "left")
    return out.select(
        "query_id", "family", "domain", "score", F.coalesce(F.col("hit_id").cast("string"), F.lit("None")).alias("hit_id"),
        F.coalesce("identity", F.lit(-1.0)).alias("identity"),
    )


def biomarker_labels(metrics: DataFrame, cutoffs: dict[str, tuple[float, str]]) -> DataFrame:
    """(sample, metric, value) with the report name where the value reaches the cutoff of its metric."""
    label = F.lit("")
    for metric, (cutoff, name) in cutoffs.items():
        label = F.when((F.col("metric") == metric) & (F.col("value") >= cutoff), name).otherwise(label)
    return metrics.withColumn("report_name", label)


def query_list(*parts: DataFrame) -> DataFrame:
    """All report names of a sample that are not empty."""
    out = None
    for df in parts:
        named = df.select("sample", F.col("report_name").alias("name")).filter("name <> ''")
        out = named if out is None else out.union(named)
    return out.distinct()
