"""Variant filters, summaries and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# Filter labels that reject a paired call.
REJECTED_FILTERS = ["strand_bias", "germline", "weak_evidence"]
# Population frequency columns.
POPULATIONS = ["esp6500siv2_all", "1000g2015aug_all", "ExAC_ALL", "gnomAD_exome_ALL", "gnomAD_exome_EAS", "ExAC_EAS"]


def numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def gt_sum(gt: Column) -> Column:
    return F.aggregate(F.split(gt, r"[/|]"), F.lit(0), lambda acc, x: acc + F.coalesce(x.try_cast("int"), F.lit(0)))


def paired_pass(tumour: str, normal: str, filters: str) -> Column:
    """Tumour/normal call filter; `tumour` and `normal` are (AF, AD) text struct columns."""
    t_af, n_af = F.array_max(numbers(F.col(f"{tumour}.AF"))), F.array_max(numbers(F.col(f"{normal}.AF")))
    reads = numbers(F.col(f"{tumour}.AD"))
    depth = F.aggregate(reads, F.lit(0.0), lambda a, x: a + x)
    labels = F.split(F.lower(filters), ";")
    return (
        (t_af >= 0.05) & (t_af / (n_af + 1e-5) >= 5) & (depth >= 20)
        & (F.array_max(F.slice(reads, 2, F.size(reads))) >= 3)
        & ~F.arrays_overlap(labels, F.array(*[F.lit(x) for x in REJECTED_FILTERS]))
    )


def order_pair(df: DataFrame, first: str, second: str) -> DataFrame:
    """Add `tumour` and `normal`: the sample without alternative alleles is the normal one."""
    one, two = gt_sum(F.col(f"{first}.GT")), gt_sum(F.col(f"{second}.GT"))
    return df.withColumn("tumour", F.when(one == 0, F.col(second)).otherwise(F.col(first))).withColumn(
        "normal", F.when(one == 0, F.col(first)).otherwise(F.col(second))
    ).filter(one + two > 0)


def filter_paired(df: DataFrame, first: str, second: str, filters: str = "filter") -> DataFrame:
    return order_pair(df, first, second).filter(paired_pass("tumour", "normal", filters))


def by_af(df: DataFrame, af: float) -> DataFrame:
    return df.filter(F.col("af") >= af)


def by_two_tier_af(df: DataFrame, af: float, not_hot_af: float) -> DataFrame:
    return df.filter((F.col("af") >= af) & (F.col("is_hotspot") | (F.col("af") >= not_hot_af)))


def rare(columns: Sequence[str], threshold: float) -> Column:
    """No population frequency above the threshold; '.' is no frequency."""
    return reduce(
        lambda a, b: a & b, [F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) <= threshold for c in columns]
    )


def germline(df: DataFrame, targets: DataFrame, populations: Sequence[str] = POPULATIONS) -> DataFrame:
    """Pathogenic by expert panel, or rare and not intronic; in a target gene with an AF of 0.2 at least.

    Columns: gene, clnsig, clnrevstat, func, af_text and the population columns.
    """
    inside = df.join(targets.select(F.col(targets.columns[0]).alias("gene")).distinct(), "gene", "left_semi")
    strong = F.exists(numbers(F.col("af_text")), lambda x: x >= 0.2)
    known = F.lower("clnsig").contains("pathogenic") & (F.col("clnrevstat") == "reviewed_by_expert_panel")
    return inside.filter(strong & (known | ((F.col("func") != "intronic") & rare(populations, 0.01))))


def plain_bases(df: DataFrame, max_length: int) -> DataFrame:
    """Variants without N whose alleles are not too long."""
    return df.filter(
        ~F.col("ref").rlike("(?i)n") & ~F.col("alt").rlike("(?i)n")
        & (F.length("ref") <= max_length) & (F.length("alt") <= max_length)
    )


CLAUSE_COLUMNS = {
    "r": "chrom", "s": "start", "g": "gene", "t": "transcript", "e": "exon", "c": "chgvs", "p": "phgvs",
}


def parse_clauses(lines: DataFrame) -> DataFrame:
    """(clause, chrom, start, gene, transcript, exon, chgvs, phgvs) of `g=…;t=…` lines; transcripts lose their version."""
    keyed = F.str_to_map(F.regexp_replace("value", r"\s", ""), F.lit(";"), F.lit("="))
    cols = [F.try_element_at(keyed, F.lit(k)).alias(n) for k, n in CLAUSE_COLUMNS.items()]
    parsed = lines.select(F.col("value").alias("clause"), *cols)
    return parsed.withColumn("transcript", F.split("transcript", r"\.")[0])


def match_clauses(annotations: DataFrame, clauses: DataFrame) -> DataFrame:
    """Annotations that meet every given key of a clause, with the clause.

    An annotation takes a row for each key set in use, at most 127, that it has all keys of; one join on key set and
    key text then serves all clauses.
    """
    names = list(CLAUSE_COLUMNS.values())
    keyed = clauses.withColumn("_keys", F.concat_ws(",", *[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]))
    sets = sorted(r[0] for r in keyed.select("_keys").distinct().collect() if r[0])
    if not sets:
        return annotations.withColumn("clause", F.lit(None).cast("string")).limit(0)

    def text(keys: str) -> Column:
        given = [F.col(c).cast("string") for c in keys.split(",")]
        whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in given])
        return F.when(whole, F.concat_ws("\u0001", *given))

    entries = [F.struct(F.lit(k).alias("set"), text(k).alias("key")) for k in sets]
    own = annotations.withColumn("_e", F.explode(F.filter(F.array(*entries), lambda e: e["key"].isNotNull())))
    asked = F.coalesce(*[F.when(F.col("_keys") == k, text(k)) for k in sets])
    wanted = keyed.filter(F.col("_keys") != "").select("clause", F.struct(F.col("_keys").alias("set"), asked.alias("key")).alias("_e"))
    return own.join(wanted, "_e").select(*annotations.columns, "clause")


def unmatched_clauses(annotations: DataFrame, clauses: DataFrame) -> DataFrame:
    return clauses.join(match_clauses(annotations, clauses).select("clause").distinct(), "clause", "left_anti")


def field_ranges(fields: DataFrame) -> DataFrame:
    """Filter template per (field, place): one row with the numeric range, or one row for each category, however many.

    `fields` is (field, value) with comma lists; '.' is no value. `n` counts the distinct values.
    """
    values = fields.select("field", F.posexplode(F.split("value", ",")).alias("place", "one")).filter("one <> '.'")
    distinct = values.distinct().withColumn("number", F.col("one").try_cast("double"))
    stats = distinct.groupBy("field", "place").agg(
        F.count("*").alias("n"), F.count("number").alias("n_numbers"), F.min("number").alias("low"), F.max("number").alias("high")
    )
    ranges = stats.filter("n = n_numbers").select("field", "place", F.lit("range").alias("kind"), "low", "high", F.lit(None).cast("string").alias("category"), "n")
    none = F.lit(None).cast("double")
    categories = distinct.join(stats.filter("n <> n_numbers").select("field", "place", "n"), ["field", "place"]).select(
        "field", "place", F.lit("category").alias("kind"), none.alias("low"), none.alias("high"), F.col("one").alias("category"), "n")
    return ranges.union(categories)


def filter_template(ranges: DataFrame, most: int = 100) -> DataFrame:
    """(field, place, text): the template as it is shown. Categories of a field with more than `most` are named by their
    number; all of them are rows of `field_ranges`."""
    few = ranges.filter((F.col("kind") == "category") & (F.col("n") <= most))
    lists = few.groupBy("field", "place").agg(F.array_join(F.array_sort(F.collect_list("category")), "|").alias("text"))
    many = ranges.filter((F.col("kind") == "category") & (F.col("n") > most)).select(
        "field", "place", F.concat(F.col("n").cast("string"), F.lit(" categories")).alias("text")).distinct()
    numeric = ranges.filter("kind = 'range'").select("field", "place", F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")).alias("text"))
    return numeric.union(lists).union(many)


def annotated_only(df: DataFrame, key: str) -> DataFrame:
    """Records with a value under one INFO key, reduced to that key."""
    return df.filter(F.coalesce(F.col("info")[key], F.lit(".")) != ".").withColumn(
        "info", F.map_filter("info", lambda k, v: k == key)
    )


def simplified_reports(rows: DataFrame, genes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of per-sample reports (path, gene, ...) of the asked genes, with the sample from the path."""
    wanted = genes.select(F.col(genes.columns[0]).alias("gene")).distinct()
    sample = F.element_at(F.split("path", "/"), -2)
    return rows.join(wanted, "gene", "left_semi").select(sample.alias("sample"), *columns)


# --- summaries ---------------------------------------------------------------------------

def mutated_gene_table(calls: DataFrame, targets: DataFrame, samples: list[str]) -> DataFrame:
    """Passing non-synonymous calls (sample, gene) per target gene and sample, with both margins.

    The corner of the margins has no meaning and is null.
    """
    wanted = targets.select(F.col(targets.columns[0]).alias("gene")).distinct()
    wide = calls.groupBy("gene").pivot("sample", samples).count()
    table = wanted.join(wide, "gene", "left").fillna(0, samples)
    share = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in samples), F.lit(0)) / len(samples)
    body = table.withColumn("mutated_ratio", F.round(share, 3)).withColumn("gene", F.col("gene").cast("string"))
    margin = table.agg(
        *[F.round(F.count_if(F.col(s) > 0) / F.count("*"), 3).alias(s) for s in samples]
    ).select(F.lit("mutated_ratio").alias("gene"), *samples, F.lit(None).cast("double").alias("mutated_ratio"))
    return body.select("gene", *[F.col(s).cast("double").alias(s) for s in samples], "mutated_ratio").union(margin)


def change_kinds(variants: DataFrame) -> DataFrame:
    """Variants per kind and length difference."""
    diff = F.length("ref") - F.length("alt")
    kind = F.when(diff == 0, "snv").when(diff > 0, "delete").otherwise("insert")
    return variants.groupBy(kind.alias("kind"), diff.alias("length_change")).agg(F.count("*").alias("n"))


def copy_number(bins: DataFrame, amp: float = 3, loss: float = 1.2) -> DataFrame:
    """Genes whose bins all lie above the gain or all below the loss cutoff; `bins` is (gene, log2)."""
    from math import log2

    mean = F.avg("log2")
    genes = bins.filter(F.col("log2").isNotNull()).groupBy("gene").agg(
        mean.alias("mean_log2"), F.min("log2").alias("_low"), F.max("log2").alias("_high")
    )
    kept = genes.filter((F.col("_low") > log2(amp / 2)) | (F.col("_high") <= log2(loss / 2)))
    name = F.when(F.col("mean_log2") > 0, F.concat_ws(" ", "gene", F.lit("amplification"))).otherwise(
        F.concat_ws(" ", "gene", F.lit("deletion"))
    )
    return kept.select("gene", "mean_log2", F.round(F.pow(F.lit(2.0), "mean_log2") * 2, 2).alias("copies"), name.alias("event"))


def report_copy_number(events: DataFrame, known_events: DataFrame, other_genes: DataFrame) -> DataFrame:
    known = known_events.select(F.col(known_events.columns[0]).alias("event")).distinct().withColumn("_k", F.lit(True))
    other = other_genes.select(F.col(other_genes.columns[0]).alias("gene")).distinct().withColumn("_o", F.lit(True))
    out = events.join(known, "event", "left").join(other, "gene", "left")
    return out.select(
        "gene", "mean_log2", "copies", F.when(F.col("_k"), F.col("event")).otherwise("").alias("report_name"),
        F.when(F.col("_k") | F.col("_o"), "yes").otherwise("no").alias("report"),
    )


def residue_prefixes(changes: DataFrame) -> DataFrame:
    """(gene, phgvs) to (gene, residue, pos, aa): p.E454K -> p.E454, p.E454_E457delinsG -> p.E454_E457."""
    span = F.regexp_extract("phgvs", r"^(p.[A-Z][0-9]+_[A-Z][0-9]+)", 1)
    single = F.regexp_extract("phgvs", r"^(p.[A-Z][0-9]+)", 1)
    residue = F.when(F.col("phgvs").contains("_"), span).otherwise(single)
    return changes.select("gene", "phgvs", residue.alias("residue")).filter("residue <> ''").select(
        "gene", "phgvs", "residue",
        F.regexp_extract("residue", "p.([A-Z])([0-9]+)", 2).cast("int").alias("pos"),
        F.regexp_extract("residue", "p.([A-Z])([0-9]+)", 1).alias("aa"),
    )


def residue_lists(changes: DataFrame) -> DataFrame:
    """Residues of a gene in positional order; a protein has a bounded number of residues."""
    distinct = residue_prefixes(changes).select("gene", "pos", "aa", "residue").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("pos", "aa", "residue")))
    return distinct.groupBy("gene").agg(F.array_join(F.transform(ordered, lambda x: x["residue"]), ",").alias("residues"))


def merge_variant_lists(lists: Sequence[DataFrame]) -> DataFrame:
    """Distinct (chrom, pos, ref, alt) of several lists with one chromosome naming."""
    chrom = F.concat(F.lit("chr"), F.regexp_replace("chrom", "^chr", ""))
    rows = [df.select(chrom.alias("chrom"), "pos", "ref", "alt") for df in lists]
    return reduce(DataFrame.union, rows).distinct()


def first_occurrence(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def renamed_ids(df: DataFrame) -> DataFrame:
    """(old id, id made of the variant itself) for every row."""
    return df.select("var_id", F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt").alias("new_id"))


def dedupe_hotspots(hotspots: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per site and base change: the rows on canonical transcripts (first per transcript), else the first.

    hotspots: (chrom, start, end, chgvs, phgvs, transcript, gene, line_no); canonical: (transcript).
    Of alternative changes `a|b` the longest counts, the last of equals.
    """
    options = F.split("chgvs", r"\|")
    keyed_options = F.transform(options, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))
    change = F.array_max(keyed_options)["x"]
    bases = F.regexp_extract(change, "([ATCG]+.*)", 1)
    stems = canonical.select(F.split(canonical.columns[0], r"\.")[0].alias("_stem")).distinct().withColumn("_c", F.lit(True))
    rows = hotspots.withColumn("chgvs", change).withColumn("_bases", bases).withColumn(
        "_stem", F.split("transcript", r"\.")[0]
    ).join(stems, "_stem", "left")
    key = ["chrom", "start", "end", "_bases"]
    best = rows.groupBy(*key).agg(F.count("_c").alias("_n"), F.min("line_no").alias("_first"))
    joined = rows.join(best, key)
    plain = joined.filter((F.col("_n") == 0) & (F.col("line_no") == F.col("_first")))
    chosen = joined.filter("_c")
    first = chosen.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*key, "_stem").orderBy("line_no"))
    ).filter("_rn = 1")
    return plain.select(*hotspots.columns).union(first.select(*hotspots.columns))


def tumour_is_second(calls: DataFrame) -> DataFrame:
    """Per file, whether the second sample is the tumour: its AF is not the lower one at most sites. Ties say yes."""
    first = F.count_if(F.col("af0") > F.col("af1"))
    return calls.groupBy("file").agg((F.count("*") - first >= first).alias("tumour_second"))


def recomputed_fractions(calls: DataFrame) -> DataFrame:
    """TDP, NDP, TAF and NAF from reads over depth, after the tumour column of each file is known.

    calls: (file, id, alt0, dp0, af0, alt1, dp1, af1).
    """
    joined = calls.join(tumour_is_second(calls), "file")

    def pick(a: str, b: str, swap: bool) -> Column:
        second = F.col("tumour_second") if not swap else ~F.col("tumour_second")
        return F.when(second, F.col(b)).otherwise(F.col(a))

    t_dp, n_dp = pick("dp0", "dp1", False), pick("dp0", "dp1", True)
    t_alt, n_alt = pick("alt0", "alt1", False), pick("alt0", "alt1", True)
    return joined.select(
        "file", "id", t_dp.alias("TDP"), n_dp.alias("NDP"), F.round(F.try_divide(t_alt, t_dp), 3).alias("TAF"),
        F.when(n_dp != 0, F.round(F.try_divide(n_alt, n_dp), 3)).otherwise(0.0).alias("NAF"),
    )


def purity_input(calls: DataFrame, ploidy: int = 2) -> DataFrame:
    """(ID, Allele_Freq in percent, Depth, Ploidy) of the tumour sample."""
    joined = calls.join(tumour_is_second(calls), "file")
    af = F.when(F.col("tumour_second"), F.col("af1")).otherwise(F.col("af0"))
    depth = F.when(F.col("tumour_second"), F.col("dp1")).otherwise(F.col("dp0"))
    return joined.select("file", F.col("id").alias("ID"), (af * 100).alias("Allele_Freq"), depth.alias("Depth"), F.lit(ploidy).alias("Ploidy"))


def keyed(df: DataFrame, id_mode: str) -> DataFrame:
    """`var_id` from the asked fields, such as ``transcript:chgvs``."""
    return df.withColumn("var_id", F.concat_ws(":", *[F.col(c).cast("string") for c in id_mode.split(":")]))


def extract_hotspots(calls: DataFrame, hotspots: DataFrame, excluded: DataFrame, id_mode: str) -> DataFrame:
    """Calls whose key is a hotspot and not excluded."""
    k = keyed(calls, id_mode)
    hot = keyed(hotspots, id_mode).select("var_id").distinct()
    out = keyed(excluded, id_mode).select("var_id").distinct()
    return k.join(hot, "var_id", "left_semi").join(out, "var_id", "left_anti")


def detected_hotspot_rows(variants: DataFrame, hotspots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hotspot rows that occur among the variants."""
    return hotspots.join(variants.select(*keys).distinct(), list(keys), "left_semi")
