"""Expression matrix queries: normalisation, filters, aggregates, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.operators import expression as ex
from helixframe.plans import bindings as b
from helixframe.plans.bindings import COUNTS, GROUPS, LENGTHS
from helixframe.plans.registry import Suite
from helixframe.sources import lines

suite = Suite()
query = suite.query
N_SAMPLES = 8


def r(name, places=4):
    return F.round(name, places).alias(name)


@query("M01_fpkm", f"""WITH {COUNTS}, {LENGTHS}
SELECT gene, sample, round(value / length / sum(value) OVER (PARTITION BY sample) * 1e9, 4) AS fpkm
FROM counts JOIN lengths USING (gene)""")
def _(t):
    return ex.fpkm(b.counts(t), b.lengths(t)).select("gene", "sample", r("fpkm"))


TPM = f"""{COUNTS}, {LENGTHS}, tpm AS (
SELECT gene, sample, (value / length) / sum(value / length) OVER (PARTITION BY sample) * 1e6 AS value
FROM counts JOIN lengths USING (gene))"""


@query("M02_tpm", f"WITH {TPM} SELECT gene, sample, round(value, 4) AS tpm FROM tpm")
def _(t):
    return ex.tpm(b.counts(t), b.lengths(t)).select("gene", "sample", r("tpm"))


@query("M03_guarded_abundance", f"""WITH {COUNTS}, {LENGTHS},
u AS (SELECT c.*, length + 1 AS len FROM counts c JOIN lengths USING (gene) WHERE length + 1 > 149),
s AS (SELECT *, value / sum(value) OVER (PARTITION BY sample) AS share FROM u),
d AS (SELECT sample, sum(value) - CASE WHEN sum(CASE WHEN share >= 0.0008 THEN value ELSE 0 END) >= 1
  THEN sum(CASE WHEN share >= 0.0008 THEN value ELSE 0 END) ELSE 0 END AS kept, sum(value / len) AS rates FROM s GROUP BY 1)
SELECT gene, sample, round(value / len / kept * 1e9, 4) AS fpkm, round(value / len / rates * 1e6, 4) AS tpm
FROM u JOIN d USING (sample)""")
def _(t):
    return ex.guarded_abundance(b.counts(t), b.lengths(t), dominant_share=0.0008).select("gene", "sample", r("fpkm"), r("tpm"))


@query("M04_size_factors", f"""WITH {COUNTS},
l AS (SELECT gene, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY gene) AS ratio,
  count(*) OVER (PARTITION BY gene) AS n FROM counts WHERE value > 0)
SELECT sample, round(exp(median(ratio)), 6) AS size_factor FROM l WHERE n = 8 GROUP BY 1""")
def _(t):
    return ex.size_factors(b.counts(t), N_SAMPLES).select("sample", r("size_factor", 6))


@query("M05_saturation", f"""WITH {TPM},
f AS (SELECT gene, value AS ref FROM tpm WHERE sample = 's0' AND value >= 0.1),
q AS (SELECT min(ref) a, quantile_cont(ref, 0.25) b, quantile_cont(ref, 0.5) c, quantile_cont(ref, 0.75) d, max(ref) e FROM f),
z AS (SELECT 'Q1' AS stratum, a AS lo, b AS hi FROM q UNION ALL SELECT 'Q2', b, c FROM q
  UNION ALL SELECT 'Q3', c, d FROM q UNION ALL SELECT 'Q4', d, e FROM q)
SELECT sample, stratum, count(*) AS n, round(avg(abs((value / ref - 1) * 100)), 4) AS mean_error
FROM tpm JOIN f USING (gene) JOIN z ON ref BETWEEN lo AND hi GROUP BY 1, 2""")
def _(t):
    values = ex.tpm(b.counts(t), b.lengths(t)).withColumnRenamed("tpm", "value")
    return ex.saturation(values, "s0").groupBy("sample", "stratum").agg(
        F.count("*").alias("n"), F.round(F.avg("error"), 4).alias("mean_error")
    )


@query("F03_expressed_filter", f"""WITH {COUNTS}
SELECT gene, sample, value FROM counts WHERE gene IN
  (SELECT gene FROM counts GROUP BY 1 HAVING count(*) FILTER (WHERE value > 100) >= 2)""")
def _(t):
    return ex.keep_expressed(b.counts(t), 100, N_SAMPLES)


@query("F04_variability_filter", f"""WITH {COUNTS}
SELECT gene, sample, value FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1
  HAVING sum(value) >= 300 AND count(*) FILTER (WHERE value > 50) >= 8 / 3.0 AND stddev_samp(value) / avg(value) > 0.5)""")
def _(t):
    return ex.keep_variable(b.counts(t), 300, 50, 0.5, N_SAMPLES)


@query("F05_common_genes", f"""WITH {COUNTS}, {GROUPS}
SELECT gene FROM counts WHERE value > 0 AND sample IN (SELECT sample FROM groups WHERE grp = 'g0')
GROUP BY 1 HAVING count(DISTINCT sample) = 4""")
def _(t):
    members = b.groups(t).filter("grp = 'g0'").select("sample")
    return ex.common_genes(b.counts(t), members, 4)


@query("F06_short_genes", f"""WITH {COUNTS}, {LENGTHS}
SELECT gene, sample, value, length + 1 AS eff_length FROM counts JOIN lengths USING (gene) WHERE length + 1 > 149""")
def _(t):
    return ex.drop_short(b.counts(t), b.lengths(t))


def _versioned(t):
    return t.part.select(
        F.concat_ws("", F.lit("G"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("_x")).alias("id"),
        F.col("p_retailprice").alias("price"),
    )


_VERSIONED = "v AS (SELECT 'G' || p_partkey || '.' || p_size || '_x' AS id, p_retailprice AS price, p_partkey FROM part)"


@query("F07_by_gene_list", f"""WITH {_VERSIONED}
SELECT id, price, TRUE AS listed FROM v WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
UNION ALL SELECT id, price, FALSE FROM v WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def _(t):
    targets = t.lineitem.filter("l_quantity > 49").select(F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("g"))
    v = _versioned(t)
    return ex.by_gene_list(v, "id", targets).withColumn("listed", F.lit(True)).union(
        ex.by_gene_list(v, "id", targets, exclude=True).withColumn("listed", F.lit(False))
    )


@query("F20_both_expressed", f"""WITH {COUNTS}
SELECT c.gene, c.sample, c.value, f.value AS ref FROM counts c JOIN counts f ON c.gene = f.gene AND f.sample = 's0'
WHERE c.sample <> 's0' AND c.value * f.value > 0""")
def _(t):
    return ex.both_positive(b.counts(t), "s0")


@query("F21_density_input", f"""WITH {COUNTS}
SELECT gene, sample, round(log2(value + 0.01), 4) AS log_value FROM counts
WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING avg(value) >= 80)""")
def _(t):
    return ex.density_input(b.counts(t), 80).select("gene", "sample", r("log_value"))


@query("A01_describe", f"""WITH {COUNTS}
SELECT sample, count(*) AS "count", round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min,
  round(quantile_cont(value, 0.25), 4) AS q1, round(median(value), 4) AS median, round(quantile_cont(value, 0.75), 4) AS q3,
  max(value) AS max, sum(value) AS total FROM counts GROUP BY 1""")
def _(t):
    c = b.counts(t)
    totals = c.groupBy("sample").agg(F.sum("value").alias("total"))
    return ex.describe(c, ["sample"]).join(totals, "sample").select(
        "sample", "count", r("mean"), r("std"), "min", r("q1"), r("median"), r("q3"), "max", "total"
    )


@query("A02_gene_rollup", """SELECT p_brand AS gene, 's' || CAST(l_suppkey % 8 AS VARCHAR) AS sample, sum(l_quantity) AS value
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def _(t):
    transcripts = b.counts(t).withColumnRenamed("gene", "transcript")
    t2g = t.part.select(F.col("p_partkey").alias("transcript"), F.col("p_brand").alias("gene"))
    return ex.rollup_to_gene(transcripts, t2g)


@query("A03_group_means", f"""WITH {COUNTS}, {GROUPS}
SELECT gene, grp, round(avg(value), 4) AS mean_value FROM counts JOIN groups USING (sample) GROUP BY 1, 2""")
def _(t):
    return ex.group_means(b.counts(t), b.groups(t)).select("gene", "grp", r("mean_value"))


@query("A04_expressed_per_sample", f"""WITH {COUNTS}
SELECT sample, count(*) FILTER (WHERE value > 120) AS expressed FROM counts GROUP BY 1""")
def _(t):
    return ex.expressed_per_sample(b.counts(t), 120)


# The part types stand in for biotypes.
_TYPE_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'protein_coding' WHEN 'STANDARD' THEN 'lincRNA' WHEN 'PROMO' THEN 'processed_pseudogene'
 WHEN 'SMALL' THEN 'miRNA' ELSE p_type END"""


def _biotype():
    part_type = F.col("p_type")
    return (
        F.when(part_type == "ECONOMY", "protein_coding").when(part_type == "STANDARD", "lincRNA")
        .when(part_type == "PROMO", "processed_pseudogene").when(part_type == "SMALL", "miRNA").otherwise(part_type)
    )


_CATEGORY_SQL = """CASE WHEN d LIKE '%pseudogene' THEN 'pseudogene' WHEN d = 'lincRNA' THEN 'lncRNA' WHEN d = 'miRNA' THEN 'miRNA'
 WHEN d = 'protein_coding' THEN 'protein_coding' ELSE 'other' END"""


@query("R08_biotype", f"SELECT p_partkey AS gene, {_CATEGORY_SQL} AS category FROM (SELECT p_partkey, {_TYPE_SQL} AS d FROM part)")
def _(t):
    return t.part.select(F.col("p_partkey").alias("gene"), ex.biotype_category(_biotype()).alias("category"))


_CATS = ["protein_coding", "lncRNA", "pseudogene", "miRNA", "other"]


@query("A05_detected_by_type", f"""WITH {COUNTS},
k AS (SELECT p_partkey AS gene, {_CATEGORY_SQL} AS category FROM (SELECT p_partkey, {_TYPE_SQL} AS d FROM part)),
m AS (SELECT sample, count(DISTINCT gene) AS markers FROM counts WHERE value >= 60 AND gene IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY 1),
w AS (SELECT sample, {", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in _CATS)}
FROM counts JOIN k USING (gene) WHERE value >= 60 GROUP BY 1)
SELECT w.*, coalesce(markers, 0) AS markers FROM w LEFT JOIN m USING (sample)""")
def _(t):
    types = t.part.select(F.col("p_partkey").alias("gene"), ex.biotype_category(_biotype()).alias("category"))
    markers = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("gene"))
    c = b.counts(t)
    return ex.detected_by_type(c, types, _CATS, 60).join(ex.detected_markers(c, markers, 60), "sample")


@query("A18_metagene_score", f"""WITH {COUNTS}, {b.TERMS}
SELECT term AS metagene, sample, count(*) AS n_members, round(exp(avg(ln(value))), 4) AS score
FROM counts JOIN terms USING (gene) GROUP BY 1, 2""")
def _(t):
    members = b.gene_terms(t).withColumnRenamed("term", "metagene")
    return ex.metagene_score(b.counts(t), members).select("metagene", "sample", "n_members", r("score"))


@query("A25_box_stats", f"""WITH {COUNTS}, {GROUPS},
q AS (SELECT grp, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3,
 min(value) AS lo, max(value) AS hi FROM counts JOIN groups USING (sample) GROUP BY 1),
f AS (SELECT grp, n, q1, median, q3, greatest(lo, q1 - 1.5 * (q3 - q1)) AS lower, least(hi, q3 + 1.5 * (q3 - q1)) AS upper FROM q),
o AS (SELECT grp, count(*) AS outliers FROM counts JOIN groups USING (sample) JOIN f USING (grp) WHERE value > upper OR value < lower GROUP BY 1)
SELECT grp, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper,
 coalesce(outliers, 0) AS outliers FROM f LEFT JOIN o USING (grp)""")
def _(t):
    df = b.counts(t).join(b.groups(t), "sample")
    out = ex.box_outliers(df, ["grp"]).groupBy("grp").agg(F.count("*").alias("outliers"))
    return ex.box_stats(df, ["grp"]).join(out, "grp", "left").select(
        "grp", "n", r("q1"), r("median"), r("q3"), r("lower"), r("upper"), F.coalesce("outliers", F.lit(0)).alias("outliers")
    )


@query("A26_group_sizes", """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, n, round((SELECT avg(n) FROM s), 4) AS mean_n FROM s""")
def _(t):
    return ex.group_sizes(t.documents, "lang").select("lang", "n", r("mean_n"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("A27_fraction_table", f"""SELECT user_id, {", ".join(f"round(coalesce(sum(value) FILTER (WHERE event_type = '{c}'), 0), 4) AS \"{c}\"" for c in _TYPES)},
 round(sum(value), 4) AS row_total FROM events GROUP BY 1""")
def _(t):
    wide = ex.fraction_table(t.events, "user_id", "event_type", "value", _TYPES)
    return wide.select("user_id", *[r(c) for c in [*_TYPES, "row_total"]])


@query("A28_two_factor_box", """SELECT lang, source, count(*) AS n, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(median(n_chars), 4) AS median,
 round(quantile_cont(n_chars, 0.75), 4) AS q3 FROM documents GROUP BY 1, 2""")
def _(t):
    return ex.box_stats(t.documents, ["lang", "source"], "n_chars").select("lang", "source", "n", r("q1"), r("median"), r("q3"))


@query("A29_centred_group_means", f"""WITH {COUNTS}, {GROUPS},
c AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS v FROM counts)
SELECT gene, grp, round(avg(v), 4) + 0.0 AS centred_mean FROM c JOIN groups USING (sample) GROUP BY 1, 2""")
def _(t):
    df = ex.centred_group_means(b.counts(t), b.groups(t))
    return df.select("gene", "grp", (F.round("centred_mean", 4) + 0.0).alias("centred_mean"))


@query("A23_repeat_instability", """WITH reads AS (SELECT l_partkey % 50 AS site, l_linenumber AS repeats FROM lineitem),
s AS (SELECT site, repeats, count(*) AS n FROM reads GROUP BY 1, 2),
k AS (SELECT *, 3 + site % 2 AS expected FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS tot FROM s) WHERE n > floor(tot * 0.01) + 1),
g AS (SELECT site, CAST(sum(n) AS BIGINT) AS reads, sum(CASE WHEN repeats <> expected THEN n ELSE 0 END) / sum(n) AS alt,
 sum(CASE WHEN repeats > expected THEN n ELSE 0 END) / sum(n) + 1e-3 AS ins, sum(CASE WHEN repeats < expected THEN n ELSE 0 END) / sum(n) AS dele,
 sum(repeats * n) / sum(n) AS mean_len, sum(repeats * n) AS s1, sum(repeats * repeats * n) AS s2,
 string_agg(lpad(CAST(repeats AS VARCHAR), 4, '0') || ':' || n, ',' ORDER BY repeats) AS distribution FROM k GROUP BY 1)
SELECT site, reads, round(alt, 4) AS alt, round(mean_len, 4) AS mean_len, distribution, round(dele / ins, 2) AS bias,
 round(sqrt((s2 - CAST(s1 AS DOUBLE) * s1 / reads) / (reads - 1)), 4) AS sd_len,
 CASE WHEN alt >= 0.1 AND round(dele / ins, 2) >= CASE WHEN alt > 0.1 AND alt <= 0.13 THEN 2 WHEN alt > 0.13 AND alt <= 0.2 THEN 1.8 ELSE 1.5 END
  THEN 'yes' ELSE 'no' END AS unstable FROM g WHERE reads > 30""")
def _(t):
    reads = t.lineitem.select((F.col("l_partkey") % 50).alias("site"), F.col("l_linenumber").alias("repeats"))
    sites = t.part.select((F.col("p_partkey") % 50).alias("site")).distinct().withColumn("expected", 3 + F.col("site") % 2)
    return ex.repeat_instability(reads, sites).select(
        "site", "reads", r("alt"), r("mean_len"), "distribution", "bias", r("sd_len"), "unstable"
    )


@query("A23_instability_status", """SELECT count(*) FILTER (WHERE unstable = 'yes') AS unstable_sites, count(*) AS all_sites, CASE WHEN round(count(*) FILTER (WHERE unstable = 'yes') / count(*), 2) >= 0.2 THEN 'MSI:High' ELSE 'MSI:Stable' END AS status FROM (WITH reads AS (SELECT l_partkey % 50 AS site, l_linenumber AS repeats FROM lineitem),
s AS (SELECT site, repeats, count(*) AS n FROM reads GROUP BY 1, 2),
k AS (SELECT *, 3 + site % 2 AS expected FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS tot FROM s) WHERE n > floor(tot * 0.01) + 1),
g AS (SELECT site, CAST(sum(n) AS BIGINT) AS reads, sum(CASE WHEN repeats <> expected THEN n ELSE 0 END) / sum(n) AS alt,
 sum(CASE WHEN repeats > expected THEN n ELSE 0 END) / sum(n) + 1e-3 AS ins, sum(CASE WHEN repeats < expected THEN n ELSE 0 END) / sum(n) AS dele,
 sum(repeats * n) / sum(n) AS mean_len, sum(repeats * n) AS s1, sum(repeats * repeats * n) AS s2,
 string_agg(lpad(CAST(repeats AS VARCHAR), 4, '0') || ':' || n, ',' ORDER BY repeats) AS distribution FROM k GROUP BY 1)
SELECT site, reads, round(alt, 4) AS alt, round(mean_len, 4) AS mean_len, distribution, round(dele / ins, 2) AS bias,
 round(sqrt((s2 - CAST(s1 AS DOUBLE) * s1 / reads) / (reads - 1)), 4) AS sd_len,
 CASE WHEN alt >= 0.1 AND round(dele / ins, 2) >= CASE WHEN alt > 0.1 AND alt <= 0.13 THEN 2 WHEN alt > 0.13 AND alt <= 0.2 THEN 1.8 ELSE 1.5 END
  THEN 'yes' ELSE 'no' END AS unstable FROM g WHERE reads > 30)""")
def _(t):
    reads = t.lineitem.select((F.col("l_partkey") % 50).alias("site"), F.col("l_linenumber").alias("repeats"))
    sites = t.part.select((F.col("p_partkey") % 50).alias("site")).distinct().withColumn("expected", 3 + F.col("site") % 2)
    return ex.instability_status(ex.repeat_instability(reads, sites))


@query("A07_length_histogram", """WITH h AS (SELECT length(text) AS length, count(*) AS number FROM documents GROUP BY 1),
c AS (SELECT *, sum(number) OVER (ORDER BY number DESC, length ROWS UNBOUNDED PRECEDING) AS run,
 row_number() OVER (ORDER BY number DESC, length) AS rank, sum(number) OVER () AS total FROM h)
SELECT length, number, rank, round(number / total, 6) AS ratio, round(run / total, 6) AS cum_ratio, (run - number) / total < 0.999 AS shown FROM c""")
def _(t):
    return ex.length_histogram(t.documents, "text").select("length", "number", "rank", r("ratio", 6), r("cum_ratio", 6), "shown")


@query("M09_reference_agreement", f"""WITH {COUNTS}, {GROUPS},
ref AS (SELECT gene, avg(value) AS ref FROM counts WHERE sample IN (SELECT sample FROM groups WHERE grp = 'g0') GROUP BY 1)
SELECT sample, count(*) AS n, round(corr(value, ref), 4) AS corr, round(avg(abs(value - ref) / ref), 4) AS mean_deviation
FROM counts JOIN ref USING (gene) WHERE sample NOT IN (SELECT sample FROM groups WHERE grp = 'g0') AND value * ref > 0 GROUP BY 1""")
def _(t):
    refs = b.groups(t).filter("grp = 'g0'").select("sample")
    return ex.reference_agreement(b.counts(t), refs).select("sample", "n", r("corr"), r("mean_deviation"))


@query("M10_outlier_samples", f"""WITH {COUNTS},
q AS (SELECT gene, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM counts GROUP BY 1),
f AS (SELECT gene, greatest(lo, q1 - 0.8 * (q3 - q1)) AS l, least(hi, q3 + 0.8 * (q3 - q1)) AS u FROM q),
h AS (SELECT sample, count(*) AS hits FROM counts JOIN f USING (gene) WHERE value < l OR value > u GROUP BY 1)
SELECT sample, coalesce(hits, 0) AS hits, coalesce(hits, 0) >= 2 AS flagged FROM (SELECT DISTINCT sample FROM counts) LEFT JOIN h USING (sample)""")
def _(t):
    return ex.outlier_samples(b.counts(t), k=0.8)


@query("X23_capped_deviation", f"""WITH {COUNTS}, {GROUPS},
ref AS (SELECT gene, avg(value) AS ref FROM counts WHERE sample IN (SELECT sample FROM groups WHERE grp = 'g0') GROUP BY 1),
d AS (SELECT gene, sample, abs(value - ref) / ref AS deviation FROM counts JOIN ref USING (gene)
 WHERE sample NOT IN (SELECT sample FROM groups WHERE grp = 'g0') AND value * ref > 0),
q AS (SELECT sample, quantile_cont(deviation, 0.75) + 2 * (quantile_cont(deviation, 0.75) - quantile_cont(deviation, 0.25)) AS c FROM d GROUP BY 1)
SELECT gene, sample, round(least(deviation, c), 4) AS deviation FROM d JOIN q USING (sample)""")
def _(t):
    refs = b.groups(t).filter("grp = 'g0'").select("sample")
    return ex.capped_deviation(b.counts(t), refs).select("gene", "sample", r("deviation"))


@query("X08_log_values", f"""WITH {COUNTS}
SELECT gene, sample, round(log2(value + 1), 4) AS l2, round(log10(value + 1), 4) AS l10, round(ln(value + 1), 4) AS le FROM counts""")
def _(t):
    c = b.counts(t)
    for base, name in (("2", "l2"), ("10", "l10"), ("e", "le")):
        c = ex.log_values(c, base).withColumnRenamed("log_value", name)
    return c.select("gene", "sample", r("l2"), r("l10"), r("le"))


@query("W01_top_ranked", f"""WITH {COUNTS},
k AS (SELECT gene, rank() OVER (PARTITION BY sample ORDER BY value DESC) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS rk FROM counts)
SELECT gene, count(*) FILTER (WHERE rk <= 500) AS n_top FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE rk <= 500) >= 6""")
def _(t):
    return ex.top_ranked(b.counts(t), 500, 0.75, 0, N_SAMPLES)


@query("W02_top_share", f"""WITH {COUNTS},
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) AS place, sum(value) OVER (PARTITION BY sample) AS total FROM counts)
SELECT sample, gene, CAST(place AS INTEGER) AS place, round(value / total, 6) AS share FROM k WHERE place <= 50""")
def _(t):
    return ex.top_share(b.counts(t), 50).select("sample", "gene", "place", r("share", 6))


@query("W03_explaining_components", f"""WITH {COUNTS},
w AS (SELECT sample, value, sum(value) OVER (PARTITION BY sample ORDER BY value DESC) AS run, count(*) OVER (PARTITION BY sample ORDER BY value DESC) AS upto,
 sum(value) OVER (PARTITION BY sample) AS total FROM counts)
SELECT sample, greatest(min(upto), 2) AS n_components FROM w WHERE run >= 0.95 * total GROUP BY 1""")
def _(t):
    return ex.components_to_explain(b.counts(t), ["sample"], 0.95)


@query("W04_zscore", f"""WITH {COUNTS}
SELECT gene, sample, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w < 1e-12 THEN 1 ELSE stddev_pop(value) OVER w END, 4) + 0.0 AS z
FROM counts WINDOW w AS (PARTITION BY gene)""")
def _(t):
    return ex.zscore(b.counts(t), "gene").select("gene", "sample", (F.round("z", 4) + 0.0).alias("z"))


@query("W07_first_per_key", """SELECT l_orderkey AS key, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS first_part FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part")
    )


@query("T01_sort", "SELECT gene, sample, value FROM (WITH " + COUNTS + " SELECT * FROM counts) ORDER BY value DESC, gene, sample")
def _(t):
    return b.counts(t).orderBy(F.desc("value"), "gene", "sample")


@query("T02_top_by_mean", f"""WITH {COUNTS} SELECT gene, round(avg(value), 4) AS mean_value FROM counts GROUP BY 1 ORDER BY avg(value) DESC, gene LIMIT 100""")
def _(t):
    return ex.top_by_mean(b.counts(t), 100).select("gene", r("mean_value"))


@query("T07_natural_order", """SELECT l_linenumber AS grp, CAST(floor(l_quantity) AS BIGINT) AS pos, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 DESC""")
def _(t):
    spots = t.lineitem.groupBy(F.col("l_linenumber").alias("grp"), F.floor("l_quantity").alias("pos")).agg(F.count("*").alias("n"))
    return spots.orderBy("grp", F.desc("pos"))


@query("W06_forward_fill", """SELECT o_custkey % 3 AS path, o_orderkey AS line_no, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) AS header FROM orders""")
def _(t):
    rows = t.orders.select((F.col("o_custkey") % 3).alias("path"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("value"))
    return lines.last_seen(rows, F.col("value") == "F", "header").select("path", "line_no", "header")
