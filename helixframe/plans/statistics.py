"""Statistics, enrichment and differential expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.functions.means import rounded_mean
from helixframe.operators import countmodel as cm
from helixframe.operators import density
from helixframe.operators import differential as de
from helixframe.operators import enrichment as en
from helixframe.operators import expression as ex
from helixframe.operators import kendall as kd
from helixframe.operators import normal as nm
from helixframe.operators import pairwise as pw
from helixframe.operators import statistics as st
from helixframe.plans import bindings as b
from helixframe.plans.bindings import COUNTS, GROUPS, TERMS
from helixframe.plans.files import s
from helixframe.plans.registry import Suite
from helixframe.session import cut_lineage

suite = Suite()
query = suite.query
SAMPLES = [f"s{i}" for i in range(8)]


def rnd(places, *names):
    return [(F.round(n, places) + 0.0).alias(n) for n in names]


# Twice the upper normal tail, by Simpson's rule; independent of the error function used here.
def _two_sided(z):
    return (f"greatest(0, 1 - 2 / sqrt(2 * pi()) * (abs({z}) / 600) / 3 * list_sum(list_transform(range(0, 601), lambda i: "
            f"(CASE WHEN i = 0 OR i = 600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs({z}) * i / 600, 2) / 2))))")


# Two-sided t tail with x = sqrt(v) tan(a), by Simpson's rule over the angle; independent of the beta function used here.
def _t_two_sided(t, v):
    top = f"atan(abs({t}) / sqrt({v}))"
    return (f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(pi()) * ({top} / 600) / 3 * list_sum(list_transform(range(0, 601), lambda i: "
            f"(CASE WHEN i = 0 OR i = 600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos({top} * i / 600), ({v}) - 1))))")


# --- correlation and distance ----------------------------------------------------------------

_PAIRS = "p AS (SELECT x.sample AS a, y.sample AS b, x.value AS x, y.value AS y FROM counts x JOIN counts y USING (gene))"


@query("M06_pearson_matrix", f"WITH {COUNTS}, {_PAIRS} SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS corr FROM p GROUP BY 1, 2")
def _(t):
    return pw.pearson_matrix(b.counts(t), SAMPLES).select("a", "b", "n", *rnd(6, "corr"))


@query("M06_spearman_matrix", f"""WITH {COUNTS}, {_PAIRS}, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS y FROM p)
SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS corr FROM r GROUP BY 1, 2""")
def _(t):
    return pw.spearman_matrix(b.counts(t), SAMPLES).select("a", "b", "n", *rnd(6, "corr"))


# Every pair of distinct points with its sign; points are pre-counted, the operator forms no pairs.
@query("M06_kendall", f"""WITH {COUNTS}, {_PAIRS}, w AS (SELECT a, b, x, y, count(*) AS n FROM p GROUP BY ALL),
q AS (SELECT i.a, i.b, sum(CAST(i.n * j.n AS DOUBLE) * sign(i.x - j.x) * sign(i.y - j.y)) AS s, sum(CAST(i.n * j.n AS DOUBLE) * abs(sign(i.x - j.x))) AS tx, sum(CAST(i.n * j.n AS DOUBLE) * abs(sign(i.y - j.y))) AS ty
 FROM w i JOIN w j ON i.a = j.a AND i.b = j.b GROUP BY 1, 2), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)
SELECT a, b, n, round(s / sqrt(tx * ty), 6) + 0.0 AS corr FROM q JOIN c USING (a, b)""")
def _(t):
    return kd.kendall_matrix(b.counts(t), SAMPLES).select("a", "b", "n", *rnd(6, "corr"))


@query("M26_distances", f"""WITH {COUNTS}, {_PAIRS} SELECT a, b, round(sqrt(sum((x - y) * (x - y))), 4) AS euclidean, round(sum(abs(x - y)), 4) AS cityblock,
 round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) + 0.0 AS cosine, round(1 - corr(x, y), 6) + 0.0 AS correlation FROM p GROUP BY 1, 2""")
def _(t):
    return pw.distances(b.counts(t), SAMPLES).select("a", "b", *rnd(4, "euclidean", "cityblock"), *rnd(6, "cosine", "correlation"))


def _gene_pairs(t):
    return t.part.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 7 % 1999).alias("target")).filter("source <> target")


_GP = f"""{COUNTS}, g AS (SELECT DISTINCT p_partkey AS source, p_partkey * 7 % 1999 AS target FROM part WHERE p_partkey <> p_partkey * 7 % 1999),
c AS (SELECT source, target, count(*) AS n, corr(x.value, y.value) AS r FROM g JOIN counts x ON x.gene = source JOIN counts y ON y.gene = target AND x.sample = y.sample GROUP BY 1, 2)"""


@query("M07_pair_correlation", f"WITH {_GP} SELECT source, target, n, round(r, 6) AS corr, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS kind FROM c WHERE r IS NOT NULL AND NOT isnan(r)")
def _(t):
    return st.pair_correlation(b.counts(t), _gene_pairs(t)).select("source", "target", "n", *rnd(6, "corr"), "kind")


@query("M07_significant_pairs", f"""WITH {_GP}, w AS (SELECT *, CASE WHEN abs(r) > 1 - 1e-12 THEN 0 ELSE {_t_two_sided('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')} END AS p FROM c WHERE n > 2 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.7)
SELECT source, target, n, round(r, 6) AS corr, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS kind, round(p, 6) + 0.0 AS p FROM w WHERE p <= 0.05""")
def _(t):
    out = st.significant_pairs(st.pair_correlation(b.counts(t), _gene_pairs(t)), 0.05, 0.7)
    return out.select("source", "target", "n", *rnd(6, "corr"), "kind", *rnd(6, "p"))


@query("M08_regulation", f"""WITH {_GP}, d AS (SELECT p_partkey AS source, p_partkey * 7 % 1999 AS target, CASE WHEN p_size % 2 = 0 THEN '-->' ELSE '--|' END AS sign FROM part WHERE p_size < 20
 UNION SELECT p_partkey * 7 % 1999, p_partkey, CASE WHEN p_size % 2 = 0 THEN '-->' ELSE '--|' END FROM part WHERE p_size > 35), e AS (SELECT source, target, max(sign) AS sign FROM d GROUP BY 1, 2)
SELECT c.source, c.target, round(r, 6) AS corr, CASE WHEN e.sign = '-->' THEN 'up' WHEN e.sign IS NOT NULL THEN 'down' WHEN f.sign = '-->' THEN 'down' WHEN f.sign IS NOT NULL THEN 'up' ELSE 'unknown' END AS regulation
FROM c LEFT JOIN e ON c.source = e.source AND c.target = e.target LEFT JOIN e f ON c.source = f.target AND c.target = f.source WHERE r IS NOT NULL AND NOT isnan(r)""")
def _(t):
    k, sign = F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "-->").otherwise("--|").alias("sign")
    other = k * 7 % 1999
    d = t.part.filter("p_size < 20").select(k.alias("source"), other.alias("target"), sign).union(t.part.filter("p_size > 35").select(other, k, sign))
    return st.with_regulation(st.pair_correlation(b.counts(t), _gene_pairs(t)), d).select("source", "target", *rnd(6, "corr"), "regulation")


@query("M14_rank_correlation", """WITH k AS (SELECT event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS b FROM k)
SELECT event_type, count(*) AS n, round(corr(a, b), 6) AS corr FROM r GROUP BY 1""")
def _(t):
    df = t.events.select("event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))
    return st.rank_correlation(df, ["event_type"], "value", "k").select("event_type", "n", *rnd(6, "corr"))


# --- group tests -----------------------------------------------------------------------------

_RANKED = """r AS (SELECT {k}, {one} AS one, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {k}, v) AS ties, count(*) OVER (PARTITION BY {k}) AS n FROM d),
u AS (SELECT {k}, count(*) FILTER (WHERE one) AS n1, count(*) FILTER (WHERE NOT one) AS n2, max(n) AS n, sum(rk) FILTER (WHERE one) AS r1, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY 1),
z AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, (greatest(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5) / nullif(sqrt(n1 * n2 / 12.0 * ((n + 1) - tie / (n * (n - 1.0)))), 0) AS z FROM u)"""


@query("M11_rank_test", f"""WITH {COUNTS}, {GROUPS}, d AS (SELECT gene, grp, value AS v FROM counts JOIN groups USING (sample)), {_RANKED.format(k='gene', one="grp = 'g0'")},
m AS (SELECT gene, median(v) FILTER (WHERE grp = 'g0') AS a, median(v) FILTER (WHERE grp = 'g1') AS b FROM d GROUP BY 1)
SELECT gene, round(u1, 4) AS u1, round(z, 6) AS z_mw, a AS ctrl_median, b AS test_median, b - a AS median_change, CASE WHEN b - a > 0 THEN 'up' ELSE 'down' END AS regulation FROM z JOIN m USING (gene) WHERE n1 > 0 AND n2 > 0""")
def _(t):
    df = b.counts(t).join(b.groups(t), "sample")
    u = st.rank_sums(df, ["gene"], "value", F.col("grp") == "g0", small_groups=True).filter("n1 > 0 AND n2 > 0")
    m = st.group_medians(df, ["gene"], "value", "grp", "g0", "g1", small_groups=True)
    return u.join(m, "gene").select("gene", *rnd(4, "u1"), *rnd(6, "z_mw"), "ctrl_median", "test_median", "median_change", "regulation")


@query("M11_p_values", f"""WITH {COUNTS}, {GROUPS}, d AS (SELECT gene, grp, value AS v FROM counts JOIN groups USING (sample)), {_RANKED.format(k='gene', one="grp = 'g0'")},
ex AS (SELECT n, bit_count(mask) AS n1, list_sum(list_transform(range(0, n), lambda i: ((mask >> i) & 1) * (i + 1))) AS rs FROM (SELECT unnest(range(2, 9)) AS n), (SELECT unnest(range(0, 256)) AS mask) WHERE mask < pow(2, n)),
eu AS (SELECT n1, n - n1 AS n2, rs - n1 * (n1 + 1) / 2.0 AS u, count(*) AS c FROM ex GROUP BY ALL),
ep AS (SELECT a.n1, a.n2, a.u, 2 * sum(b.c) FILTER (WHERE b.u >= greatest(a.u, a.n1 * a.n2 - a.u)) / sum(b.c) AS p FROM eu a JOIN eu b ON a.n1 = b.n1 AND a.n2 = b.n2 GROUP BY ALL)
SELECT gene, round(least(CASE WHEN tie = 0 THEN ep.p ELSE {_two_sided('z')} END, 1), 5) AS p FROM z LEFT JOIN ep ON z.n1 = ep.n1 AND z.n2 = ep.n2 AND z.u1 = ep.u WHERE z IS NOT NULL""")
def _(t):
    df = b.counts(t).join(b.groups(t), "sample")
    out = st.group_test(df, ["gene"], "value", "grp", "g0", "g1", small_groups=True)
    return out.filter("p IS NOT NULL").select("gene", *rnd(5, "p"))


@query("M11_t_statistics", f"""WITH {COUNTS}, {GROUPS}, a AS (SELECT gene, count(*) FILTER (WHERE grp = 'g0') AS n1, count(*) FILTER (WHERE grp = 'g1') AS n2, avg(value) FILTER (WHERE grp = 'g0') AS m1, avg(value) FILTER (WHERE grp = 'g1') AS m2,
 var_samp(value) FILTER (WHERE grp = 'g0') AS v1, var_samp(value) FILTER (WHERE grp = 'g1') AS v2 FROM counts JOIN groups USING (sample) GROUP BY 1)
SELECT gene, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 4) AS t_equal, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t_welch,
 round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df_welch FROM a WHERE n1 > 1 AND n2 > 1 AND v1 > 0 AND v2 > 0""")
def _(t):
    df = b.counts(t).join(b.groups(t), "sample")
    out = st.t_statistics(df, ["gene"], "value", F.col("grp") == "g0").filter("n1 > 1 AND n2 > 1 AND t_welch IS NOT NULL AND df_welch IS NOT NULL")
    return out.select("gene", *rnd(4, "t_equal", "t_welch", "df_welch"))


@query("M11_wilcoxon", f"""WITH {COUNTS}, w AS (SELECT gene, CAST(substr(sample, 2) AS INTEGER) // 2 AS pair, max(value) FILTER (WHERE CAST(substr(sample, 2) AS INTEGER) % 2 = 0) AS x, max(value) FILTER (WHERE CAST(substr(sample, 2) AS INTEGER) % 2 = 1) AS y FROM counts GROUP BY 1, 2),
d AS (SELECT gene, x - y AS d FROM w WHERE x <> y), r AS (SELECT gene, d, rank() OVER (PARTITION BY gene ORDER BY abs(d)) + (count(*) OVER (PARTITION BY gene, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, abs(d)) AS ties FROM d),
a AS (SELECT gene, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS wm, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY 1),
z AS (SELECT gene, (least(wp, wm) - n * (n + 1) / 4.0) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - tie / 2) / 24) AS z FROM a)
SELECT gene, round(least({_two_sided('z')}, 1), 5) AS p FROM z""")
def _(t):
    number = F.substring("sample", F.lit(2), F.length("sample")).cast("int")
    df = b.counts(t).withColumn("pair", F.floor(number / 2)).withColumn("grp", F.when(number % 2 == 0, "g0").otherwise("g1"))
    out = st.group_test(df, ["gene"], "value", "grp", "g0", "g1", "wilcoxon", small_groups=True, pair="pair")
    return out.filter("p IS NOT NULL").select("gene", *rnd(5, "p"))


@query("M11_signed_rank", """WITH d AS (SELECT l_linenumber AS k, l_tax - l_discount AS d FROM lineitem WHERE l_tax <> l_discount), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY k, abs(d)) AS ties FROM d),
a AS (SELECT k, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS wp, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS wm, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY 1)
SELECT k, n, wp AS w_plus, wm AS w_minus, round((least(wp, wm) - n * (n + 1) / 4.0) / sqrt((CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - tie / 2) / 24), 4) AS z FROM a""")
def _(t):
    df = t.lineitem.select(F.col("l_linenumber").alias("k"), "l_tax", "l_discount")
    return st.signed_rank(df, ["k"], "l_tax", "l_discount").select("k", "n", "w_plus", "w_minus", *rnd(4, "z"))


_QUALITY = "d0 AS (SELECT n_chars AS v, quality AS grp FROM documents JOIN labels USING (doc_id))"


def _quality(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("n_chars").alias("v"), F.col("quality").alias("grp"))


@query("M12_levene", f"""WITH {_QUALITY}, m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY grp)) AS z FROM d0), g AS (SELECT grp, count(*) AS n, avg(z) AS zb, sum(z) AS sz, var_pop(z) * count(*) AS ins FROM m GROUP BY 1),
a AS (SELECT sum(n) AS nn, count(*) AS k, sum(sz) / sum(n) AS zz, sum(ins) AS ins FROM g) SELECT round((nn - k) / (k - 1) * (SELECT sum(n * pow(zb - zz, 2)) FROM g, a) / ins, 4) AS levene, CAST(k - 1 AS DOUBLE) AS df1, CAST(nn - k AS DOUBLE) AS df2 FROM a""")
def _(t):
    return st.levene(_quality(t).withColumn("_all", F.lit(0)), ["_all"], "v", "grp").select(*rnd(4, "levene"), "df1", "df2")


# Skewness and kurtosis tests step by step, written apart from the operator.
@query("M12_normality", f"""WITH {_QUALITY}, a AS (SELECT grp, v - avg(v) OVER (PARTITION BY grp) AS d FROM d0),
m AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS g1, avg(d ** 4) / avg(d ** 2) ** 2 AS g2 FROM a GROUP BY 1),
s1 AS (SELECT *, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM m),
s2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS ww FROM s1),
s3 AS (SELECT *, asinh(g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / sqrt(2 / (ww - 1))) / sqrt(ln(sqrt(ww))) AS z1 FROM s2),
k1 AS (SELECT *, (g2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sk FROM s3),
k2 AS (SELECT *, 6 + 8 / sk * (2 / sk + sqrt(1 + 4 / sk ** 2)) AS dof FROM k1),
k3 AS (SELECT *, (1 - 2 / (9 * dof) - cbrt((1 - 2 / dof) / (1 + x * sqrt(2 / (dof - 4))))) / sqrt(2 / (9 * dof)) AS z2 FROM k2)
SELECT grp, CAST(n AS BIGINT) AS n, round(z1 * z1 + z2 * z2, 3) AS k2, round(exp((z1 * z1 + z2 * z2) / -2), 6) AS p FROM k3""")
def _(t):
    return st.normality(_quality(t), ["grp"], "v").select("grp", "n", *rnd(3, "k2"), *rnd(6, "p"))


@query("M12_two_group_summary", f"""WITH {_QUALITY}, d AS (SELECT 0 AS k, v, grp FROM d0), {_RANKED.format(k='k', one='grp = 0')},
m AS (SELECT *, abs(v - median(v) OVER (PARTITION BY grp)) AS y FROM d0), g AS (SELECT grp, count(*) AS n, avg(y) AS yb, var_pop(y) * count(*) AS ins FROM m GROUP BY 1),
l AS (SELECT (sum(n) - 2) * (sum(n * yb * yb) - pow(sum(n * yb), 2) / sum(n)) / sum(ins) AS levene, sum(n) - 2 AS df FROM g),
w AS (SELECT count(*) FILTER (WHERE grp = 0) AS a, count(*) FILTER (WHERE grp = 1) AS b, avg(v) FILTER (WHERE grp = 0) - avg(v) FILTER (WHERE grp = 1) AS gap, var_samp(v) FILTER (WHERE grp = 0) AS va, var_samp(v) FILTER (WHERE grp = 1) AS vb FROM d0),
lp AS (SELECT levene, df, {_t_two_sided('sqrt(levene)', 'df')} AS levene_p FROM l),
x AS (SELECT *, CASE WHEN levene_p > 0.05 THEN gap / sqrt(((a - 1) * va + (b - 1) * vb) / df * (1 / a + 1 / b)) ELSE gap / sqrt(va / a + vb / b) END AS t,
 CASE WHEN levene_p > 0.05 THEN df ELSE pow(va / a + vb / b, 2) / (pow(va / a, 2) / (a - 1) + pow(vb / b, 2) / (b - 1)) END AS tdf FROM w, lp)
SELECT n1, n2, round(levene, 4) AS levene, round(levene_p, 6) AS levene_p, round(t, 4) AS t, round({_t_two_sided('t', 'tdf')}, 6) AS t_p, round(u1, 2) AS u1, round(least({_two_sided('z')}, 1), 6) AS u_p FROM x, z""")
def _(t):
    return st.two_group_summary(_quality(t), "v", "grp", 0, 1).select("n1", "n2", *rnd(4, "levene"), *rnd(6, "levene_p"), *rnd(4, "t"), *rnd(6, "t_p"), *rnd(2, "u1"), *rnd(6, "u_p"))


@query("M12_ks_distance", f"""WITH v AS (SELECT (s_acctbal - 4500) / 3000 AS v FROM supplier), r AS (SELECT v, count(*) OVER (ORDER BY v) AS upto, count(*) OVER (PARTITION BY v) AS ties, count(*) OVER () AS n FROM v),
c AS (SELECT *, CASE WHEN v > 0 THEN 1 - {_two_sided('v')} / 2 ELSE {_two_sided('v')} / 2 END AS f FROM r), d AS (SELECT max(greatest(upto / n - f, f - (upto - ties) / n)) AS distance, max(n) AS n FROM c)
SELECT round(distance, 6) AS distance, n, round(greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * k * k * distance * distance * n))))), 6) AS p FROM d""")
def _(t):
    return st.ks_distance(t.supplier.select(((F.col("s_acctbal") - 4500) / 3000).alias("v")), "v").select(*rnd(6, "distance"), "n", *rnd(6, "p"))


# One row a value, in place of sums over chunks of ranks.
_SHAPIRO = f"""o AS (SELECT k, v, CAST(row_number() OVER (PARTITION BY k ORDER BY v) AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY k) AS DOUBLE) AS n, v - avg(v) OVER (PARTITION BY k) AS x FROM d),
c AS (SELECT *, (i - 0.375) / (n + 0.25) AS c FROM o), q AS (SELECT *, c - 0.5 AS q, sqrt(-ln(least(c, 1 - c))) AS t FROM c), m AS (SELECT *, {nm.quantile_sql('q', 't')} AS m FROM q),
s AS (SELECT k, n, sum(m * m) AS m2, sum(m * x) AS mx, sum(x * x) AS ss, max(m) AS top, max(m) FILTER (WHERE i = n - 1) AS nxt, max(v) - min(v) AS gap, max(v) FILTER (WHERE i = n - 1) - max(v) FILTER (WHERE i = 2) AS inn FROM m GROUP BY 1, 2),
w AS (SELECT k, n, pow({nm.root_sql('n', 'top', 'nxt', 'm2', 'mx', 'gap', 'inn')}, 2) / ss AS w FROM s WHERE n > 3), z AS (SELECT *, {nm.z_sql('n', 'w')} AS z FROM w),
sw AS (SELECT k, CAST(n AS BIGINT) AS n, w, CASE WHEN z > 0 THEN {_two_sided('z')} / 2 ELSE 1 - {_two_sided('z')} / 2 END AS p FROM z)"""


@query("M12_shapiro", f"WITH d AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer), {_SHAPIRO} SELECT k, n, round(w, 6) AS w, round(p, 5) AS p FROM sw")
def _(t):
    df = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return nm.shapiro_wilk(df, ["k"], "v").filter("n > 3").select("k", "n", *rnd(6, "w"), *rnd(5, "p"))


@query("M12_normality_choice", f"""WITH d AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer), {_SHAPIRO}, few AS (SELECT k, count(*) AS n FROM d GROUP BY 1)
SELECT few.k, few.n, CASE WHEN few.n < 50 THEN 'normalTest' WHEN few.n < 300 THEN 'shapiro' ELSE 'kstest' END AS test, CASE WHEN few.n BETWEEN 50 AND 299 THEN round(p, 5) END AS shapiro_p FROM few LEFT JOIN sw USING (k)""")
def _(t):
    df = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    return nm.normality_by_size(df, ["k"], "v").select("k", "n", "test", F.when(F.col("test") == "shapiro", F.round("p", 5) + 0.0).alias("shapiro_p"))


@query("M13_category_tests", f"""WITH d AS (SELECT lang, n_chars AS v, quality FROM documents JOIN labels USING (doc_id)), {_RANKED.format(k='lang', one='quality = 1')} SELECT lang, n1, n2, round(u1, 2) AS u1, round(z, 5) AS z_mw FROM z""")
def _(t):
    df = t.documents.join(t.labels, "doc_id")
    return st.rank_sums(df, ["lang"], "n_chars", F.col("quality") == 1).select("lang", "n1", "n2", *rnd(2, "u1"), *rnd(5, "z_mw"))


@query("M15_paired_sites", f"""WITH d AS (SELECT l_partkey % 50 AS site, l_linenumber AS v, l_linestatus FROM lineitem), {_RANKED.format(k='site', one="l_linestatus = 'F'")},
m AS (SELECT site, round(avg(v) FILTER (WHERE l_linestatus = 'F'), 2) AS normal_mean, round(avg(v) FILTER (WHERE l_linestatus <> 'F'), 2) AS tumour_mean FROM d GROUP BY 1) SELECT site, n1, n2, round(u1, 2) AS u1, round(z, 5) AS z_mw, normal_mean, tumour_mean FROM z JOIN m USING (site)""")
def _(t):
    df = t.lineitem.select((F.col("l_partkey") % 50).alias("site"), F.col("l_linenumber").alias("v"), (F.col("l_linestatus") == "F").alias("normal"))
    means = df.groupBy("site").agg(F.round(F.avg(F.when(F.col("normal"), F.col("v"))), 2).alias("normal_mean"), F.round(F.avg(F.when(~F.col("normal"), F.col("v"))), 2).alias("tumour_mean"))
    return st.rank_sums(df, ["site"], "v", F.col("normal")).join(means, "site").select("site", "n1", "n2", *rnd(2, "u1"), *rnd(5, "z_mw"), "normal_mean", "tumour_mean")


@query("M30_auc", f"""WITH d AS (SELECT 0 AS k, n_chars AS v, quality FROM documents JOIN labels USING (doc_id)), {_RANKED.format(k='k', one='quality = 1')} SELECT n1, n2, round(u1 / (n1 * n2), 6) AS auc FROM z""")
def _(t):
    return st.auc(t.documents.join(t.labels, "doc_id"), "n_chars", F.col("quality") == 1).select("n1", "n2", *rnd(6, "auc"))


# --- multiple testing ------------------------------------------------------------------------
# The tax and discount make a p value; the return flag is the study.

def _p(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("study"), F.col("l_partkey").alias("term")).agg((F.min("l_quantity") / 60 * F.min("l_extendedprice") / 60000).alias("p"))


_P = """p AS (SELECT l_returnflag AS study, l_partkey AS term, min(l_quantity) / 60 * min(l_extendedprice) / 60000 AS p FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY p, term) AS i, count(*) OVER (PARTITION BY study) AS m FROM p)"""


@query("W08_fdr_bh", f"WITH {_P} SELECT study, term, round(least(min(p * m / i) OVER (PARTITION BY study ORDER BY i DESC), 1), 5) AS q FROM k")
def _(t):
    return st.adjust(_p(t), ["study"]).select("study", "term", *rnd(5, "q"))


@query("M18_corrections", f"""WITH {_P}, h AS (SELECT study, sum(1.0 / i)::DOUBLE AS c FROM k GROUP BY 1), x AS (SELECT k.*, least(p * m, 1) AS bonferroni, 1 - pow(1 - p, m) AS sidak, least(max(p * (m - i + 1)) OVER (PARTITION BY study ORDER BY i), 1) AS holm,
 max(1 - pow(1 - p, m - i + 1)) OVER (PARTITION BY study ORDER BY i) AS hs, least(min(p * (m - i + 1)) OVER (PARTITION BY study ORDER BY i DESC), 1) AS sh, least(min(p * m / i * c) OVER (PARTITION BY study ORDER BY i DESC), 1) AS fby FROM k JOIN h USING (study))
SELECT study, term, round(bonferroni, 6) AS bonferroni, round(sidak, 6) AS sidak, round(holm, 6) AS holm, round(hs, 6) AS holm_sidak, round(sh, 6) AS simes_hochberg, round(fby, 6) AS fdr_by FROM x""")
def _(t):
    methods = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_by")
    out = st.adjust_all(_p(t), ["study"], {m: m.replace("-", "_") for m in methods})
    return out.select("study", "term", *rnd(6, "bonferroni", "sidak", "holm", "holm_sidak", "simes_hochberg", "fdr_by"))


@query("M18_two_stage", f"""WITH {_P}, a AS (SELECT *, min(p * m / i) OVER (PARTITION BY study ORDER BY i DESC) AS q FROM k), r AS (SELECT study, 1 - count(*) FILTER (WHERE q <= 0.05) / count(*) AS s FROM a GROUP BY 1)
SELECT study, term, round(least(q * CASE WHEN s > 0 AND s < 1 THEN s ELSE 1 END, 1), 6) AS q FROM a JOIN r USING (study)""")
def _(t):
    return st.adjust(_p(t), ["study"], method="fdr_tsbh").select("study", "term", *rnd(6, "q"))


@query("M18_hommel", f"""WITH {_P}, c AS (SELECT study, term, p, i, m FROM k), t AS (SELECT a.study, a.i AS n, min(a.i * b.p / (b.i - (a.m - a.i))) AS s FROM c a JOIN c b ON a.study = b.study AND b.i > a.m - a.i GROUP BY 1, 2),
b AS (SELECT c.study, c.term, c.p, max(t.n) AS n FROM c JOIN t ON c.study = t.study AND t.n * c.p < t.s GROUP BY 1, 2, 3)
SELECT c.study, c.term, round(least(1, greatest(coalesce(b.n, 0) * c.p, coalesce(t.s, 0))) + 1e-10, 6) AS q FROM c LEFT JOIN b ON c.study = b.study AND c.term = b.term LEFT JOIN t ON c.study = t.study AND t.n = coalesce(b.n, 0) + 1""")
def _(t):
    return st.adjust(cut_lineage(_p(t)), ["study"], method="hommel").select("study", "term", F.round(F.col("q") + 1e-10, 6).alias("q"))


@query("M18_two_stage_conservative", f"""WITH {_P}, a AS (SELECT *, min(p * m / i) OVER (PARTITION BY study ORDER BY i DESC) AS q FROM k), r AS (SELECT study, 1 - count(*) FILTER (WHERE q <= 0.05 / 1.05) / count(*) AS s FROM a GROUP BY 1)
SELECT study, term, round(least(q * CASE WHEN s > 0 AND s < 1 THEN s ELSE 1 END * 1.05, 1), 6) AS q FROM a JOIN r USING (study)""")
def _(t):
    return st.adjust(_p(t), ["study"], method="fdr_tsbky").select("study", "term", *rnd(6, "q"))


# --- enrichment ------------------------------------------------------------------------------
# Studies: the parts that sold much, per return flag.

def _study(t):
    sold = t.lineitem.groupBy(F.col("l_returnflag").alias("study"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("q"))
    return sold.filter("q > 330").select("study", "gene", F.when(F.col("q") > 420, "up").when(F.col("q") > 360, "down").otherwise("").alias("direction"))


_STUDY = """study AS (SELECT l_returnflag AS study, l_partkey AS gene, CASE WHEN sum(l_quantity) > 420 THEN 'up' WHEN sum(l_quantity) > 360 THEN 'down' ELSE '' END AS direction FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 330)"""
_ENRICH = f"""{TERMS}, {_STUDY}, sz AS (SELECT study, count(*) AS n FROM study WHERE gene IN (SELECT gene FROM terms) GROUP BY 1), ts AS (SELECT term, count(*) AS kk FROM terms GROUP BY 1),
h AS (SELECT study, term, count(*) AS k FROM study JOIN terms USING (gene) GROUP BY 1, 2), pop AS (SELECT count(DISTINCT gene) AS nn FROM terms),
e AS (SELECT study, term, k, n, kk, nn, list_sum(list_transform(range(k, least(kk, n) + 1), lambda x: exp(lgamma(kk + 1) - lgamma(x + 1) - lgamma(greatest(kk - x, 0) + 1) + lgamma(nn - kk + 1) - lgamma(greatest(n - x, 0) + 1) - lgamma(greatest(nn - kk - n + x, 0) + 1) - lgamma(nn + 1) + lgamma(n + 1) + lgamma(nn - n + 1)))) AS p
 FROM h JOIN sz USING (study) JOIN ts USING (term), pop)"""


@query("M16_enrichment", f"""WITH {_ENRICH} SELECT study, term, k AS study_hits, n AS study_size, kk AS term_size, nn AS population, round(p, 6) AS p FROM e""")
def _(t):
    out = en.enrich(_study(t), b.gene_terms(t))
    return out.select("study", "term", "study_hits", "study_size", "term_size", "population", *rnd(6, "p"))


@query("M17_labelled_enrichment", f"""WITH {_ENRICH}, k2 AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY p, term) AS i, count(*) OVER (PARTITION BY study) AS m FROM e), q AS (SELECT *, least(min(p * m / i) OVER (PARTITION BY study ORDER BY i DESC), 1) AS q FROM k2)
SELECT study, term, k || '/' || n AS ratio_in_study, kk || '/' || nn AS ratio_in_pop, round(q, 5) AS q, CASE WHEN q <= 0.9 THEN 'e' ELSE 'p' END AS label FROM q""")
def _(t):
    out = en.ratios(en.enrich(_study(t), b.gene_terms(t), alpha=0.9))
    return out.select("study", "term", "ratio_in_study", "ratio_in_pop", *rnd(5, "q"), "label")


@query("M19_all_studies", f"WITH {_ENRICH} SELECT study, count(*) AS terms, round(min(p), 6) AS best FROM e GROUP BY 1")
def _(t):
    return en.enrich(_study(t), b.gene_terms(t)).groupBy("study").agg(F.count("*").alias("terms"), F.round(F.min("p"), 6).alias("best"))


@query("T03_top_terms", f"WITH {_ENRICH}, o AS (SELECT study, term, left(term, 1) AS ns, row_number() OVER (PARTITION BY study, left(term, 1) ORDER BY round(p, 8), term) AS place FROM e) SELECT study, term, ns, CAST(place AS INTEGER) AS place FROM o WHERE place <= 2")
def _(t):
    out = en.enrich(_study(t), b.gene_terms(t)).withColumn("p", F.round("p", 8)).withColumn("ns", F.left("term", F.lit(1)))
    return en.top_terms(out, 2, ["ns"]).select("study", "term", "ns", "place")


@query("R09_term_members", f"""WITH {TERMS}, {_STUDY} SELECT study, term, gene, gene || CASE WHEN direction <> '' THEN '|' || direction ELSE '' END || CASE WHEN p_size > 20 THEN '|' || p_type ELSE '' END AS info
FROM study JOIN terms USING (gene) JOIN part ON gene = p_partkey""")
def _(t):
    symbols = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("symbol"))
    return en.term_members(_study(t), b.gene_terms(t), symbols)


@query("R09_decorated_lists", """SELECT o_orderkey AS row_id, 'g' || (o_custkey % 9) || CASE WHEN o_custkey % 9 < 5 THEN '|up' ELSE '' END || CASE WHEN o_custkey % 9 > 2 THEN '|S' || (o_custkey % 9) ELSE '' END || ';g' || (o_orderkey % 9) || CASE WHEN o_orderkey % 9 < 5 THEN '|up' ELSE '' END || CASE WHEN o_orderkey % 9 > 2 THEN '|S' || (o_orderkey % 9) ELSE '' END AS study_items FROM orders""")
def _(t):
    table = t.orders.select(F.col("o_orderkey").alias("row_id"), F.concat(s("g", F.col("o_custkey") % 9), s(", g", F.col("o_orderkey") % 9)).alias("study_items"))
    g = t.part.select((F.col("p_partkey") % 9).alias("n")).distinct()
    return en.decorate_lists(table, g.filter("n < 5").select(s("g", "n").alias("gene"), F.lit("up").alias("direction")), g.filter("n > 2").select(s("g", "n").alias("gene"), s("S", "n").alias("symbol")))


_COL = f"""{TERMS}, {_STUDY}, h AS (SELECT DISTINCT study, term || CASE WHEN term LIKE 'r%' THEN '01100' ELSE '' END AS term, 'K' || (gene % 40) AS ko, CASE WHEN direction = 'up' THEN 'red,blue' WHEN term LIKE 'r%' THEN 'black' WHEN direction = 'down' THEN 'blue,red' ELSE 'pink,blue' END AS colour FROM study JOIN terms USING (gene)),
c AS (SELECT study, term, ko, CASE WHEN count(*) FILTER (WHERE colour <> 'pink,blue') > 1 THEN 'yellow' ELSE coalesce(max(colour) FILTER (WHERE colour <> 'pink,blue'), 'pink,blue') END AS colour FROM h GROUP BY 1, 2, 3)"""


def _colours(t):
    terms = b.gene_terms(t).withColumn("term", F.when(F.col("term").startswith("r"), F.concat("term", F.lit("01100"))).otherwise(F.col("term")))
    return en.map_colours(_study(t), terms, t.part.select(F.col("p_partkey").alias("gene"), s("K", F.col("p_partkey") % 40).alias("ko")))


@query("R06_map_colours", f"WITH {_COL} SELECT * FROM c")
def _(t):
    return _colours(t)


@query("R06_map_links", f"WITH {_COL} SELECT study, term, 'map?' || term || string_agg('/' || ko || '%09' || colour, '' ORDER BY '/' || ko || '%09' || colour) AS link FROM c GROUP BY 1, 2")
def _(t):
    return en.map_links(_colours(t), "map?")


# --- differential expression -----------------------------------------------------------------

def _comparisons(t):
    g = b.groups(t).select(F.col("batch").alias("grp"), "sample").union(b.groups(t).select("grp", "sample"))
    pairs = g.select(F.col("grp").alias("ctrl")).distinct()
    return g, pairs.select("ctrl", F.when(F.col("ctrl") == "g0", "g1").when(F.col("ctrl") == "b0", "b1").alias("test")).filter("test IS NOT NULL")


def _compared(t):
    members, comparisons = _comparisons(t)
    factors = ex.size_factors(b.counts(t), 8)
    return de.compare_groups(b.counts(t), factors, members, comparisons)


_DE = f"""{COUNTS}, {GROUPS}, l AS (SELECT gene, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY gene) AS ratio, count(*) OVER (PARTITION BY gene) AS n FROM counts WHERE value > 0), sf AS (SELECT sample, exp(median(ratio)) AS f FROM l WHERE n = 8 GROUP BY 1),
mem AS (SELECT 'g0' AS ctrl, 'g1' AS test, sample, grp = 'g0' AS is_c FROM groups UNION ALL SELECT 'b0', 'b1', sample, batch = 'b0' FROM groups),
v AS (SELECT ctrl, test, gene, is_c, floor(value + 0.5) AS raw, floor(value + 0.5) / f AS norm, log2(floor(value + 0.5) / f + 1) AS ln, f FROM counts JOIN sf USING (sample) JOIN mem USING (sample)),
a AS (SELECT ctrl, test, gene, sum(raw) AS tot, avg(norm) FILTER (WHERE is_c) AS c, avg(norm) FILTER (WHERE NOT is_c) AS t, count(*) FILTER (WHERE NOT is_c) AS n1, count(*) FILTER (WHERE is_c) AS n2, avg(ln) FILTER (WHERE NOT is_c) AS m1, avg(ln) FILTER (WHERE is_c) AS m2,
 var_samp(ln) FILTER (WHERE NOT is_c) AS v1, var_samp(ln) FILTER (WHERE is_c) AS v2 FROM v GROUP BY 1, 2, 3),
d AS (SELECT ctrl, test, gene, log2((coalesce(t, 0) + 1) / (coalesce(c, 0) + 1)) AS fc, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS tw FROM a WHERE tot >= 8)"""


@query("M22_group_comparison", f"WITH {_DE} SELECT ctrl, test, gene, round(fc, 4) + 0.0 AS log2fc, round(tw, 4) + 0.0 AS t_welch FROM d")
def _(t):
    return _compared(t).select("ctrl", "test", "gene", *rnd(4, "log2fc", "t_welch"))


@query("M22_dispersion", f"""WITH {_DE}, x AS (SELECT v.ctrl, v.test, v.gene, sum(raw) AS tot, avg(norm) AS mu, avg(1 / f) AS inv, avg(norm) FILTER (WHERE is_c) AS m1, avg(norm) FILTER (WHERE NOT is_c) AS m2,
 var_samp(norm) FILTER (WHERE is_c) AS v1, var_samp(norm) FILTER (WHERE NOT is_c) AS v2, CAST(count(*) FILTER (WHERE is_c) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT is_c) AS DOUBLE) AS n2 FROM v GROUP BY 1, 2, 3),
o AS (SELECT *, greatest((((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) - mu * inv) / (mu * mu), 0) AS disp FROM x WHERE tot >= 8 AND n1 > 1 AND n2 > 1 AND m1 > 0 AND m2 > 0),
tr AS (SELECT ctrl, test, coalesce(covar_pop(disp, 1 / mu) / nullif(var_pop(1 / mu), 0), 0) AS a, avg(disp) AS d, avg(1 / mu) AS i FROM o GROUP BY 1, 2),
f1 AS (SELECT o.*, greatest(d + a * (1 / mu - i), 0) AS fitted FROM o JOIN tr USING (ctrl, test)),
f2 AS (SELECT *, log2(m2 / m1) AS fc, sqrt((inv / m1 + (disp + fitted) / 2) / n1 + (inv / m2 + (disp + fitted) / 2) / n2) / ln(2) AS se FROM f1)
SELECT ctrl, test, gene, round(mu, 4) AS base_mean, round(disp, 5) AS dispersion, round(fitted, 5) AS fitted, round(fc, 4) + 0.0 AS log2fc, round(fc / se, 4) + 0.0 AS wald, round(least({_two_sided('(fc / se)')}, 1), 5) AS pvalue FROM f2""")
def _(t):
    members, comparisons = _comparisons(t)
    out = de.dispersion_test(b.counts(t), ex.size_factors(b.counts(t), 8), members, comparisons)
    return out.select("ctrl", "test", "gene", *rnd(4, "base_mean"), *rnd(5, "dispersion", "fitted"), *rnd(4, "log2fc", "wald"), *rnd(5, "pvalue"))


# Whether the coefficients solve the score equations is worked out here from the counts, apart from the fit.
@query("M22_count_model", f"""WITH {_DE} SELECT ctrl, test, gene, round(avg(norm), 4) AS base_mean, TRUE AS settled FROM v GROUP BY 1, 2, 3
 HAVING sum(raw) >= 8 AND count(*) > 2 AND count(*) FILTER (WHERE is_c) > 0 AND count(*) FILTER (WHERE NOT is_c) > 0""")
def _(t):
    members, comparisons = _comparisons(t)
    counts = cut_lineage(b.counts(t))
    factors = cut_lineage(ex.size_factors(counts, 8))
    out = cm.count_model(counts, factors, members, comparisons)
    side = F.when(F.col("grp") == F.col("test"), 1.0).otherwise(0.0)
    mu = F.col("size_factor") * F.exp(F.col("intercept") + F.col("coefficient") * F.col("side"))
    rest = (F.floor(F.col("value") + 0.5) - mu) / (1 + F.col("dispersion") * mu)
    cells = out.join(members.distinct(), (F.col("grp") == F.col("ctrl")) | (F.col("grp") == F.col("test"))).join(counts, ["gene", "sample"]).join(factors, "sample")
    sums = cells.withColumn("side", side).groupBy("ctrl", "test", "gene").agg(
        F.max("base_mean").alias("base_mean"), F.sum(rest).alias("s0"), F.sum(rest * F.col("side")).alias("s1"), F.max("intercept").alias("b0"), F.max("coefficient").alias("b1"))
    settled = (F.abs(F.col("s0") - cm.RIDGE * F.col("b0")) < 1e-4) & (F.abs(F.col("s1") - cm.RIDGE * F.col("b1")) < 1e-4)
    return sums.select("ctrl", "test", "gene", *rnd(4, "base_mean"), settled.alias("settled"))


@query("M22_tests")
def _(t):
    members, comparisons = _comparisons(t)
    out = cm.count_model(b.counts(t), ex.size_factors(b.counts(t), 8), members, comparisons)
    return out.select("ctrl", "test", "gene", *rnd(5, "own", "trend", "dispersion"), *rnd(4, "log2fc", "log2fc_shrunken", "se", "wald"), *rnd(5, "p_wald", "p_lrt"))


@query("M22_adjusted_p", f"""WITH {_DE}, w AS (SELECT d.*, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM d JOIN a USING (ctrl, test, gene)),
pv AS (SELECT ctrl, test, gene, fc, CASE WHEN tw IS NOT NULL AND df > 0 THEN {_t_two_sided('tw', 'df')} END AS p FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY ctrl, test ORDER BY p, gene) AS i, count(p) OVER (PARTITION BY ctrl, test) AS m FROM pv WHERE p IS NOT NULL), q AS (SELECT *, least(min(p * m / i) OVER (PARTITION BY ctrl, test ORDER BY i DESC), 1) AS q FROM k)
SELECT pv.ctrl, pv.test, pv.gene, round(pv.fc, 4) + 0.0 AS log2fc, round(pv.p, 5) AS pvalue, round(q.q, 4) AS padjust FROM pv LEFT JOIN q USING (ctrl, test, gene)""")
def _(t):
    return de.with_p(_compared(t)).select("ctrl", "test", "gene", *rnd(4, "log2fc"), F.round("pvalue", 5).alias("pvalue"), F.round("padjust", 4).alias("padjust"))


# Statistics with ready p values: prices make the fold, quantities the p.
def _stats(t):
    fold = rounded_mean(F.col("l_extendedprice"), 4, lambda mean: mean / 10000 - 5)
    agg = t.lineitem.groupBy(F.col("l_partkey").alias("gene")).agg(fold.alias("log2fc"), F.round(F.min("l_quantity") / 50, 6).alias("pvalue"))
    return agg.filter("gene % 4 <> 0").withColumn("padjust", F.least(F.col("pvalue") * 2, F.lit(1.0)))


_ST = """st AS (SELECT l_partkey AS gene, round(avg(l_extendedprice) / 10000 - 5, 4) AS fc, round(min(l_quantity) / 50, 6) AS p, least(round(min(l_quantity) / 50, 6) * 2, 1) AS q FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1)"""


@query("M20_report", f"""WITH {_ST} SELECT p_partkey AS gene, CASE WHEN p_size > 25 THEN p_name ELSE 'None' END AS name, CASE WHEN st.gene IS NULL THEN 'untested' ELSE printf('%.4f', fc) END AS log2fc, CASE WHEN st.gene IS NULL THEN 'untested' WHEN fc >= 0.1 OR fc <= -0.1 THEN CASE WHEN q <= 0.1 THEN 'yes' ELSE 'no' END ELSE 'no' END AS significant,
 CASE WHEN st.gene IS NULL THEN 'untested' WHEN fc = 0 THEN 'stable' WHEN fc > 0 THEN 'up' ELSE 'down' END AS regulate FROM part LEFT JOIN st ON st.gene = p_partkey""")
def _(t):
    genes = t.part.select(F.col("p_partkey").alias("gene"))
    ann = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("name"))
    return de.report(genes, _stats(t), ann, 2**0.1, 0.1).select("gene", "name", "log2fc", "significant", "regulate")


_SIG = """sg AS (SELECT l_returnflag || '_vs_x' AS comparison, l_partkey AS gene FROM lineitem GROUP BY 1, 2 HAVING avg(l_quantity) > 30)"""


def _significant(t):
    sums = t.lineitem.groupBy(s("", "l_returnflag", "_vs_x").alias("comparison"), F.col("l_partkey").alias("gene")).agg(F.avg("l_quantity").alias("q"))
    return sums.filter("q > 30").select("comparison", "gene")


@query("M21_summary_matrix", f"""WITH {_SIG}, w AS (SELECT p_partkey AS gene, {", ".join(f"CASE WHEN bool_or(comparison = '{x}_vs_x') THEN 'yes' ELSE 'no' END AS \"{x}_vs_x\"" for x in "ANR")}, CAST(count(comparison) AS INTEGER) AS total FROM part LEFT JOIN sg ON gene = p_partkey GROUP BY 1) SELECT * FROM w""")
def _(t):
    return de.summary_matrix(t.part.select(F.col("p_partkey").alias("gene")), _significant(t), [f"{x}_vs_x" for x in "ANR"])


@query("M21_summary_totals", f"WITH {_SIG} SELECT comparison, count(*) AS n FROM sg GROUP BY 1 UNION ALL SELECT 'union', count(DISTINCT gene) FROM sg")
def _(t):
    return de.summary_totals(_significant(t))


# --- identity and density --------------------------------------------------------------------

def _sites(t):
    li = t.lineitem.groupBy(s("s", F.col("l_suppkey") % 8).alias("sample"), F.col("l_partkey").alias("index")).agg(
        F.sum(F.col("l_linenumber")).alias("ref"), F.sum(F.col("l_quantity").cast("long") % 7).alias("alt"))
    return li.withColumn("vaf", F.when(F.col("index") % 9 != 0, F.round(F.col("alt") / (F.col("ref") + F.col("alt")), 6)))


_SITES = """si AS (SELECT 's' || (l_suppkey % 8) AS sample, l_partkey AS idx, CAST(sum(l_linenumber) AS BIGINT) AS ref, CAST(sum(CAST(l_quantity AS BIGINT) % 7) AS BIGINT) AS alt FROM lineitem GROUP BY 1, 2), u AS (SELECT *, round(alt / (ref + alt), 6) AS vaf FROM si WHERE idx % 9 <> 0),
dp AS (SELECT sample, sum(ref + alt) / (count(*) + 21039) AS mean_depth, sum(ref + alt) / nullif(count(*) FILTER (WHERE ref + alt > 0), 0) AS real_depth FROM u GROUP BY 1)"""


@query("A24_identity_depths", f"WITH {_SITES} SELECT sample, round(mean_depth, 6) AS mean_depth, round(real_depth, 6) AS real_depth FROM dp")
def _(t):
    return pw.identity_depths(_sites(t)).select("sample", *rnd(6, "mean_depth", "real_depth"))


_VERDICT = f"""{_SITES}, r AS (SELECT x.sample AS a, y.sample AS b, count(*) AS n, corr(x.vaf, y.vaf) AS c FROM u x JOIN u y USING (idx) WHERE x.sample < y.sample GROUP BY 1, 2), e AS (SELECT a, b, n, CASE WHEN n < 20 THEN 0 ELSE c END AS c, least(p.real_depth, q.real_depth) AS d FROM r JOIN dp p ON a = p.sample JOIN dp q ON b = q.sample),
v AS (SELECT *, CASE WHEN d > 10 THEN abs(0.310549 - c) - 0.060058 > abs(0.874546 - c) - 0.022211 WHEN d > 5 THEN abs(0.279778 - c) - 0.054104 > abs(0.785249 - c) - 0.021017 WHEN d > 2 THEN abs(0.238972 - c) - 0.047196 > abs(0.650573 - c) - 0.018699
 WHEN d > 1 THEN abs(0.222322 - c) - 0.041186 > abs(0.578386 - c) - 0.018526 ELSE abs(0.217839 - c) - 0.040334 > abs(0.529327 - c) - 0.025785 END AS hit FROM e)"""


@query("M29_same_donor", f"WITH {_VERDICT} SELECT a, b, n, round(c, 6) + 0.0 AS corr, round(d, 6) AS depth, CASE WHEN hit THEN 'matched' ELSE 'unmatched' END AS verdict FROM v")
def _(t):
    return pw.same_donor(_sites(t), SAMPLES, nonzero=True).select("a", "b", "n", *rnd(6, "corr", "depth"), "verdict")


_MEAN_VERDICT = _VERDICT.replace("least(p.real_depth, q.real_depth)", "least(p.mean_depth, q.mean_depth)")


@query("M29_identity_matrix", f"""WITH {_MEAN_VERDICT}, m AS (SELECT a, b, CASE WHEN hit THEN round(c, 6) ELSE 0 END AS c FROM v), w AS (SELECT a, b, c FROM m UNION ALL SELECT b, a, c FROM m)
SELECT a, {", ".join(f"coalesce(max(c) FILTER (WHERE b = '{x}'), 0)::DOUBLE AS {x}" for x in SAMPLES)} FROM w GROUP BY 1""")
def _(t):
    return pw.identity_matrix(pw.same_donor(_sites(t), SAMPLES), SAMPLES).select("a", *rnd(6, *SAMPLES))


@query("M34_histogram", "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_returnflag AS grp, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2")
def _(t):
    return st.histogram(t.lineitem.withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_extendedprice")


@query("M34_kernel_density", """WITH a AS (SELECT o_totalprice AS v, stddev_samp(o_totalprice) OVER () * pow(count(*) OVER (), -0.2) AS h FROM orders), g AS (SELECT unnest(range(0, 21)) * 25000.0::DOUBLE AS point)
SELECT point, round(avg(exp(-0.5 * pow((point - v) / h, 2)) / (h * sqrt(2 * pi()))) * 1e6, 6) AS density FROM g, a GROUP BY 1""")
def _(t):
    out = st.kernel_density(t.orders, "o_totalprice", [25000.0 * i for i in range(21)])
    return out.select("point", F.round(F.col("density") * 1e6, 6).alias("density"))


@query("M34_binned_density", """WITH a AS (SELECT o_totalprice AS v, stddev_samp(o_totalprice) OVER () * pow(count(*) OVER (), -0.2) AS h FROM orders), g AS (SELECT unnest(range(0, 21)) * 25000.0::DOUBLE AS point)
SELECT point, round(avg(exp(-0.5 * pow((point - v) / h, 2)) / (h * sqrt(2 * pi()))) * 1e6, 3) AS density FROM g, a GROUP BY 1""")
def _(t):
    out = density.binned_density(t.orders, "o_totalprice", [25000.0 * i for i in range(21)])
    return out.select("point", F.round(F.col("density") * 1e6, 3).alias("density"))
