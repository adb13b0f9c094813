"""Variant filter and call set evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import calls as ca
from helixframe.operators import templates
from helixframe.operators import variants as va
from helixframe.plans.files import s
from helixframe.plans.registry import Suite
from helixframe.session import new_path

suite = Suite()
query = suite.query


def rnd(places, *names):
    return [F.round(n, places).alias(n) for n in names]


# --- filters ---------------------------------------------------------------------------------

def _paired(t):
    """Tumour and normal genotypes per line item; every other line has them swapped."""
    li = t.lineitem
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    tum = F.struct(F.lit("0/1").alias("GT"), F.concat(F.col("l_discount").cast("string"), F.lit(",0.01")).alias("AF"), F.concat(q.cast("string"), F.lit(","), n.cast("string")).alias("AD"))
    nor = F.struct(F.lit("0|0").alias("GT"), (F.col("l_tax") / 8).cast("string").alias("AF"), F.lit("30,0").alias("AD"))
    swap = F.col("l_orderkey") % 2 == 0
    return li.select("l_orderkey", "l_linenumber", F.when(swap, nor).otherwise(tum).alias("a"), F.when(swap, tum).otherwise(nor).alias("b"),
                     F.when(F.col("l_returnflag") == "R", "PASS;Germline").otherwise("PASS").alias("filter"), (F.col("l_partkey") % 60).alias("gene"), (F.col("l_suppkey") % 8).alias("k"))


_PASS = "l_discount >= 0.05 AND greatest(l_discount, 0.01) / (l_tax / 8 + 1e-5) >= 5 AND CAST(l_quantity AS INTEGER) + l_linenumber >= 20 AND l_linenumber >= 3 AND l_returnflag <> 'R'"


@query("F09_paired_filter", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_PASS}")
def _(t):
    return va.filter_paired(_paired(t), "a", "b").select("l_orderkey", "l_linenumber")


def _calls(t):
    k = F.col("o_orderkey")
    return t.orders.select((F.col("o_custkey") % 10).alias("sample"), k.alias("var_id"), ((k % 100) / 100).alias("af"), "o_orderstatus", "o_orderpriority",
                           (k % 7 == 0).alias("is_hotspot"), (F.floor(F.col("o_totalprice") / 1000)).alias("depth"))


_CALLS = "c AS (SELECT o_custkey % 10 AS sample, o_orderkey AS var_id, (o_orderkey % 100) / 100 AS af, o_orderstatus, o_orderpriority, o_orderkey % 7 = 0 AS is_hotspot, CAST(floor(o_totalprice / 1000) AS BIGINT) AS depth FROM orders)"
_D, _K = "o_orderstatus <> 'P'", "(o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')"


def _detected(t):
    return _calls(t).filter(_D).select("sample", "var_id", "af")


def _known(t):
    return _calls(t).filter(_K).select("sample", "var_id", "af")


@query("F10_by_af", f"WITH {_CALLS} SELECT sample, var_id, af FROM c WHERE af >= 0.25")
def _(t):
    return va.by_af(_calls(t), 0.25).select("sample", "var_id", "af")


@query("F11_two_tier_af", f"WITH {_CALLS} SELECT sample, var_id, af FROM c WHERE af >= 0.02 AND (is_hotspot OR af >= 0.5)")
def _(t):
    return va.by_two_tier_af(_calls(t), 0.02, 0.5).select("sample", "var_id", "af")


def _annotated(t):
    """Population columns: the discount or tax, or '.'."""
    n = F.col("l_linenumber")
    pops = {p: F.when(n == i + 1, ".").otherwise((F.col("l_discount") / (i + 1)).cast("string")).alias(p) for i, p in enumerate(va.POPULATIONS)}
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("gene"), F.when(F.col("l_returnflag") == "A", "Likely_Pathogenic").otherwise("Benign").alias("clnsig"),
                             F.when(F.col("l_linestatus") == "F", "reviewed_by_expert_panel").otherwise("none").alias("clnrevstat"), F.when(n % 2 == 0, "intronic").otherwise("exonic").alias("func"),
                             F.concat(F.lit("0.01,"), (F.col("l_quantity") / 100).cast("string")).alias("af_text"), *pops.values())


_RARE = " AND ".join(f"(l_linenumber = {i + 1} OR l_discount / {i + 1} <= {{0}})" for i in range(6))


@query("F12_rare_variants", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_RARE.format('0.02')}")
def _(t):
    return _annotated(t).filter(va.rare(va.POPULATIONS, 0.02)).select("l_orderkey", "l_linenumber")


@query("F13_germline", f"""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 50 IN (SELECT p_size FROM part) AND l_quantity / 100 >= 0.2
 AND ((l_returnflag = 'A' AND l_linestatus = 'F') OR (l_linenumber % 2 <> 0 AND {_RARE.format('0.01')}))""")
def _(t):
    return va.germline(_annotated(t), t.part.select("p_size")).select("l_orderkey", "l_linenumber")


@query("F16_plain_bases", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <= 4")
def _(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("ref"), F.call_function("repeat", F.lit("A"), F.col("l_linenumber")).alias("alt"))
    return va.plain_bases(v, 4).select("l_orderkey", "l_linenumber")


def _annotations(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record"), s("chr", F.col("l_suppkey") % 22).alias("chrom"), F.col("l_orderkey").cast("string").alias("start"), s("G", F.col("l_partkey") % 99).alias("gene"),
                             s("NM_", F.col("l_partkey") % 300).alias("transcript"), s("exon", "l_linenumber").alias("exon"), s("c.", F.col("l_quantity").cast("int")).alias("chgvs"), s("p.", F.col("l_suppkey") % 40).alias("phgvs"))


def _clauses(t):
    k = F.col("p_partkey")
    one = F.concat(s("g=G", k % 120), s(";t=NM_", k % 320, ".4"), s(";c=c.", F.col("p_size")))
    two = F.concat(s("r=chr", k % 25), s(";s=", k))
    return va.parse_clauses(t.part.select(F.when(k % 2 == 0, one).otherwise(two).alias("value")).distinct())


_CLAUSE = """a AS (SELECT l_orderkey * 10 + l_linenumber AS record, l_suppkey % 22 AS chrom, l_orderkey AS start, l_partkey % 99 AS gene, l_partkey % 300 AS tx, CAST(l_quantity AS INTEGER) AS c FROM lineitem),
q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'g=G' || (p_partkey % 120) || ';t=NM_' || (p_partkey % 320) || '.4;c=c.' || p_size ELSE 'r=chr' || (p_partkey % 25) || ';s=' || p_partkey END AS clause,
 CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 120 END AS gene, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 320 END AS tx, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS c,
 CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 25 END AS chrom, CASE WHEN p_partkey % 2 = 1 THEN p_partkey END AS start FROM part),
h AS (SELECT record, clause FROM a JOIN q ON a.gene = q.gene AND a.tx = q.tx AND a.c = q.c UNION ALL SELECT record, clause FROM a JOIN q ON a.chrom = q.chrom AND a.start = q.start)"""


@query("F17_match_clauses", f"WITH {_CLAUSE} SELECT record, clause FROM h")
def _(t):
    return va.match_clauses(_annotations(t), _clauses(t)).select("record", "clause")


@query("F17_unmatched_clauses", f"WITH {_CLAUSE} SELECT clause FROM q WHERE clause NOT IN (SELECT clause FROM h)")
def _(t):
    return va.unmatched_clauses(_annotations(t), _clauses(t)).select("clause")


@query("F18_field_ranges", """WITH v AS (SELECT 'DP' AS field, 0 AS place, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS one FROM lineitem UNION ALL SELECT 'DP', 1, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_linenumber <> 2
 UNION ALL SELECT 'FLAG', 0, l_returnflag FROM lineitem UNION ALL SELECT 'ID', 0, 'o' || l_orderkey FROM lineitem),
g AS (SELECT field, place, count(DISTINCT one) AS n, count(DISTINCT TRY_CAST(one AS DOUBLE)) AS m, min(TRY_CAST(one AS DOUBLE)) AS low, max(TRY_CAST(one AS DOUBLE)) AS high, max(1) AS one FROM v GROUP BY 1, 2)
SELECT DISTINCT g.field, CAST(g.place AS INTEGER) AS place, CASE WHEN n = m THEN 'range' ELSE 'category' END AS kind, CASE WHEN n = m THEN low END AS low, CASE WHEN n = m THEN high END AS high, CASE WHEN n <> m THEN v.one END AS category, n FROM g JOIN v ON g.field = v.field AND g.place = v.place""")
def _(t):
    n = F.col("l_linenumber")
    dp = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(","), F.when(n == 2, ".").otherwise(n.cast("string")))
    info = F.create_map(F.lit("DP"), dp, F.lit("FLAG"), F.col("l_returnflag"), F.lit("ID"), s("o", "l_orderkey"))
    return va.field_ranges(t.lineitem.select(F.explode(info).alias("field", "value")))


# The template of the suppliers, exported and read back, filters the customers.
@query("F18_template_rows", """SELECT c_custkey FROM customer, (SELECT min(s_acctbal) AS low, max(s_acctbal) AS high, min(s_suppkey % 7) AS a, max(s_suppkey % 7) AS b FROM supplier)
WHERE c_acctbal BETWEEN low AND high AND c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey % 5 <> 0 AND c_custkey % 9 BETWEEN a AND b AND c_custkey % 4 IN (SELECT s_suppkey % 3 FROM supplier)""")
def _(t):
    path = new_path(t.spark, "template")
    known = t.supplier.select(F.explode(F.create_map(
        F.lit("BAL"), F.col("s_acctbal").cast("string"), F.lit("NAT"), s("N'", "s_nationkey"), F.lit("T/AF"), F.concat(s("", F.col("s_suppkey") % 7), s(",x", F.col("s_suppkey") % 3)))).alias("field", "value"))
    templates.write_template(templates.template_rules(va.field_ranges(known)), path)
    k = F.col("c_custkey")
    fraction = F.when(k % 5 == 0, ".").otherwise(F.concat(s("", k % 9), s(",x", k % 4)))
    info = F.create_map(F.lit("BAL"), F.col("c_acctbal").cast("string"), F.lit("NAT"), s("N'", "c_nationkey"))
    records = t.customer.select("c_custkey", info.alias("info"), F.create_map(F.lit("T"), F.create_map(F.lit("AF"), fraction)).alias("samples"))
    return templates.apply_rules(records, templates.read_template(t.spark, path)).select("c_custkey")


@query("F22_simplified_reports", "SELECT 's' || (l_suppkey % 8) AS sample, 'G' || (l_partkey % 99) AS gene, l_orderkey, l_tax FROM lineitem WHERE l_partkey % 99 IN (SELECT p_size FROM part WHERE p_size < 20)")
def _(t):
    rows = t.lineitem.select(F.concat(F.lit("/run/"), s("s", F.col("l_suppkey") % 8), F.lit("/report.xls")).alias("path"), s("G", F.col("l_partkey") % 99).alias("gene"), "l_orderkey", "l_tax", "l_discount")
    return va.simplified_reports(rows, t.part.filter("p_size < 20").select(s("G", "p_size").alias("g")), ["gene", "l_orderkey", "l_tax"])


@query("F23_annotated_only", "SELECT l_orderkey, l_linenumber, 'x' || l_partkey AS change, CAST(1 AS INTEGER) AS n FROM lineitem WHERE l_linenumber % 3 <> 0")
def _(t):
    info = F.create_map(F.lit("AAChange"), F.when(F.col("l_linenumber") % 3 == 0, ".").otherwise(s("x", "l_partkey")), F.lit("DP"), F.lit("3"))
    out = va.annotated_only(t.lineitem.select("l_orderkey", "l_linenumber", info.alias("info")), "AAChange")
    return out.select("l_orderkey", "l_linenumber", F.col("info")["AAChange"].alias("change"), F.size("info").alias("n"))


# --- keys and hotspots -----------------------------------------------------------------------

@query("J06_hotspots", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_linenumber) IN (SELECT p_partkey, p_size % 7 + 1 FROM part WHERE p_size < 40)
 AND (l_partkey, l_linenumber) NOT IN (SELECT p_partkey, p_size % 7 + 1 FROM part WHERE p_size < 10)""")
def _(t):
    c = t.lineitem.select("l_orderkey", "l_linenumber", s("NM_", "l_partkey").alias("transcript"), s("c.", "l_linenumber").alias("chgvs"))
    hot = t.part.select("p_size", s("NM_", "p_partkey").alias("transcript"), s("c.", F.col("p_size") % 7 + 1).alias("chgvs"))
    return va.extract_hotspots(c, hot.filter("p_size < 40"), hot.filter("p_size < 10"), "transcript:chgvs").select("l_orderkey", "l_linenumber")


@query("J06_hotspot_rows", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R')")
def _(t):
    v = t.lineitem.filter("l_quantity > 48 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return va.detected_hotspot_rows(v, t.part.select("p_partkey", "p_name"), ["p_partkey"])


@query("J07_keyed", "SELECT p_partkey, p_brand || ':' || p_type || ':' || p_size AS var_id FROM part")
def _(t):
    df = t.part.select("p_partkey", F.col("p_brand").alias("gene"), F.col("p_type").alias("exon"), F.col("p_size").alias("start"))
    return va.keyed(df, "gene:exon:start").select("p_partkey", "var_id")


# --- summaries -------------------------------------------------------------------------------

_S8 = [f"s{i}" for i in range(8)]


@query("A13_mutated_gene_table", f"""WITH k AS (SELECT l_partkey % 60 AS gene, 's' || (l_suppkey % 8) AS sample FROM lineitem WHERE {_PASS}), g AS (SELECT DISTINCT p_size AS gene FROM part),
b AS (SELECT gene, {", ".join(f"count(*) FILTER (WHERE sample = '{x}') AS {x}" for x in _S8)} FROM g LEFT JOIN k USING (gene) GROUP BY 1)
SELECT CAST(gene AS VARCHAR) AS gene, {", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _S8)}, round(({" + ".join(f"CAST({x} > 0 AS INTEGER)" for x in _S8)}) / 8, 3) AS mutated_ratio FROM b
UNION ALL SELECT 'mutated_ratio', {", ".join(f"round(count(*) FILTER (WHERE {x} > 0) / count(*), 3)" for x in _S8)}, NULL FROM b""")
def _(t):
    passing = va.filter_paired(_paired(t), "a", "b").select(s("s", "k").alias("sample"), "gene")
    return va.mutated_gene_table(passing, t.part.select("p_size"), _S8)


def _alleles(t):
    return t.lineitem.select((F.col("l_suppkey") % 8).alias("sample"), F.call_function("repeat", F.lit("A"), F.col("l_linenumber")).alias("ref"), F.call_function("repeat", F.lit("C"), F.ceil(F.col("l_quantity") / 10).cast("int")).alias("alt"))


@query("A14_change_kinds", """WITH v AS (SELECT l_linenumber - CAST(ceil(l_quantity / 10) AS INTEGER) AS d FROM lineitem)
SELECT CASE WHEN d = 0 THEN 'snv' WHEN d > 0 THEN 'delete' ELSE 'insert' END AS kind, d AS length_change, count(*) AS n FROM v GROUP BY 1, 2""")
def _(t):
    return va.change_kinds(_alleles(t))


@query("A15_category_counts", "SELECT l_returnflag || l_linestatus AS category, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("category")).agg(F.count("*").alias("n"))


@query("A16_totals_by_fraction", f"""WITH {_CALLS}, e AS (SELECT af, count(*) FILTER (WHERE {_D} AND {_K}) AS "TP", count(*) FILTER (WHERE {_D} AND NOT {_K}) AS "FP", count(*) FILTER (WHERE NOT {_D} AND {_K}) AS "FN", count(*) FILTER (WHERE NOT {_D} AND NOT {_K}) AS "TN" FROM c GROUP BY ROLLUP (af))
SELECT *, round("TP" / ("TP" + "FN"), 4) AS sensitivity, round("TN" / ("TN" + "FP"), 4) AS specificity, round(CASE WHEN "TP" > 0 THEN "TP" / ("TP" + "FP") ELSE 0 END, 4) AS ppv, round("TN" / ("TN" + "FN"), 4) AS npv,
 round(("TP" + "TN") / ("TP" + "TN" + "FP" + "FN"), 4) AS accuracy FROM e""")
def _(t):
    d, k = F.expr(_D), F.expr(_K)
    one = lambda c: F.when(c, F.lit(1).cast("long")).otherwise(0)
    per = _calls(t).select("af", one(d & k).alias("TP"), one(d & ~k).alias("FP"), one(~d & k).alias("FN"), one(~d & ~k).alias("TN"))
    return ca.totals_by(per, "af").select("af", "TP", "FP", "FN", "TN", *rnd(4, "sensitivity", "specificity", "ppv", "npv", "accuracy"))


_CNV = """b AS (SELECT l_suppkey AS gene, l_discount * 40 - 1.5 + (l_suppkey % 7 - 3) * 2 AS x FROM lineitem), g AS (SELECT gene, avg(x) AS m, min(x) AS lo, max(x) AS hi FROM b GROUP BY 1),
k AS (SELECT 'G' || gene AS gene, m, CASE WHEN m > 0 THEN 'G' || gene || ' amplification' ELSE 'G' || gene || ' deletion' END AS event, gene AS id FROM g WHERE lo > log2(1.5) OR hi <= log2(0.6))"""


@query("A17_copy_number", f"""WITH {_CNV}
SELECT gene, round(m, 4) AS mean_log2, round(pow(2, m) * 2, 2) AS copies, CASE WHEN id % 2 = 0 THEN event ELSE '' END AS report_name, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 'yes' ELSE 'no' END AS report FROM k""")
def _(t):
    bins = t.lineitem.select(s("G", "l_suppkey").alias("gene"), (F.col("l_discount") * 40 - 1.5 + (F.col("l_suppkey") % 7 - 3) * 2).alias("log2"))
    sup = t.supplier.select("s_suppkey", s("G", "s_suppkey").alias("g"))
    events = sup.filter("s_suppkey % 2 = 0").select(s("", "g", " amplification").alias("e")).union(sup.filter("s_suppkey % 2 = 0").select(s("", "g", " deletion")))
    out = va.report_copy_number(va.copy_number(bins), events, sup.filter("s_suppkey % 3 = 0").select("g"))
    return out.withColumn("mean_log2", F.round("mean_log2", 4))


@query("A19_residue_lists", """WITH r AS (SELECT DISTINCT p_brand AS gene, p_size AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'E' ELSE 'K' END AS aa, p_partkey % 5 = 0 AS span FROM part WHERE p_partkey % 7 <> 0),
x AS (SELECT gene, pos, aa, 'p.' || aa || pos || CASE WHEN span THEN '_L' || (pos + 3) ELSE '' END AS residue FROM r)
SELECT gene, string_agg(residue, ',' ORDER BY pos, aa, residue) AS residues FROM x GROUP BY 1""")
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    head = F.concat(F.lit("p."), F.when(k % 2 == 0, "E").otherwise("K"), size.cast("string"))
    change = F.when(k % 7 == 0, "c.odd").when(k % 5 == 0, F.concat(head, s("_L", size + 3, "delinsG"))).otherwise(F.concat(head, F.lit("K")))
    return va.residue_lists(t.part.select(F.col("p_brand").alias("gene"), change.alias("phgvs")))


@query("A20_merge_variant_lists", "SELECT DISTINCT 'chr' || (l_suppkey % 22) AS chrom, l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.06")
def _(t):
    v = t.lineitem.select("l_tax", "l_discount", (F.col("l_suppkey") % 22).cast("string").alias("n"), F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"))
    return va.merge_variant_lists([v.filter("l_tax > 0.05").withColumn("chrom", F.concat(F.lit("chr"), "n")), v.filter("l_discount > 0.06").withColumnRenamed("n", "chrom")])


@query("A20_renamed_ids", "SELECT 'v' || l_orderkey || '-' || l_linenumber AS var_id, 'chr' || (l_suppkey % 22) || ':' || l_partkey || ':.:' || l_returnflag || ':' || l_linestatus AS new_id FROM lineitem")
def _(t):
    v = t.lineitem.select(F.concat(s("v", "l_orderkey"), s("-", "l_linenumber")).alias("var_id"), s("chr", F.col("l_suppkey") % 22).alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"))
    return va.renamed_ids(v)


@query("A20_first_occurrence", "SELECT o_custkey AS pos, o_orderstatus AS ref, min(o_orderkey) AS first_order, arg_min(o_totalprice, o_orderkey) AS qty FROM orders GROUP BY 1, 2")
def _(t):
    v = t.orders.select(F.col("o_custkey").alias("pos"), F.col("o_orderstatus").alias("ref"), F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("qty"), F.col("o_orderkey").alias("line_no"))
    return va.first_occurrence(v, ["pos", "ref"], "line_no").select("pos", "ref", "first_order", "qty")


@query("A21_dedupe_hotspots", """WITH h AS (SELECT o_custkey % 20 AS start, 'c.' || (o_orderkey % 9) || CASE WHEN o_orderkey % 2 = 0 THEN 'A>GT' ELSE 'del' END AS chgvs, CASE WHEN o_orderkey % 2 = 0 THEN 'A>GT' ELSE '' END AS bases,
 o_custkey % 40 AS tx, o_orderkey AS line_no FROM orders),
x AS (SELECT *, tx % 8 = 0 AS canon FROM h), y AS (SELECT *, count(*) FILTER (WHERE canon) OVER (PARTITION BY start, bases) AS n, min(line_no) OVER (PARTITION BY start, bases) AS f, row_number() OVER (PARTITION BY start, bases, tx ORDER BY line_no) AS rn FROM x)
SELECT start, chgvs, 'NM_' || tx || '.1' AS transcript, line_no FROM y WHERE (n = 0 AND line_no = f) OR (canon AND rn = 1)""")
def _(t):
    even = F.col("o_orderkey") % 2 == 0
    num = (F.col("o_orderkey") % 9).cast("string")
    one = F.concat(F.lit("c."), num, F.when(even, "A>GT").otherwise("del"))
    hot = t.orders.select(F.lit("chr1").alias("chrom"), (F.col("o_custkey") % 20).alias("start"), F.lit(1).alias("end"), F.concat(F.lit("c.1|"), one).alias("chgvs"), F.lit("p.").alias("phgvs"), s("NM_", F.col("o_custkey") % 40, ".1").alias("transcript"),
                            F.lit("G").alias("gene"), F.col("o_orderkey").alias("line_no"))
    canonical = t.part.filter("p_partkey % 8 = 0").select(s("NM_", "p_partkey", ".7").alias("t"))
    return va.dedupe_hotspots(hot, canonical).select("start", "chgvs", "transcript", "line_no")


def _two(t):
    return t.lineitem.select((F.col("l_suppkey") % 40).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("alt0"), F.col("l_quantity").alias("dp0"), F.col("l_discount").alias("af0"),
                             (F.col("l_linenumber") + 1).alias("alt1"), (F.col("l_quantity") - 1).alias("dp1"), (F.col("l_tax") + 0.01).alias("af1"))


_TWO = """c AS (SELECT l_suppkey % 40 AS file, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS alt0, l_quantity AS dp0, l_discount AS af0, l_linenumber + 1 AS alt1, l_quantity - 1 AS dp1, l_tax + 0.01 AS af1 FROM lineitem),
f AS (SELECT file, count(*) - count(*) FILTER (WHERE af0 > af1) >= count(*) FILTER (WHERE af0 > af1) AS tumour_second FROM c GROUP BY 1)"""


@query("X13_tumour_column", f"WITH {_TWO} SELECT file, tumour_second FROM f")
def _(t):
    return va.tumour_is_second(_two(t))


@query("X14_recomputed_fractions", f"""WITH {_TWO}, o AS (SELECT file, id, CASE WHEN tumour_second THEN alt1 ELSE alt0 END AS ta, CASE WHEN tumour_second THEN dp1 ELSE dp0 END AS td, CASE WHEN tumour_second THEN alt0 ELSE alt1 END AS na, CASE WHEN tumour_second THEN dp0 ELSE dp1 END AS nd FROM c JOIN f USING (file))
SELECT file, id, td AS "TDP", nd AS "NDP", CASE WHEN td <> 0 THEN round(ta / td, 3) END AS "TAF", CASE WHEN nd <> 0 THEN round(na / nd, 3) ELSE 0 END AS "NAF" FROM o""")
def _(t):
    return va.recomputed_fractions(_two(t))


@query("M32_purity_input", f"""WITH {_TWO} SELECT file, id AS "ID", round(CASE WHEN tumour_second THEN af1 ELSE af0 END * 100, 4) AS "Allele_Freq", CASE WHEN tumour_second THEN dp1 ELSE dp0 END AS "Depth", CAST(2 AS INTEGER) AS "Ploidy" FROM c JOIN f USING (file)""")
def _(t):
    return va.purity_input(_two(t)).withColumn("Allele_Freq", F.round("Allele_Freq", 4))


# --- evaluation ------------------------------------------------------------------------------

@query("J11_concordance", f"""WITH {_CALLS}, d AS (SELECT * FROM c WHERE {_D}), k AS (SELECT * FROM c WHERE {_K})
SELECT sample, var_id, d.af AS detected_af, k.af AS expected_af, CASE WHEN d.af IS NOT NULL AND k.af IS NOT NULL THEN 'Yes' ELSE 'No' END AS concordance FROM d FULL JOIN k USING (sample, var_id)""")
def _(t):
    return ca.concordance(_detected(t), _known(t))


_CONF = f"""{_CALLS}, p AS (SELECT sample, count(*) FILTER (WHERE {_D} AND {_K}) AS "TP", count(*) FILTER (WHERE {_D} AND NOT {_K}) AS "FP", count(*) FILTER (WHERE {_K} AND NOT {_D}) AS "FN" FROM c GROUP BY 1),
q AS (SELECT CAST(sample AS VARCHAR) AS sample, "TP", "FP", "FN", 50000 - "TP" - "FP" - "FN" AS "TN", FALSE AS tot FROM p),
z AS (SELECT * FROM q UNION ALL SELECT 'Total', CAST(sum("TP") AS BIGINT), CAST(sum("FP") AS BIGINT), CAST(sum("FN") AS BIGINT), CAST(sum("TN") AS BIGINT), TRUE FROM q)"""


def _wilson(x, n, sign):
    z = 1.959963984540054
    return f"(({x}) / ({n}) + {z * z} / (2 * ({n})) {sign} {z} * sqrt(({x}) / ({n}) * (1 - ({x}) / ({n})) / ({n}) + {z * z} / (4 * ({n}) * ({n})))) / (1 + {z * z} / ({n}))"


_ALL = '"TP" + "FP" + "FN" + "TN"'


@query("V01_evaluation", f"""WITH {_CONF} SELECT sample, "TP", "FP", "FN", "TN", round(("TP" + "TN") / ({_ALL}) * 100, 2) AS accuracy, coalesce(round("TP" / ("TP" + "FP") * 100, 2), 100) AS ppv, round("TN" / ("TN" + "FN") * 100, 2) AS npv,
 coalesce(round("TP" / ("TP" + "FN") * 100, 2), 100) AS sensitivity, round("TN" / ("TN" + "FP") * 100, 2) AS specificity,
 CASE WHEN tot THEN round({_wilson('"TP" + "TN"', _ALL, '-')}, 6) END AS accuracy_low, CASE WHEN tot THEN round({_wilson('"TP" + "TN"', _ALL, '+')}, 6) END AS accuracy_high,
 CASE WHEN tot THEN round({_wilson('"TP"', '"TP" + "FN"', '-')}, 6) END AS sensitivity_low, CASE WHEN tot THEN round({_wilson('"TP"', '"TP" + "FN"', '+')}, 6) END AS sensitivity_high FROM z""")
def _(t):
    d, k = [x.withColumn("sample", F.col("sample").cast("string")) for x in (_detected(t), _known(t))]
    out = ca.evaluation(d, k, 50000)
    return out.select("sample", "TP", "FP", "FN", "TN", "accuracy", "ppv", "npv", "sensitivity", "specificity", *rnd(6, "accuracy_low", "accuracy_high", "sensitivity_low", "sensitivity_high"))


@query("M33_wilson", f"""WITH {_CALLS}, a AS (SELECT sample, count(*) FILTER (WHERE {_D}) AS x, count(*) AS n FROM c GROUP BY 1)
SELECT sample, round({_wilson('x', 'n', '-')}, 6) AS low, round({_wilson('x', 'n', '+')}, 6) AS high FROM a""")
def _(t):
    low, high = ca.wilson(F.col("x"), F.col("n"))
    agg = _calls(t).groupBy("sample").agg(F.count_if(F.expr(_D)).alias("x"), F.count("*").alias("n"))
    return agg.select("sample", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("V02_low_known", f"""WITH {_CALLS}, d AS (SELECT * FROM c WHERE {_D}), k AS (SELECT * FROM c WHERE {_K}), low AS (SELECT * FROM k WHERE af < 0.1)
SELECT 'detected' AS side, sample, var_id, af FROM d ANTI JOIN low USING (sample, var_id) UNION ALL SELECT 'known', sample, var_id, af FROM k WHERE af >= 0.1 UNION ALL SELECT 'low', d.sample, d.var_id, d.af FROM d JOIN low USING (sample, var_id)""")
def _(t):
    parts = ca.split_low_known(_detected(t), _known(t), 0.1)
    named = [df.select(F.lit(n).alias("side"), "sample", "var_id", "af") for n, df in zip(("detected", "known", "low"), parts)]
    return named[0].union(named[1]).union(named[2])


# Repeats: the parts are mutations, the suppliers of a nation are the repeated samples. Later lines of an order expect the
# next part, so some expected mutations are not found.
def _repeats(t):
    found = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("var_id")).agg(F.max("l_discount").alias("af"))
    expected = F.col("l_partkey") + F.floor(F.col("l_linenumber") / 5)
    known = t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), expected.alias("var_id")).agg((F.min("l_linenumber") / 100).alias("af"))
    return found, known, t.supplier.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("sample"))


_REP = """d AS (SELECT l_suppkey AS sample, l_partkey AS var_id, max(l_discount) AS af FROM lineitem GROUP BY 1, 2), k AS (SELECT l_suppkey AS sample, l_partkey + l_linenumber // 5 AS var_id, min(l_linenumber) / 100 AS af FROM lineitem GROUP BY 1, 2),
g AS (SELECT s_nationkey AS grp, s_suppkey AS sample, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)"""
_SPREAD = """count(af) AS calls, max(n) AS trials, coalesce(min(af), 0) AS low, coalesce(max(af), 0) AS high, round(coalesce(avg(af), 0), 6) AS mean, round(coalesce(median(af), 0), 6) AS median, round(coalesce(stddev_samp(af), 0), 6) AS sd"""


@query("V03_replicate_stats", f"""WITH {_REP}, e AS (SELECT DISTINCT grp, var_id, n FROM k JOIN g USING (sample)), f AS (SELECT grp, var_id, af FROM d JOIN g USING (sample))
SELECT grp, var_id, {_SPREAD}, round(CASE WHEN coalesce(avg(af), 0) <> 0 THEN coalesce(stddev_samp(af), 0) / avg(af) ELSE 0 END, 6) AS cv, round(count(af) / max(n), 6) AS rate FROM e LEFT JOIN f USING (grp, var_id) GROUP BY 1, 2""")
def _(t):
    out = ca.replicate_stats(*_repeats(t))
    return out.select("grp", "var_id", "calls", "trials", "low", "high", *rnd(6, "mean", "median", "sd", "cv", "rate"))


@query("V04_detection_limit", f"""WITH {_REP}, e AS (SELECT sample, var_id, printf('%.2f%%', af * 100) AS expected FROM k WHERE af IN (0.01, 0.02, 0.05)), z AS (SELECT expected, count(*) AS n FROM e GROUP BY 1)
SELECT expected, {_SPREAD}, round(count(af) / max(n), 6) AS rate FROM e JOIN z USING (expected) LEFT JOIN d USING (sample, var_id) GROUP BY 1""")
def _(t):
    found, known, _ = _repeats(t)
    out = ca.detection_limit(found, known, (0.01, 0.02, 0.05))
    return out.select("expected", "calls", "trials", "low", "high", *rnd(6, "mean", "median", "sd", "rate"))


def _sets(t):
    li = t.lineitem.select((F.col("l_suppkey") % 8).alias("sample"), s("c", F.col("l_partkey") % 5).alias("chrom"), (F.col("l_orderkey") * 3).alias("pos"), F.lit("A").alias("ref"), F.when(F.col("l_linenumber") == 1, "CT").otherwise("G").alias("alt"), "l_returnflag", "l_tax", "l_quantity", "l_discount")
    introduced = li.filter("l_returnflag = 'A'")
    reported = li.filter("l_returnflag <> 'R' AND l_tax > 0.02").withColumn("pos", F.col("pos") + F.when(F.col("l_quantity") > 45, 2).otherwise(0))
    original = li.filter("l_discount > 0.09")
    reason = F.when(F.col("l_quantity") < 10, "polish").when(F.col("l_quantity") < 20, "af").otherwise("repeat")
    return introduced, reported, original, li.filter("l_quantity < 25").select("sample", "chrom", "pos", reason.alias("reason"))


_V5 = """li AS (SELECT l_suppkey % 8 AS sample, 'c' || (l_partkey % 5) AS chrom, l_orderkey * 3 AS pos, CASE WHEN l_linenumber = 1 THEN 'CT' ELSE 'G' END AS alt, l_returnflag, l_tax, l_quantity, l_discount FROM lineitem),
i AS (SELECT DISTINCT sample, chrom, pos, alt FROM li WHERE l_returnflag = 'A'), rp AS (SELECT DISTINCT sample, chrom, pos + CASE WHEN l_quantity > 45 THEN 2 ELSE 0 END AS pos, alt FROM li WHERE l_returnflag <> 'R' AND l_tax > 0.02),
og AS (SELECT DISTINCT chrom, pos, alt FROM li WHERE l_discount > 0.09), w AS (SELECT * FROM rp ANTI JOIN og USING (chrom, pos, alt)),
h AS (SELECT * FROM i SEMI JOIN w USING (sample, chrom, pos, alt)), m AS (SELECT * FROM i ANTI JOIN w USING (sample, chrom, pos, alt)), x AS (SELECT * FROM w ANTI JOIN i USING (sample, chrom, pos, alt)),
rj AS (SELECT sample, chrom, pos, min(CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 ELSE 3 END) AS why FROM li WHERE l_quantity < 25 GROUP BY 1, 2, 3),
mm AS (SELECT m.*, EXISTS (SELECT 1 FROM x WHERE x.sample = m.sample AND x.chrom = m.chrom AND abs(x.pos - m.pos) < 6) AS near, why FROM m LEFT JOIN rj USING (sample, chrom, pos)),
xx AS (SELECT x.*, EXISTS (SELECT 1 FROM m WHERE x.sample = m.sample AND x.chrom = m.chrom AND abs(x.pos - m.pos) < 6) AS near FROM x),
r AS (SELECT sample, 'hit' AS what, CASE WHEN alt = 'G' THEN 1 ELSE 0 END AS size FROM h UNION ALL SELECT sample, CASE WHEN near THEN 'position' WHEN why = 1 THEN 'polish' WHEN why = 2 THEN 'af' WHEN why = 3 THEN 'repeat' ELSE 'missed' END, CASE WHEN alt = 'G' THEN 1 ELSE 0 END FROM mm
 UNION ALL SELECT sample, CASE WHEN near THEN 'extra_near' ELSE 'extra' END, 0 FROM xx)"""


@query("V05_scored_evaluation", f"""WITH {_V5}
SELECT sample, count(*) FILTER (WHERE what IN ('hit', 'position', 'polish', 'af', 'repeat')) AS "TP", count(*) FILTER (WHERE what = 'extra') AS "FP", count(*) FILTER (WHERE what = 'missed') AS "FN",
 count(*) FILTER (WHERE what = 'extra_near') AS rescued_position, count(*) FILTER (WHERE what = 'polish') AS rescued_polish, count(*) FILTER (WHERE what = 'af') AS rescued_af, count(*) FILTER (WHERE what = 'repeat') AS rescued_repeat,
 CAST(1000000 - sum(size) - count(*) FILTER (WHERE what = 'missed') AS BIGINT) AS "TN" FROM r GROUP BY 1""")
def _(t):
    return ca.scored_evaluation(*_sets(t), 1_000_000, 6)


@query("V06_matrix_comparison", """WITH k AS (SELECT DISTINCT l_suppkey % 8 AS sample, l_partkey AS mutation FROM lineitem), p AS (SELECT DISTINCT l_partkey AS mutation FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.06),
n AS (SELECT count(DISTINCT mutation) AS seen FROM k SEMI JOIN p USING (mutation)), g AS (SELECT sample, count(*) AS positives, count(p.mutation) AS "TP" FROM k LEFT JOIN p USING (mutation) GROUP BY 1)
SELECT sample, positives, "TP", positives - "TP" AS "FP", seen - "TP" AS "FN", 300000 - positives - (seen - "TP") AS "TN" FROM g, n""")
def _(t):
    c = t.lineitem.select((F.col("l_suppkey") % 8).alias("sample"), F.col("l_partkey").alias("mutation"))
    return ca.matrix_comparison(c, t.lineitem.filter("l_quantity > 49 AND l_tax > 0.06").select(F.col("l_partkey").alias("mutation")), 300_000)


@query("V07_detection_table", """SELECT s.sample, coalesce(CAST(mutation AS VARCHAR), 'None') AS mutation, coalesce(af, 0) AS af, coalesce(depth, 0) AS depth FROM (SELECT c_custkey AS sample FROM customer) s
LEFT JOIN (SELECT o_custkey AS sample, o_orderkey AS mutation, (o_orderkey % 100) / 100 AS af, CAST(floor(o_totalprice / 1000) AS BIGINT) AS depth FROM orders WHERE o_totalprice > 400000) h USING (sample)""")
def _(t):
    hits = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("mutation"), ((F.col("o_orderkey") % 100) / 100).alias("af"), F.floor(F.col("o_totalprice") / 1000).alias("depth"))
    return ca.detection_table(t.customer.select(F.col("c_custkey").alias("sample")), hits)


def _lists(t):
    k = F.col("o_custkey")
    pair = lambda p, a, b: F.concat(s(p, a), s(f";{p}", b))
    return t.orders.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 8).alias("sample"), s("G", F.col("o_orderkey") % 30).alias("gene"), F.col("o_totalprice").alias("af"),
                             F.concat(s("NM_", k % 50), s(".2;NM_", k % 70, ".3")).alias("transcripts"), pair("c.", k % 50, k % 70).alias("chgvs_list"), pair("p.", k % 9, k % 8).alias("phgvs_list"))


@query("V08_first_hot_triple", """WITH r AS (SELECT o_orderkey AS row_id, o_orderkey % 8 AS sample, o_orderkey % 30 AS g, o_totalprice AS af, o_custkey % 50 AS a, o_custkey % 70 AS b, o_custkey % 9 AS p, o_custkey % 8 AS q FROM orders),
h AS (SELECT DISTINCT p_size % 30 AS g, p_partkey % 70 AS c FROM part WHERE p_size > 40), x AS (SELECT r.*, EXISTS (SELECT 1 FROM h WHERE h.g = r.g AND h.c = a) AS ha, EXISTS (SELECT 1 FROM h WHERE h.g = r.g AND h.c = b) AS hb FROM r)
SELECT row_id, sample, 'G' || g AS gene, af, 'NM_' || CASE WHEN ha THEN a || '.2' ELSE b || '.3' END AS transcript, 'c.' || CASE WHEN ha THEN a ELSE b END AS chgvs, 'p.' || CASE WHEN ha THEN p ELSE q END AS phgvs FROM x WHERE ha OR hb""")
def _(t):
    hot = t.part.filter("p_size > 40").select(s("G", F.col("p_size") % 30).alias("gene"), s("c.", F.col("p_partkey") % 70).alias("chgvs"))
    return ca.first_hot_triple(_lists(t), hot, ["gene", "chgvs"])


@query("V09_pick_parallel", """SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 50 % 6 <> 0 AND o_custkey % 70 % 6 = 0 THEN 'c.' || (o_custkey % 70) ELSE 'c.' || (o_custkey % 50) END AS chgvs, CASE WHEN o_custkey % 50 % 6 <> 0 AND o_custkey % 70 % 6 = 0 THEN 'p.' || (o_custkey % 8) ELSE 'p.' || (o_custkey % 9) END AS phgvs FROM orders""")
def _(t):
    canonical = t.part.filter("p_partkey % 6 = 0").select(s("NM_", "p_partkey", ".9").alias("t"))
    out = ca.pick_parallel(_lists(t), canonical, ["chgvs_list", "phgvs_list"])
    return out.select("row_id", F.col("chgvs_list").alias("chgvs"), F.col("phgvs_list").alias("phgvs"))


@query("V10_mapped_ids", """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN 'new' || o_orderkey ELSE 'old' || o_orderkey END AS new_id, o_totalprice FROM orders),
h AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'old' || o_orderkey ELSE 'new' || o_orderkey END AS new_id, o_custkey AS mutation FROM orders WHERE o_orderkey % 3 = 0) SELECT new_id, mutation, o_totalprice AS price FROM h LEFT JOIN x USING (new_id)""")
def _(t):
    k = F.col("o_orderkey")
    table = t.orders.select(s("old", "o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    mapping = t.orders.filter("o_orderkey % 4 <> 0").select(s("old", "o_orderkey").alias("old_id"), s("new", "o_orderkey").alias("new_id"))
    hits = t.orders.filter("o_orderkey % 3 = 0").select(F.when(k % 6 == 0, s("old", "o_orderkey")).otherwise(s("new", "o_orderkey")).alias("new_id"), F.col("o_custkey").alias("mutation"))
    return ca.mapped_ids(table, mapping, hits).select("new_id", "mutation", "price")


@query("V11_pair_verdicts", """SELECT o_orderkey AS pair, CASE WHEN (o_orderstatus = 'F') = (o_custkey % 5 = o_orderkey % 5) THEN 'success' ELSE 'problem' END AS outcome FROM orders""")
def _(t):
    name = lambda p, c: F.concat(F.lit(p), F.lit("TCGA-0"), (F.col(c) % 5).cast("string"), F.lit("-ABCD-x"), F.col(c).cast("string"))
    pairs = t.orders.select(F.col("o_orderkey").alias("pair"), name("a_", "o_custkey").alias("sample1"), name("b_", "o_orderkey").alias("sample2"), F.when(F.col("o_orderstatus") == "F", "matched").otherwise("unmatched").alias("verdict"))
    return ca.pair_verdicts(pairs).select("pair", "outcome")
