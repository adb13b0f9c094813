"""Rule and hierarchy queries. The parts make a tree: the parent of part k is k div 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import graph as gr
from helixframe.operators import relations as rel
from helixframe.operators import rules as ru
from helixframe.plans.files import s
from helixframe.plans.registry import Suite

suite = Suite()
query = suite.query


def _tree(t):
    k = F.col("p_partkey")
    return t.part.filter("p_partkey > 0").select(k.alias("node"), F.floor(k / 3).alias("parent"))


_TREE = "RECURSIVE tree AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0)"


@query("G01_descendants", f"""WITH {_TREE}, d AS (SELECT DISTINCT p_size AS root, CAST(p_size AS BIGINT) AS node FROM part WHERE p_size % 10 = 3 UNION ALL SELECT root, tree.node FROM d JOIN tree ON tree.parent = d.node)
SELECT CAST(root AS BIGINT) AS root, node FROM d""")
def _(t):
    return gr.descendants(_tree(t), t.part.filter("p_size % 10 = 3").select(F.col("p_size").cast("long").alias("root")))


@query("U09_subtree_expression", f"""WITH {_TREE}, d AS (SELECT r AS root, r AS node FROM (SELECT unnest([1, 4, 13, 2])::BIGINT AS r) UNION ALL SELECT root, tree.node FROM d JOIN tree ON tree.parent = d.node)
(SELECT node FROM d WHERE root = 1 EXCEPT SELECT node FROM d WHERE root = 13) INTERSECT SELECT node FROM d WHERE root = 4 UNION SELECT node FROM d WHERE root = 2""")
def _(t):
    return gr.subtree_expression(_tree(t), "1-13+4|2")


@query("G02_depth", f"""WITH {_TREE}, d AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT tree.node, depth + 1 FROM d JOIN tree ON tree.parent = d.node) SELECT node, CAST(max(depth) AS INTEGER) AS depth FROM d GROUP BY 1""")
def _(t):
    return gr.depth(_tree(t))


@query("G03_nodes_by_rank", "SELECT p_type AS rank, count(DISTINCT p_partkey) AS members, min(p_partkey) AS first_id FROM part GROUP BY 1")
def _(t):
    return gr.nodes_by_rank(t.part.select(F.col("p_partkey").alias("tax_id"), F.col("p_type").alias("rank")))


@query("G04_class_edges", """SELECT DISTINCT source, target FROM (SELECT 'c' || p_partkey AS source, 'c' || (p_partkey // 3) AS target FROM part WHERE p_partkey > 0
 UNION ALL SELECT p_brand || ':p.' || p_size, 'c' || (p_partkey * 2) FROM part WHERE p_partkey * 2 IN (SELECT p_partkey FROM part))""")
def _(t):
    tree = _tree(t).select(s("c", "node").alias("class"), s("c", "parent").alias("parent"))
    members = t.part.select(F.col("p_brand").alias("gene"), s("p.", "p_size").alias("protein"), s("c", F.col("p_partkey") * 2).alias("variant_class"))
    return gr.class_edges(tree, members)


# Chains of parts with the same remainder by 40 are the components.
@query("G05_components", "SELECT p_partkey AS node, p_partkey % 40 AS component FROM part")
def _(t):
    k = F.col("p_partkey")
    return gr.components(t.part.filter("p_partkey >= 40").select(k.alias("a"), (k % 40 + F.floor(F.floor(k / 40) / 2) * 40).alias("b")))


@query("G05_mixed_components", "SELECT p_partkey % 40 AS component, count(DISTINCT p_size) AS donors, count(*) AS members FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1")
def _(t):
    k = F.col("p_partkey")
    labels = gr.components(t.part.filter("p_partkey >= 40").select(k.alias("a"), (k % 40 + F.floor(F.floor(k / 40) / 2) * 40).alias("b")))
    return gr.mixed_components(labels, t.part.select(k.alias("node"), F.col("p_size").alias("donor")))


@query("T05_deepest_class", f"""WITH {_TREE}, d AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT tree.node, depth + 1 FROM d JOIN tree ON tree.parent = d.node)
SELECT l_orderkey AS row_id, CAST(max_by(l_partkey, CAST(depth AS BIGINT) * 1000000000 + l_partkey) AS BIGINT) AS class FROM lineitem JOIN d ON node = l_partkey GROUP BY 1""")
def _(t):
    choices = t.lineitem.select(F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("class"))
    return ru.deepest_class(choices, gr.depth(_tree(t)).withColumnRenamed("node", "class"))


# --- variant classes -------------------------------------------------------------------------

def _genes(t):
    n = t.part.select(F.col("p_size").alias("n")).distinct()
    pick = lambda c: n.filter(c).select(s("G", "n").alias("gene"))
    return {"deleterious": pick("n % 3 = 0"), "activating": pick("n % 3 = 1"), "splice": pick("n % 4 = 0"), "mutation": pick("n % 5 = 0"), "aberration": pick("n % 7 = 0")}, pick("n % 2 = 0")


def _variants(t):
    n, q = F.col("o_custkey") % 60, F.col("o_orderkey")
    return t.orders.select(
        q.alias("row_id"), s("G", n).alias("gene"), (q % 6).cast("string").alias("exon"), F.concat(F.lit("p.V"), (q % 11).cast("string"), F.lit("E")).alias("phgvs"),
        F.when(q % 4 == 0, "Deletion").otherwise("SNV").alias("kind"), F.when(q % 5 == 0, "Oncogenic").otherwise(".").alias("onco"), F.when(q % 7 == 0, "splicing").otherwise("exonic").alias("func"),
        F.when(q % 8 == 0, "stopgain").when(q % 8 == 1, "frameshift deletion").otherwise("nonsynonymous").alias("exonic_func"), F.lit(".").alias("clnrevstat"), F.lit(".").alias("clnsig"))


_R1 = """v AS (SELECT o_orderkey AS q, o_custkey % 60 AS n FROM orders), g AS (SELECT DISTINCT p_size AS n FROM part), x AS (SELECT q, v.n AS n, g.n IS NOT NULL AS known, g.n IS NOT NULL AND v.n % 2 = 0 AND (q % 7 = 0 OR q % 8 < 2) AS trunc, q % 5 = 0 AS patho FROM v LEFT JOIN g ON v.n = g.n),
y AS (SELECT *, 'G' || n AS gene, CASE WHEN known AND n % 3 = 0 THEN 'G' || n || ' deleterious mutation' WHEN known AND n % 3 = 1 THEN 'G' || n || ' activating mutation' END AS effect FROM x),
z AS (SELECT q, gene, patho, trunc, CASE WHEN n = 5 AND q % 11 = 3 THEN 'A' || n END AS c0,
 CASE WHEN n % 6 = 0 AND q % 11 = 4 THEN CASE WHEN q % 4 = 0 THEN gene || ' V4 deletion' ELSE gene || ' V4 mutation' END END AS c1, CASE WHEN n % 10 = 1 AND q % 6 = 2 THEN CASE WHEN q % 4 = 0 THEN gene || ' exon 2 deletion' END END AS c2,
 CASE WHEN patho THEN effect END AS c3, CASE WHEN trunc THEN effect END AS c4, CASE WHEN q % 7 = 0 AND known AND n % 4 = 0 THEN gene || ' splice site mutation' END AS c5, CASE WHEN known AND n % 5 = 0 THEN gene || ' mutation' END AS c6, CASE WHEN known AND n % 7 = 0 THEN gene || ' aberration' END AS c7 FROM y)"""


@query("R01_variant_classes", f"""WITH {_R1} SELECT q AS row_id, coalesce(c0, c1, c2, c3, c4, c5, c6, c7, '') AS variant_class, CASE WHEN c0 IS NOT NULL THEN 'exact' WHEN c1 IS NOT NULL THEN 'half known' WHEN c2 IS NOT NULL THEN 'exon' WHEN c3 IS NOT NULL THEN 'pathogenic'
 WHEN c4 IS NOT NULL THEN 'truncating' WHEN c5 IS NOT NULL THEN 'splice' WHEN c6 IS NOT NULL THEN 'mutation' WHEN c7 IS NOT NULL THEN 'aberration' ELSE '' END AS reason, CASE WHEN coalesce(c0, c1, c2, c3, c4, c5, c6, c7) IS NULL AND (patho OR trunc) THEN gene || ' mutation' ELSE '' END AS other_reportable FROM z""")
def _(t):
    genes, truncating = _genes(t)
    n = t.orders.select((F.col("o_custkey") % 60).alias("n")).distinct()
    exact = n.filter("n = 5").select(F.explode(F.array(s("A", "n"), s("B", "n"))).alias("variant_class"), s("G", "n").alias("gene"), F.lit("p.V3E").alias("protein"))
    half = n.filter("n % 6 = 0").select(s("G", "n").alias("gene"), F.lit("V4").alias("place"), F.explode(F.array(s("G", "n", " V4 deletion"), s("G", "n", " V4 mutation"))).alias("variant_class"))
    exon = n.filter("n % 10 = 1").select(s("G", "n").alias("gene"), F.lit("2").alias("place"), s("G", "n", " exon 2 deletion").alias("variant_class"))
    depths = n.filter("n = 5").select(F.explode(F.array(F.struct(s("A", "n").alias("class"), F.lit(3).alias("depth")), F.struct(s("B", "n").alias("class"), F.lit(2).alias("depth")))).alias("d")).select("d.*")
    return ru.classify_variants(_variants(t), exact, half, exon, genes, truncating, depths)


@query("R02_other_reportable", """WITH v AS (SELECT o_orderkey AS q, o_custkey % 60 AS n FROM orders), x AS (SELECT q, v.n, g.n IS NOT NULL AND v.n % 2 = 0 AND (q % 7 = 0 OR q % 8 < 2) AS hit FROM v LEFT JOIN (SELECT DISTINCT p_size AS n FROM part) g ON v.n = g.n)
SELECT q AS row_id, CASE WHEN hit THEN 'G' || n || CASE n % 3 WHEN 0 THEN ' deleterious mutation' WHEN 1 THEN ' activating mutation' ELSE ' mutation' END ELSE '' END AS other_reportable FROM x""")
def _(t):
    genes, truncating = _genes(t)
    return ru.other_reportable(_variants(t), truncating, genes["deleterious"], genes["activating"])


@query("R07_biomarker_labels", """WITH m AS (SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'MSI' ELSE 'TMB' END AS metric, o_custkey % 20 AS value FROM orders) SELECT sample, metric, value, CASE WHEN metric = 'MSI' AND value >= 10 THEN 'Microsatellite instability-High' WHEN metric = 'TMB' AND value >= 12 THEN 'Tumor Mutational Burden' ELSE '' END AS report_name FROM m""")
def _(t):
    return ru.biomarker_labels(_markers(t), {"MSI": (10, "Microsatellite instability-High"), "TMB": (12, "Tumor Mutational Burden")})


def _markers(t):
    return t.orders.select(F.col("o_orderkey").alias("sample"), F.when(F.col("o_orderkey") % 2 == 0, "MSI").otherwise("TMB").alias("metric"), (F.col("o_custkey") % 20).alias("value"))


@query("R07_query_list", """SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 2 = 0 THEN 'MSI-H' ELSE 'TMB-H' END AS name FROM orders WHERE o_custkey % 20 >= 10 UNION SELECT l_orderkey, 'G' || l_suppkey || ' amplification' FROM lineitem WHERE l_quantity > 48""")
def _(t):
    labels = ru.biomarker_labels(_markers(t), {"MSI": (10, "MSI-H"), "TMB": (10, "TMB-H")})
    cnv = t.lineitem.select(F.col("l_orderkey").alias("sample"), F.when(F.col("l_quantity") > 48, s("G", "l_suppkey", " amplification")).otherwise("").alias("report_name"))
    return ru.query_list(labels, cnv)


# --- protein families: orders are proteins, line numbers of the items are domains -------------

def _hits(t):
    return t.lineitem.select(F.col("l_orderkey").alias("query_id"), s("PF0000", "l_linenumber", ".3").alias("pfam_id"), F.col("l_quantity").alias("score"))


_DC = "c AS (SELECT l_orderkey AS query_id, l_linenumber AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query("A12_domain_counts", f"WITH {_DC} SELECT query_id, 'PF0000' || d AS domain, n FROM c")
def _(t):
    return ru.domain_counts(_hits(t))


def _rules(t):
    """The rules are a parameter of the query, not data."""
    rows = [("AP", "AP2", "D1 (>=2) (PF00001)", "-", "-"), ("AP", "AP1", "D1 (1) (PF00001)", "-", "D3 (PF00003)"), ("B", "B2", "D2 (PF00002) and D4 (PF00004)", "D5 (PF00005)", "-"), ("C", "C1", "D6 (PF00006)", "D7 (PF00007)", "D1 (PF00001)"), ("C", "C2", "D6 (<=1) (PF00006)", "D2 (PF00002)", "-")]
    return ru.parse_family_rules(t.spark.createDataFrame(rows, "family string, subfamily string, binding string, auxiliary string, forbidden string"))


@query("R03_families", f"""WITH {_DC}, w AS (SELECT query_id, {", ".join(f"coalesce(max(n) FILTER (WHERE d = {i}), 0) AS d{i}" for i in range(1, 8))} FROM c GROUP BY 1),
h AS (SELECT query_id, 'AP2' AS family FROM w WHERE d1 >= 2 UNION SELECT query_id, 'AP1' FROM w WHERE d1 = 1 AND d3 = 0 UNION SELECT query_id, CASE WHEN d5 > 0 THEN 'B2' ELSE 'B' END FROM w WHERE d2 >= 1 AND d4 >= 1
 UNION SELECT query_id, 'C1' FROM w WHERE d6 >= 1 AND d7 > 0 AND d1 = 0 UNION SELECT query_id, 'C2' FROM w WHERE d6 = 1 AND d2 > 0
 UNION SELECT query_id, 'C' FROM w WHERE ((d6 >= 1 AND d7 = 0 AND d1 = 0) OR (d6 = 1 AND d2 = 0)) AND NOT (d6 >= 1 AND d7 > 0 AND d1 = 0) AND NOT (d6 = 1 AND d2 > 0)) SELECT * FROM h""")
def _(t):
    return ru.judge_families(ru.domain_counts(_hits(t)), _rules(t))


@query("R04_family_by_domain", f"WITH {_DC} SELECT query_id, 'PF0000' || d AS domain, 'Fam' || d AS family FROM c WHERE d % 2 = 0")
def _(t):
    lookup = t.lineitem.filter("l_linenumber % 2 = 0").select(s("PF0000", "l_linenumber").alias("domain"), s("Fam", "l_linenumber").alias("family")).distinct()
    return ru.family_by_domain(ru.domain_counts(_hits(t)), lookup)


def _blast(t):
    return t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("hit_order"), F.col("o_orderkey").alias("hit_id"), F.col("o_totalprice").alias("identity"), F.col("o_orderpriority").alias("organism"))


@query("T04_best_hits", "SELECT o_custkey AS query_id, min_by(o_orderkey, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 0 ELSE 1000000000 END + o_orderkey) AS hit_id FROM orders GROUP BY 1")
def _(t):
    return ru.best_hits(_blast(t), "1-URGENT").select("query_id", "hit_id")


@query("R05_family_report", f"""WITH {_DC}, b AS (SELECT o_custkey AS query_id, min(o_orderkey) AS hit_id, arg_min(o_totalprice, o_orderkey) AS identity FROM orders GROUP BY 1), m AS (SELECT l_orderkey AS query_id, l_linenumber AS d, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)
SELECT c.query_id, 'Fam' || c.d AS family, 'PF0000' || c.d AS domain, score, coalesce(CAST(hit_id AS VARCHAR), 'None') AS hit_id, coalesce(identity, -1) AS identity FROM c JOIN m ON c.query_id = m.query_id AND c.d = m.d LEFT JOIN b ON c.query_id = b.query_id WHERE c.d % 2 = 0""")
def _(t):
    lookup = t.lineitem.filter("l_linenumber % 2 = 0").select(s("PF0000", "l_linenumber").alias("domain"), s("Fam", "l_linenumber").alias("family")).distinct()
    fam = ru.family_by_domain(ru.domain_counts(_hits(t)), lookup)
    domains = _hits(t).withColumn("domain", F.split("pfam_id", r"\.")[0])
    return ru.family_report(fam, domains, ru.best_hits(_blast(t), "none"))


@query("F19_by_id_list", "SELECT p_partkey AS id, TRUE AS kept FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT p_partkey, FALSE FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    ids = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    records = t.part.select(F.col("p_partkey").alias("id"))
    return rel.select_table(records, [], "id", ids).withColumn("kept", F.lit(True)).union(records.join(ids, "id", "left_anti").withColumn("kept", F.lit(False)))
