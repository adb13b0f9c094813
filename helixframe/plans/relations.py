"""Set, join and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.means import rounded_mean
from helixframe.operators import relations as rel
from helixframe.operators import sets
from helixframe.plans import bindings as b
from helixframe.plans.bindings import COUNTS
from helixframe.plans.registry import Suite

suite = Suite()
query = suite.query


# Four sets: orders with a line of each return flag, or with a large discount.
def _sets(t):
    li = t.lineitem
    return {
        "s1": li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("element")).distinct(),
        "s2": li.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("element")).distinct(),
        "s3": li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("element")).distinct(),
        "s4": li.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("element")).distinct(),
    }


_SETS = """s1 AS (SELECT DISTINCT l_orderkey AS element FROM lineitem WHERE l_returnflag = 'A'),
s2 AS (SELECT DISTINCT l_orderkey AS element FROM lineitem WHERE l_returnflag = 'N'),
s3 AS (SELECT DISTINCT l_orderkey AS element FROM lineitem WHERE l_returnflag = 'R'),
s4 AS (SELECT DISTINCT l_orderkey AS element FROM lineitem WHERE l_discount > 0.08),
m AS (SELECT 's1' AS name, element FROM s1 UNION ALL SELECT 's2', element FROM s2 UNION ALL SELECT 's3', element FROM s3
 UNION ALL SELECT 's4', element FROM s4)"""
_NAMES = ["s1", "s2", "s3", "s4"]


@query("U01_intersection", f"WITH {_SETS} SELECT element FROM s1 INTERSECT SELECT element FROM s2 INTERSECT SELECT element FROM s3 INTERSECT SELECT element FROM s4")
def _(t):
    return sets.intersection(list(_sets(t).values()))


@query("U02_union", f"WITH {_SETS} SELECT DISTINCT element FROM m")
def _(t):
    return sets.union(list(_sets(t).values()))


@query("U03_in_at_least", f"WITH {_SETS} SELECT element, count(*) AS n_sets FROM m GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    return sets.in_at_least(sets.named(_sets(t)), 3)


@query("U04_expression", f"""WITH {_SETS}
(SELECT element FROM s1 EXCEPT SELECT element FROM s2) UNION (SELECT element FROM s3 INTERSECT SELECT element FROM s4)""")
def _(t):
    return sets.evaluate(sets.named(_sets(t)), _NAMES, "s1-s2|s3&s4")


_REGIONS = """SELECT region, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent
FROM (SELECT element, string_agg(name, '&' ORDER BY name) AS region FROM m GROUP BY 1) GROUP BY 1"""


@query("U05_regions", f"WITH {_SETS} {_REGIONS}")
def _(t):
    return sets.regions(sets.named(_sets(t)), _NAMES).withColumn("percent", F.round("percent", 4))


@query("U05_grouped_regions", f"""WITH {_SETS}
SELECT 'left' AS grouping, * FROM ({_REGIONS.replace('FROM m', "FROM m WHERE name IN ('s1', 's2')")})
UNION ALL SELECT 'right', * FROM ({_REGIONS.replace('FROM m', "FROM m WHERE name IN ('s2', 's3', 's4')")})""")
def _(t):
    out = sets.grouped_regions(sets.named(_sets(t)), {"left": ["s1", "s2"], "right": ["s2", "s3", "s4"]})
    return out.withColumn("percent", F.round("percent", 4))


@query("U06_columns_as_sets", """SELECT DISTINCT name, element FROM (
 SELECT 'p_brand' AS name, p_brand AS element FROM part UNION ALL SELECT 'p_type', p_type FROM part
 UNION ALL SELECT 'p_name', CASE WHEN p_size > 10 THEN p_name END FROM part) WHERE element IS NOT NULL""")
def _(t):
    table = t.part.select("p_brand", "p_type", F.when(F.col("p_size") > 10, F.col("p_name")).alias("p_name"))
    return sets.from_columns(table, ["p_brand", "p_type", "p_name"])


@query("U07_hits_and_misses", """WITH d AS (SELECT DISTINCT o_custkey % 10 AS sample, o_orderkey AS var FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT DISTINCT o_custkey % 10 AS sample, o_orderkey AS var FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')
SELECT coalesce(d.sample, k.sample) AS sample, coalesce(d.var, k.var) AS var,
 CASE WHEN d.var IS NOT NULL AND k.var IS NOT NULL THEN 'TP' WHEN d.var IS NOT NULL THEN 'FP' ELSE 'FN' END AS outcome
FROM d FULL JOIN k ON d.sample = k.sample AND d.var = k.var""")
def _(t):
    calls = t.orders.select((F.col("o_custkey") % 10).alias("sample"), F.col("o_orderkey").alias("var"), "o_orderstatus", "o_orderpriority")
    return sets.hits_and_misses(
        calls.filter("o_orderstatus <> 'P'"), calls.filter("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'"), ["sample", "var"]
    )


_VAR = "v AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem)"


def _variants(t):
    return t.lineitem.select(
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), F.col("l_orderkey").alias("pos"),
        F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"),
    )


@query("U08_exclude_listed", """SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem
WHERE (l_suppkey % 22, l_orderkey, l_returnflag, l_linestatus) NOT IN
 (SELECT l_suppkey % 22, l_orderkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 25)""")
def _(t):
    gone = t.lineitem.filter("l_quantity > 25").select(
        (F.col("l_suppkey") % 22 + 1).cast("string").alias("chrom"), F.col("l_orderkey").alias("pos"),
        F.lower("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"),
    )
    return sets.exclude_listed(_variants(t), gone, ["chrom", "pos", "ref", "alt"])


@query("U10_formatted_union", """SELECT DISTINCT 'chr' || (l_suppkey % 22 + 1) || ':' || l_orderkey || ',' || l_returnflag || '>' || l_linestatus AS key
FROM lineitem WHERE l_tax > 0.06 OR l_discount > 0.08""")
def _(t):
    v = t.lineitem.select("l_tax", "l_discount", (F.col("l_suppkey") % 22 + 1).alias("c"), "l_orderkey", "l_returnflag", "l_linestatus")
    return sets.formatted_union(
        [v.filter("l_tax > 0.06"), v.filter("l_discount > 0.08")], "chr%d:%d,%s>%s", ["c", "l_orderkey", "l_returnflag", "l_linestatus"]
    )


# --- projections -----------------------------------------------------------------------------

@query("F01_select_table", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49.5)")
def _(t):
    rows = t.lineitem.filter("l_quantity > 49.5").select(F.col("l_partkey").alias("p_partkey"))
    return rel.select_table(t.part, ["p_name", "p_size"], "p_partkey", rows)


@query("F02_rename", """SELECT coalesce(CASE WHEN n_nationkey < 5 THEN 'new_' || n_name END, n_name) AS key, count(*) AS members
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    mapping = t.nation.filter("n_nationkey < 5").select(F.col("n_name").alias("old"), F.concat(F.lit("new_"), "n_name").alias("new"))
    return rel.rename_columns(rel.rename_keys(df, "n_name", mapping), {"n_name": "key", "n": "members"})


@query("F14_multi_gene_membership", """SELECT p_partkey AS row_id, replace(p_name, ' ', ';') AS genes FROM part
WHERE len(list_filter(string_split(p_name, ' '), lambda x: x IN ('red', 'ring', 'large'))) > 0""")
def _(t):
    df = t.part.select(F.col("p_partkey").alias("row_id"), F.replace("p_name", F.lit(" "), F.lit(";")).alias("genes"))
    targets = t.part.select(F.explode(F.split("p_name", " ")).alias("gene")).filter(F.col("gene").isin("red", "ring", "large"))
    return rel.multi_gene_membership(df, "genes", targets)


@query("F15_subnetwork", """WITH q AS (SELECT p_partkey AS k FROM part WHERE p_size > 25), n AS (SELECT l_partkey AS source, l_suppkey AS target FROM lineitem)
SELECT 'both' AS mode, source, target FROM n WHERE source IN (SELECT k FROM q) AND target IN (SELECT k FROM q)
UNION ALL SELECT 'either', source, target FROM n WHERE source IN (SELECT k FROM q) OR target IN (SELECT k FROM q)""")
def _(t):
    net = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    q = t.part.filter("p_size > 25").select("p_partkey")
    both = rel.subnetwork(net, q).withColumn("mode", F.lit("both"))
    return both.unionByName(rel.subnetwork(net, q, either=True).withColumn("mode", F.lit("either")))


# --- joins -----------------------------------------------------------------------------------

@query("J01_merge_tables", """SELECT coalesce(a.k, b.k, c.k) AS key, orders_n, lines_n, size FROM
 (SELECT o_custkey AS k, count(*) AS orders_n FROM orders GROUP BY 1) a
 FULL JOIN (SELECT l_suppkey AS k, count(*) AS lines_n FROM lineitem GROUP BY 1) b ON a.k = b.k
 FULL JOIN (SELECT p_partkey AS k, p_size AS size FROM part) c ON coalesce(a.k, b.k) = c.k""")
def _(t):
    return rel.merge_tables(
        [
            t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders_n")),
            t.lineitem.groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("lines_n")),
            t.part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")),
        ],
        ["key"],
    )


@query("J01_merge_by_position", """SELECT coalesce(a.row_no, b.row_no) AS row_no, name, total FROM
 (SELECT row_number() OVER (ORDER BY p_partkey) AS row_no, p_name AS name FROM part) a
 FULL JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_no, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F') b ON a.row_no = b.row_no""")
def _(t):
    parts = t.part.select("p_partkey", F.col("p_name").alias("name"))
    orders = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("total"))
    return rel.merge_by_position([(parts, "p_partkey"), (orders, "o_orderkey")])


_S = [f"s{i}" for i in range(8)]


@query("J02_to_matrix", f"""WITH {COUNTS} SELECT gene, {", ".join(f"max(value) FILTER (WHERE sample = '{s}') AS {s}" for s in _S)} FROM counts GROUP BY 1""")
def _(t):
    return rel.to_matrix(b.counts(t), "gene", "sample", "value", _S)


@query("J03_annotate", """SELECT o_orderkey AS order_key, o_custkey AS key, coalesce(c_mktsegment, 'None') AS segment FROM orders LEFT JOIN
 (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def _(t):
    df = t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("key"))
    ann = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return rel.annotate(df, "key", ann)


@query("J04_multi_hop", """SELECT DISTINCT p_brand AS source, n_name AS target FROM part JOIN lineitem ON p_partkey = l_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    return rel.compose(
        t.part.select("p_brand", "p_partkey"), t.lineitem.select("l_partkey", "l_suppkey"),
        t.supplier.select("s_suppkey", "s_nationkey"), t.nation.select("n_nationkey", "n_name"),
    )


@query("J05_compose", """SELECT DISTINCT o_custkey AS source, l_partkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    return rel.compose(t.orders.select("o_custkey", "o_orderkey"), t.lineitem.select("l_orderkey", "l_partkey"))


_J8 = """d AS (SELECT l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt, min(l_quantity) AS qty FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt, max(l_tax) AS tax FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2, 3),
x AS (SELECT DISTINCT l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem WHERE l_tax > 0.07)"""


@query("J08_variant_key_join", f"""WITH {_J8}
SELECT d.pos, d.ref, d.alt, qty, tax, x.pos IS NOT NULL AS expected FROM d LEFT JOIN a USING (pos, ref, alt) LEFT JOIN x ON d.pos = x.pos AND d.ref = x.ref AND d.alt = x.alt""")
def _(t):
    keys = ["pos", "ref", "alt"]
    li = t.lineitem.select(F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), "l_quantity", "l_tax", "l_discount")
    d = li.groupBy(*keys).agg(F.min("l_quantity").alias("qty"))
    a = li.filter("l_discount > 0.05").groupBy(*keys).agg(F.max("l_tax").alias("tax"))
    return rel.variant_key_join(d, a, keys, "left", li.filter("l_tax > 0.07"))


@query("J08_missing_expected", """SELECT DISTINCT l_orderkey AS pos, l_returnflag AS ref FROM lineitem WHERE l_tax > 0.07
EXCEPT SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_discount > 0.03""")
def _(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("ref"), "l_tax", "l_discount")
    return rel.missing_expected(li.filter("l_discount > 0.03"), li.filter("l_tax > 0.07"), ["pos", "ref"])


@query("J09_merge_prefixed", """SELECT coalesce(a.k, b.k) AS key, a.n AS a_n, a.total AS a_total, b.n AS b_n, b.total AS b_total FROM
 (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN
 (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20 GROUP BY 1) b ON a.k = b.k""")
def _(t):
    def part(condition):
        return t.lineitem.filter(condition).groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))

    return rel.merge_prefixed({"a": part("l_returnflag = 'A'"), "b": part("l_returnflag = 'R' AND l_quantity > 20")}, ["key"])


@query("J10_compare_pairs", """WITH a AS (SELECT l_suppkey % 8 AS sample, l_partkey AS mutation, max(l_discount) AS af, count(*) AS depth FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
r AS (SELECT l_suppkey % 8 AS sample, l_partkey AS mutation, max(l_discount) AS af, count(*) AS depth FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
p AS (SELECT DISTINCT s_suppkey % 8 AS ls, (s_suppkey + 1) % 8 AS rs FROM supplier),
x AS (SELECT ls, rs, mutation, af, depth FROM a JOIN p ON sample = ls), y AS (SELECT ls, rs, mutation, af, depth FROM r JOIN p ON sample = rs)
SELECT ls AS left_sample, rs AS right_sample, mutation, coalesce(x.af, 0) AS left_af, coalesce(y.af, 0) AS right_af, coalesce(x.depth, 0) AS left_depth,
 coalesce(y.depth, 0) AS right_depth, CASE WHEN x.af IS NOT NULL AND y.af IS NOT NULL THEN 'yes' ELSE 'no' END AS consistent FROM x FULL JOIN y USING (ls, rs, mutation)""")
def _(t):
    def calls(flag):
        return t.lineitem.filter(F.col("l_returnflag") == flag).groupBy((F.col("l_suppkey") % 8).alias("sample"), F.col("l_partkey").alias("mutation")).agg(
            F.max("l_discount").alias("af"), F.count("*").alias("depth"))

    pairs = t.supplier.select((F.col("s_suppkey") % 8).alias("left_sample"), ((F.col("s_suppkey") + 1) % 8).alias("right_sample")).distinct()
    return rel.compare_pairs(calls("A"), calls("R"), pairs)


@query("J12_expand_groups", """WITH k AS (SELECT DISTINCT p_brand AS grp, unnest(string_split(p_name, ' ')) AS mutation FROM part),
d AS (SELECT DISTINCT p_brand AS grp, 'x' || p_size AS sample FROM part UNION SELECT DISTINCT p_brand, 'y' || p_size FROM part)
SELECT grp, sample, mutation FROM k JOIN d USING (grp)""")
def _(t):
    known = t.part.select(F.col("p_brand").alias("grp"), F.replace("p_name", F.lit(" "), F.lit(";")).alias("mutations"))
    size = F.col("p_size").cast("string")
    design = t.part.select(F.col("p_brand").alias("grp"), F.concat(F.lit("x"), size, F.lit(";y"), size).alias("sample_ids"))
    return rel.expand_groups(known, design)


@query("J18_match_samples", """WITH o AS (SELECT c_name AS sample, c_custkey AS line_no FROM customer), a AS (SELECT DISTINCT s_name AS raw,
 'Customer#' || right(s_name, 7) || 'zzzz' AS sample FROM supplier)
SELECT a.sample, min_by(o.sample, o.line_no) AS original FROM a LEFT JOIN o ON starts_with(left(o.sample, length(o.sample) - 4), left(a.sample, length(a.sample) - 4)) GROUP BY 1""")
def _(t):
    orig = t.customer.select(F.col("c_name").alias("sample"), F.col("c_custkey").alias("line_no"))
    again = t.supplier.select(F.concat(F.lit("Customer#"), F.right("s_name", F.lit(7)), F.lit("zzzz")).alias("sample")).distinct()
    return rel.match_samples(again, orig)


@query("J18_append_lists", """WITH o AS (SELECT c_name AS sample, c_custkey AS line_no, 'r' || c_custkey AS reads FROM customer), a AS (SELECT DISTINCT left(c_name, length(c_name) - 2) || 'zz' AS sample FROM customer WHERE c_custkey % 7 = 0),
m AS (SELECT a.sample, 's' || a.sample AS more, min_by(o.sample, o.line_no) AS original FROM a JOIN o ON starts_with(left(o.sample, length(o.sample) - 2), left(a.sample, length(a.sample) - 2)) GROUP BY 1)
SELECT coalesce(m.sample, o.sample) AS sample, o.reads || coalesce(',' || more, '') AS reads FROM o LEFT JOIN m ON m.original = o.sample""")
def _(t):
    orig = t.customer.select(F.col("c_name").alias("sample"), F.col("c_custkey").alias("line_no"), F.array(F.concat(F.lit("r"), F.col("c_custkey").cast("string"))).alias("reads"))
    name = F.concat(F.substring("c_name", F.lit(1), F.length("c_name") - 2), F.lit("zz"))
    again = t.customer.filter("c_custkey % 7 = 0").select(name.alias("sample")).distinct().withColumn("reads", F.array(F.concat(F.lit("s"), F.col("sample"))))
    out = rel.append_lists(orig.select("sample", "reads"), again, rel.match_samples(again.select("sample"), orig, 2))
    return out.select("sample", F.array_join("reads", ",").alias("reads"))


@query("J19_index_pairs", """WITH s AS (SELECT n_name AS sample, n_nationkey AS a, n_nationkey + 30 AS b FROM nation)
SELECT l_orderkey AS read_id, l_linenumber AS line, sample FROM lineitem JOIN s ON
 least('i' || (l_partkey % 25 + CASE WHEN l_linenumber % 2 = 0 THEN 30 ELSE 0 END), 'i' || (l_partkey % 25 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 30 END)) = least('i' || a, 'i' || b)
 AND greatest('i' || (l_partkey % 25 + 30), 'i' || (l_partkey % 25)) = greatest('i' || a, 'i' || b)""")
def _(t):
    def idx(c):
        return F.concat(F.lit("i"), c.cast("string"))

    base, even = F.col("l_partkey") % 25, F.col("l_linenumber") % 2 == 0
    reads = t.lineitem.select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("line"),
        idx(base + F.when(even, 30).otherwise(0)).alias("i1"), idx(base + F.when(even, 0).otherwise(30)).alias("i2"),
    )
    sheet = t.nation.select(F.col("n_name").alias("sample"), idx(F.col("n_nationkey")).alias("p7"), idx(F.col("n_nationkey") + 30).alias("p5"))
    return rel.by_index_pair(reads, sheet).select("read_id", "line", "sample")


@query("J20_contained_change", """SELECT p_partkey AS id, p_brand AS gene, p_name AS change FROM part a WHERE EXISTS (
 SELECT 1 FROM part h WHERE h.p_size > 45 AND h.p_brand = a.p_brand AND contains(a.p_name, string_split(h.p_name, ' ')[1]))""")
def _(t):
    table = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("gene"), F.col("p_name").alias("change"))
    hot = t.part.filter("p_size > 45").select(F.col("p_brand").alias("gene"), F.concat(F.lit("("), F.split("p_name", " ")[0], F.lit(")")).alias("phgvs"))
    return rel.contained_change(table, hot)


@query("J21_symbol_to_id", """WITH reg AS (SELECT p_partkey, p_partkey % 5 = 0 AS withdrawn FROM part),
names AS (SELECT 'sym' || p_partkey AS k, 'ENS' || p_partkey AS gene_id FROM reg WHERE NOT withdrawn
 UNION SELECT 'prev' || (p_partkey // 2), 'ENS' || p_partkey FROM reg WHERE NOT withdrawn
 UNION SELECT 'ali' || (p_partkey // 3), 'ENS' || p_partkey FROM reg WHERE NOT withdrawn),
old AS (SELECT 'sym' || p_partkey AS k, 'sym' || (p_partkey + 1) AS successor FROM reg WHERE withdrawn),
st AS (SELECT 'sym' || p_partkey AS k, 'KNOWN' || p_partkey AS gene_id, 1 AS stage FROM part WHERE p_partkey % 7 = 0
 UNION SELECT k, gene_id, 2 FROM names UNION SELECT old.k, gene_id, 3 FROM old JOIN names ON successor = names.k),
q AS (SELECT DISTINCT 'SYM' || (p_partkey + 3) AS query FROM part UNION SELECT DISTINCT 'Prev' || p_partkey FROM part UNION SELECT DISTINCT 'ALI' || p_partkey FROM part),
f AS (SELECT query, gene_id, stage, min(stage) OVER (PARTITION BY query) AS best FROM q LEFT JOIN st ON lower(query) = k)
SELECT query, gene_id, stage FROM f WHERE best IS NULL OR stage = best""")
def _(t):
    k = F.col("p_partkey")
    withdrawn = k % 5 == 0

    def name(prefix, n):
        return F.concat(F.lit(prefix), n.cast("string"))

    registry = t.part.select(
        F.when(withdrawn, F.concat(name("sym", k), F.lit("~withdrawn"))).otherwise(name("sym", k)).alias("symbol"),
        F.when(withdrawn, F.concat(F.lit("symbol withdrawn, see "), name("SYM", k + 1))).otherwise(name("gene ", k)).alias("name"),
        name("PREV", F.floor(k / 2)).alias("previous"), F.concat(name("ali", F.floor(k / 3)), F.lit(", "), name("ALI", F.floor(k / 3))).alias("alias"),
        name("ENS", k).alias("gene_id"),
    )
    known = t.part.filter("p_partkey % 7 = 0").select(name("Sym", k).alias("symbol"), name("KNOWN", k).alias("gene_id"))
    queries = (
        t.part.select(name("SYM", k + 3).alias("query")).union(t.part.select(name("Prev", k))).union(t.part.select(name("ALI", k)))
    )
    return rel.symbol_to_id(queries, known, registry)


@query("J22_classify_sequences", """WITH s AS (SELECT 'D' || doc_id AS seq_id, doc_id FROM documents),
a AS (SELECT 'D' || doc_id AS seq_id, n_chars % 200 AS tax_id FROM documents WHERE doc_id % 9 <> 0),
m AS (SELECT DISTINCT n_chars % 200 AS tax_id, n_chars % 200 + 1000 AS new_id FROM documents WHERE n_chars % 200 < 20),
n AS (SELECT DISTINCT tax_id, 'taxon ' || tax_id AS tax_name FROM (SELECT n_chars % 200 AS tax_id FROM documents UNION SELECT n_chars % 200 + 1000 FROM documents) WHERE tax_id % 2 = 0),
g AS (SELECT DISTINCT tax_id, CASE WHEN tax_id % 3 = 0 THEN 'plants' ELSE 'fungi' END AS taxon FROM (SELECT n_chars % 200 AS tax_id FROM documents UNION SELECT n_chars % 200 + 1000 FROM documents) WHERE tax_id % 3 < 2),
c AS (SELECT seq_id, coalesce(new_id, a.tax_id) AS tax_id FROM s LEFT JOIN a USING (seq_id) LEFT JOIN m ON a.tax_id = m.tax_id)
SELECT seq_id, c.tax_id, CASE WHEN c.tax_id IS NOT NULL THEN coalesce(tax_name, 'None') END AS tax_name, taxon,
 CASE WHEN c.tax_id IS NULL THEN 'accession unknown' WHEN taxon IS NULL THEN 'outside the targets' END AS reason
FROM c LEFT JOIN n ON c.tax_id = n.tax_id LEFT JOIN g ON c.tax_id = g.tax_id""")
def _(t):
    tax = F.col("n_chars") % 200
    d = t.documents.select("doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("seq_id"), tax.alias("tax_id"))
    ids = d.select("tax_id").union(d.select(F.col("tax_id") + 1000)).distinct()
    return rel.classify_sequences(
        d.select("seq_id"), d.filter("doc_id % 9 <> 0").select("seq_id", "tax_id"),
        d.filter("tax_id < 20").select("tax_id", (F.col("tax_id") + 1000).alias("new_id")).distinct(),
        ids.filter("tax_id % 2 = 0").select("tax_id", F.concat(F.lit("taxon "), F.col("tax_id").cast("string")).alias("tax_name")),
        ids.filter("tax_id % 3 < 2").select("tax_id", F.when(F.col("tax_id") % 3 == 0, "plants").otherwise("fungi").alias("taxon")),
    )


@query("J23_cerna_network", """WITH e AS (SELECT DISTINCT 'circ' || l_suppkey AS circ_id, l_partkey % 300 AS m FROM lineitem),
f AS (SELECT DISTINCT replace(circ_id, 'circ', 'C') AS src, unnest(CASE WHEN m % 4 = 0 THEN ['hsa-let-' || m, 'hsa-let-' || (m + 1)] ELSE ['hsa-miR-' || m] END) AS dst
 FROM e JOIN supplier ON 'circ' || s_suppkey = circ_id AND s_acctbal > 0),
t2 AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'hsa-miR-' ELSE 'hsa-let-' END || (p_partkey % 300) AS mir, 'g' || (p_partkey // 4) AS gene FROM part
 UNION SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'hsa-miR-' ELSE 'hsa-let-' END || (p_partkey % 300), 'h' || p_size FROM part)
SELECT src, dst FROM f UNION SELECT mir, coalesce(CASE WHEN gene LIKE 'g%' THEN upper(gene) END, gene) FROM t2
 WHERE mir IN (SELECT dst FROM f) AND (gene LIKE 'h%' OR CAST(substr(gene, 2) AS BIGINT) % 3 = 0)""")
def _(t):
    def s(prefix, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    m, k = F.col("m"), F.col("p_partkey")
    targets = t.lineitem.select(s("circ", F.col("l_suppkey")).alias("circ_id"), (F.col("l_partkey") % 300).alias("m")).distinct()
    targets = targets.select("circ_id", F.when(m % 4 == 0, F.concat(s("let-", m), s("/", m + 1))).otherwise(s("miR-", m)).alias("mir"))
    circles = t.supplier.filter("s_acctbal > 0").select(s("circ", F.col("s_suppkey")).alias("circ_id"), s("C", F.col("s_suppkey")).alias("name"))
    mir_genes = t.part.select(
        F.when(k % 2 == 0, s("hsa-miR-", k % 300)).otherwise(s("hsa-let-", k % 300)).alias("mir"),
        F.concat(s("g", F.floor(k / 4)), s(";h", F.col("p_size"))).alias("genes"),
    )
    g = t.part.select(F.floor(k / 4).alias("n")).distinct()
    candidates = g.filter("n % 3 = 0").select(s("g", F.col("n")).alias("gene")).union(t.part.select(s("h", F.col("p_size"))))
    symbols = g.select(s("g", F.col("n")).alias("gene"), s("G", F.col("n")).alias("symbol"))
    return rel.cerna_network(circles, targets, mir_genes, candidates, symbols)


@query("J24_node_attributes", """WITH e AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem),
n AS (SELECT source AS node FROM e UNION SELECT target FROM e), a AS (SELECT o_custkey AS node, min_by(o_totalprice, o_orderkey) AS qty FROM orders GROUP BY 1)
SELECT node, CASE WHEN node % 7 = 0 THEN 'TF' WHEN node % 5 = 0 THEN 'HIST' WHEN node % 3 = 0 THEN 'RPG' ELSE 'Gene' END AS type, qty FROM n LEFT JOIN a USING (node)""")
def _(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    attrs = t.orders.select(
        F.col("o_custkey").alias("node"), F.col("o_totalprice").alias("qty"), F.col("o_orderkey").alias("line_no")
    )
    kinds = [(label, t.part.filter(f"p_partkey % {n} = 0").select("p_partkey")) for label, n in (("TF", 7), ("HIST", 5), ("RPG", 3))]
    return rel.node_attributes(edges, attrs, "line_no", kinds)


@query("J25_fusion_reports", """WITH f AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 60 AS g1, l_suppkey % 60 AS g2, l_orderkey * 100 AS s, l_orderkey * 100 + 51 AS e FROM lineitem),
p AS (SELECT DISTINCT p_partkey % 60 AS g1, p_size AS g2, 'pair' || (p_partkey % 60) || '-' || p_size AS name FROM part),
s AS (SELECT DISTINCT p_partkey % 60 AS gene, 'one' || (p_partkey % 60) AS name FROM part WHERE p_partkey % 60 < 20), t AS (SELECT DISTINCT p_partkey % 60 AS gene FROM part WHERE p_partkey % 60 BETWEEN 20 AND 30),
x AS (SELECT f.*, coalesce(a.name, b.name, s2.name, s1.name) AS nm, t1.gene IS NOT NULL OR t2.gene IS NOT NULL AS tg FROM f LEFT JOIN p a ON f.g1 = a.g1 AND f.g2 = a.g2
 LEFT JOIN p b ON f.g1 = b.g2 AND f.g2 = b.g1 LEFT JOIN s s1 ON f.g1 = s1.gene LEFT JOIN s s2 ON f.g2 = s2.gene LEFT JOIN t t1 ON f.g1 = t1.gene LEFT JOIN t t2 ON f.g2 = t2.gene)
SELECT id, line, g1, g2, (s + e) // 2 + 1 AS break_pos, coalesce(nm, '') AS report_name FROM x WHERE nm IS NOT NULL OR tg""")
def _(t):
    key = F.col("l_orderkey")
    fusions = t.lineitem.select(
        key.alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 60).alias("g1"), (F.col("l_suppkey") % 60).alias("g2"),
        (F.floor((key * 100 + key * 100 + 51) / 2) + 1).alias("break_pos"),
    )
    g = F.col("p_partkey") % 60
    pairs = t.part.select(
        g.alias("g1"), F.col("p_size").cast("long").alias("g2"),
        F.concat(F.lit("pair"), g.cast("string"), F.lit("-"), F.col("p_size").cast("string")).alias("name")).distinct()
    singles = t.part.filter(g < 20).select(g.alias("gene"), F.concat(F.lit("one"), g.cast("string")).alias("name")).distinct()
    return rel.fusion_reports(fusions, pairs, singles, t.part.filter(g.between(20, 30)).select(g.alias("gene")))


@query("J26_replace_names", "SELECT event_id, CASE event_type WHEN 'click' THEN 'chr1' WHEN 'view' THEN 'chr2' ELSE event_type END AS chrom FROM events")
def _(t):
    names = t.events.select("event_type").distinct()
    mapping = names.filter(F.col("event_type").isin("click", "view")).select(
        F.col("event_type").alias("old"), F.when(F.col("event_type") == "click", "chr1").otherwise("chr2").alias("new"))
    return rel.rename_keys(t.events.select("event_id", F.col("event_type").alias("chrom")), "chrom", mapping)


@query("J27_value_with_p", """SELECT l_orderkey AS row_key, l_linenumber AS col_key, printf('%.4f', avg(l_tax)) || '(p=' || printf('%.4f', avg(l_discount)) || ')' AS cell
FROM lineitem GROUP BY 1, 2""")
def _(t):
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("row_key"), F.col("l_linenumber").alias("col_key"))
    values, p = rounded_mean(F.col("l_tax"), 4), rounded_mean(F.col("l_discount"), 4)
    return rel.value_with_p(li.agg(values.alias("value")), li.agg(p.alias("p")), ["row_key", "col_key"])


# The pages are written as two files and streamed one file a trigger; keys seen in the first are skipped in the second.
@query("Z02_stream_new_pages", "SELECT DISTINCT split_part(url, '?', 1) AS url_key FROM pages")
def _(t):
    from helixframe.session import new_path
    from helixframe.streaming.incremental import stream_new_pages

    parts, out = new_path(t.spark, "pages"), new_path(t.spark, "new-pages")
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 3600)
    twice = t.pages.select("page_id", "url", seen.alias("seen_at"))
    twice.union(twice).repartition(2).write.parquet(parts)
    rows = t.spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    fresh = stream_new_pages(rows, "seen_at", "1 day").select("url_key")
    fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(t.spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out)


@query("Z02_capture_new_pages", "SELECT DISTINCT split_part(url, '?', 1) AS url_key FROM pages")
def _(t):
    from helixframe.session import new_path
    from helixframe.streaming.incremental import capture_new_pages

    parts, out = new_path(t.spark, "pages"), new_path(t.spark, "captured")
    years = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 400 * 86_400)
    rows = t.pages.select("page_id", "url", years.alias("seen_at"))
    rows.union(rows).repartition(2).write.parquet(parts)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    capture_new_pages(stream, out, new_path(t.spark, "state"), "seen_at").awaitTermination()
    return t.spark.read.parquet(out).select("url_key")


@query("Z02_skip_captured", """SELECT page_id, split_part(url, '?', 1) AS url_key FROM pages WHERE split_part(url, '?', 1) NOT IN (SELECT split_part(url, '?', 1) FROM pages WHERE page_id % 3 = 0)""")
def _(t):
    from helixframe.streaming.incremental import skip_captured

    captured = t.pages.filter("page_id % 3 = 0")
    return skip_captured(t.pages, captured).select("page_id", "url_key")
