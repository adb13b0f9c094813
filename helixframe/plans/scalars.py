"""Column function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import hgvs, text
from helixframe.plans.files import s
from helixframe.plans.registry import Suite

suite = Suite()
query = suite.query
SIZE = 500


@query("X01_strip_version", "SELECT p_partkey, 'NM_' || p_partkey AS last_dot, 'NM_' || p_partkey AS first_dot FROM part")
def _(t):
    c = s("NM_", "p_partkey", ".12")
    return t.part.select("p_partkey", text.strip_version(c).alias("last_dot"), text.before_dot(c).alias("first_dot"))


@query("X02_reverse_complement", "SELECT doc_id, reverse(translate(upper(replace(text, 'ß', 'ss')), 'ATCG', 'TAGC')) AS rc FROM documents")
def _(t):
    return t.documents.select("doc_id", text.reverse_complement(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))).alias("rc"))


@query("X03_short_amino_acids", "SELECT p_partkey, 'p.' || CASE p_size % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'C' ELSE 'V' END || p_size || 'R' AS change FROM part")
def _(t):
    aa = F.when(F.col("p_size") % 3 == 0, "Leu").when(F.col("p_size") % 3 == 1, "Cys").otherwise("Val")
    return t.part.select("p_partkey", text.short_amino_acids(F.concat(F.lit("p."), aa, F.col("p_size").cast("string"), F.lit("Arg"))).alias("change"))


_CC = {
    1: "c.{n}A>G", 2: "c.{n}delC", 3: "c.{n}_{m}AT", 4: "c.{n}_{m}insGG", 5: "c.{n}_{m}delATinsC", 6: "c.{n}_{m}delAT", 7: "c.{n}_{m}dupAT", 8: "c.{n}dupC", 9: "c.{n}insT",
}


@query("X04_change_class", "SELECT p_partkey, NULLIF(CAST(p_partkey % 10 AS INTEGER), 0) AS kind FROM part")
def _(t):
    k = F.col("p_partkey")
    change = F.lit("p.unknown")
    for kind, form in _CC.items():
        parts = [F.lit(x) if i % 2 == 0 else (k if x == "n" else k + 1).cast("string") for i, x in enumerate(form.replace("{n}", "\0n\0").replace("{m}", "\0m\0").split("\0"))]
        change = F.when(k % 10 == kind, F.concat(*parts)).otherwise(change)
    return t.part.select("p_partkey", hgvs.change_class(change).alias("kind"))


def _genome(t):
    return t.documents.select(s("D", "doc_id").alias("chrom"), F.upper(F.regexp_replace(F.lower("text"), "[^acgt]", "")).alias("seq"))


_G = """g AS (SELECT doc_id, 'D' || doc_id AS chrom, upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq FROM documents),
m AS (SELECT *, 20 + doc_id % 7 AS p, 1 + doc_id % 9 AS kind, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM g WHERE length(seq) > 60)"""


# Changes of all nine classes, written from the bases of the sequences themselves.
@query("X05_resolve", f"""WITH {_G}
SELECT doc_id AS mut_id, CAST(kind AS INTEGER) AS kind, p AS pos, CASE kind WHEN 1 THEN seq[p:p] WHEN 2 THEN seq[p:p+1] WHEN 3 THEN seq[p:p+1] WHEN 4 THEN seq[p:p] WHEN 5 THEN seq[p:p+2] WHEN 6 THEN seq[p:p+3] WHEN 7 THEN seq[p:p+2] ELSE seq[p:p] END AS ref,
 CASE kind WHEN 1 THEN CASE WHEN seq[p:p] = 'A' THEN 'C' ELSE 'A' END WHEN 2 THEN seq[p:p] WHEN 3 THEN 'GA' WHEN 4 THEN seq[p:p] || 'GA' WHEN 5 THEN 'T' WHEN 6 THEN seq[p:p] WHEN 7 THEN seq[p:p+2] || seq[p:p+2] WHEN 8 THEN seq[p:p] || seq[p:p] ELSE seq[p:p] || 'T' END AS alt FROM m""")
def _(t):
    g = _genome(t).withColumn("doc_id", F.substring("chrom", F.lit(2), F.length("chrom")).cast("long")).filter(F.length("seq") > 60)
    p, kind = 20 + F.col("doc_id") % 7, 1 + F.col("doc_id") % 9
    strand = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")

    def base(at, n):
        return F.substring(F.col("seq"), at.cast("int"), F.lit(n))

    def own(c):
        return F.when(strand == "-", text.reverse_complement(c)).otherwise(c)

    def at(shift=0):
        return (F.lit(100) + shift).cast("string")

    one = base(p, 1)
    changed = F.when(one == "A", "C").otherwise("A")
    change = (
        F.when(kind == 1, F.concat(F.lit("c."), at(), own(one), F.lit(">"), own(changed))).when(kind == 2, F.concat(F.lit("c."), at(), F.lit("del"), own(base(p + 1, 1))))
        .when(kind == 3, F.concat(F.lit("c."), at(), F.lit("_"), at(1), own(F.lit("GA")))).when(kind == 4, F.concat(F.lit("c."), at(), F.lit("_"), at(1), F.lit("ins"), own(F.lit("GA"))))
        .when(kind == 5, F.concat(F.lit("c."), at(), F.lit("_"), at(2), F.lit("del"), own(base(p, 3)), F.lit("ins"), own(F.lit("T"))))
        .when(kind == 6, F.concat(F.lit("c."), at(), F.lit("_"), at(2), F.lit("del"), own(base(p + 1, 3)))).when(kind == 7, F.concat(F.lit("c."), at(), F.lit("_"), at(2), F.lit("dup"), own(base(p, 3))))
        .when(kind == 8, F.concat(F.lit("c."), at(), F.lit("dup"), own(one))).otherwise(F.concat(F.lit("c."), at(), F.lit("ins"), own(F.lit("T"))))
    )
    changes = g.select(F.col("doc_id").alias("mut_id"), "chrom", p.alias("start"), change.alias("change"), strand.alias("strand"))
    out = hgvs.resolve(changes, hgvs.to_chunks(_genome(t), SIZE), SIZE)
    return out.select("mut_id", "kind", "pos", "ref", "alt")


@query("X06_fraction", "SELECT l_orderkey, l_linenumber, round(l_discount, 6) AS af FROM lineitem")
def _(t):
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.round(F.col("l_discount") * 100, 4).cast("string"), F.lit("%"))).otherwise(F.col("l_discount").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(text.fraction(raw), 6).alias("af"))


@query("X07_canonical_hgvs", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NM_1' WHEN p_size % 2 = 0 THEN 'NM_2' END AS transcript, CASE WHEN p_partkey % 5 = 0 OR p_size % 2 = 0 THEN 'c.' || p_size END AS chgvs FROM part""")
def _(t):
    lone = F.concat(F.col("p_brand"), s(":NM_1:exon1:c.", "p_size", ":p.1"))
    two = F.concat(lone, F.lit(","), F.col("p_brand"), s(":NM_2:exon2:c.", "p_size"))
    canonical = F.when(F.col("p_size") % 2 == 0, "NM_2.3").otherwise("NM_9.1")
    hit = text.canonical_hgvs(text.hgvs_list(F.when(F.col("p_partkey") % 5 == 0, lone).otherwise(two)), canonical)
    return t.part.select("p_partkey", hit["transcript"].alias("transcript"), hit["chgvs"].alias("chgvs"))


@query("X09_deletion_keys", """SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN ['c.' || p_size || '_9del'] ELSE ['c.' || p_size || 'dupA', 'c.' || p_size || 'insA'] END) AS key FROM part""")
def _(t):
    change = F.when(F.col("p_size") % 2 == 0, s("c.", "p_size", "_9delACG")).otherwise(s("c.", "p_size", "dupA"))
    return t.part.select("p_partkey", F.explode(text.deletion_keys(change)).alias("key"))


@query("X10_variant_id", "SELECT l_orderkey, l_linenumber, 'chr' || l_suppkey || ':' || l_partkey || ':' || l_returnflag || ':' || l_linestatus AS id FROM lineitem")
def _(t):
    raw = F.concat(s("chr", "l_suppkey"), s(":", "l_partkey"), F.lit(","), F.col("l_returnflag"), F.lit(">"), F.col("l_linestatus"))
    v = t.lineitem.select("l_orderkey", "l_linenumber", *text.parse_variant(raw))
    return v.select("l_orderkey", "l_linenumber", text.variant_id("chrom", "pos", "ref", "alt").alias("id"))


@query("X11_flanks", f"WITH {_G} SELECT doc_id AS key, p AS pos, seq[greatest(p - 15, 0) + 1 : p - 1] AS up, seq[p : p + 15] AS down FROM m")
def _(t):
    g = _genome(t).filter(F.length("seq") > 60).withColumn("key", F.substring("chrom", F.lit(2), F.length("chrom")).cast("long"))
    df = g.select("key", "chrom", (20 + F.col("key") % 7).alias("pos"))
    return hgvs.flanks(df, hgvs.to_chunks(_genome(t), SIZE), SIZE, 15).select("key", "pos", "up", "down")


@query("X12_fusion_sequence", f"""WITH {_G}
SELECT doc_id AS key, CASE WHEN strand = '+' THEN seq[p - 9 : p + 1] ELSE reverse(translate(seq[p + 1 : p + 11], 'ATCG', 'TAGC')) END || '|' || CASE WHEN doc_id % 3 = 0 THEN seq[p + 11 : p + 21] ELSE reverse(translate(seq[p + 1 : p + 11], 'ATCG', 'TAGC')) END AS sequence FROM m""")
def _(t):
    g = _genome(t).filter(F.length("seq") > 60).withColumn("key", F.substring("chrom", F.lit(2), F.length("chrom")).cast("long"))
    p = 20 + F.col("key") % 7
    breaks = g.select("key", F.col("chrom").alias("c5"), p.alias("s5"), F.when(F.col("key") % 2 == 0, "+").otherwise("-").alias("strand5"), F.col("chrom").alias("c3"), (p + 10).alias("s3"), F.when(F.col("key") % 3 == 0, "+").otherwise("-").alias("strand3"))
    return hgvs.fusion_sequence(breaks, hgvs.to_chunks(_genome(t), SIZE), SIZE)


@query("X16_allele_fraction", """SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber = 1 THEN l_discount END, CASE WHEN l_linenumber = 2 THEN l_tax END, l_linenumber / l_quantity), 4) AS af FROM lineitem""")
def _(t):
    n = F.col("l_linenumber")
    af = text.allele_fraction(F.when(n == 1, F.col("l_discount")), F.when(n == 2, F.col("l_tax")), n, F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", af.alias("af"))


@query("X17_lowest_version", "SELECT p_partkey, 'NM_' || p_partkey || '.' || least(p_size, 12) AS transcript FROM part")
def _(t):
    message = F.concat(s("no NM_", "p_partkey"), F.lit(".12 but NM_"), F.col("p_partkey").cast("string"), s(".", "p_size", " found"))
    return t.part.select("p_partkey", text.lowest_version(message).alias("transcript"))


@query("X18_region_parts", """SELECT p_partkey, unnest(['chr1', 'chr2']) AS chrom, unnest([CAST(p_size AS BIGINT), p_partkey]) AS start FROM part""")
def _(t):
    compound = F.concat(s("chr1:g.", "p_size", "_9del__chr2:g."), F.col("p_partkey").cast("string"), F.lit("A>C"))
    return t.part.select("p_partkey", F.inline(text.region_parts(compound))).select("p_partkey", "chrom", "start")


@query("X19_run_name_fields", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS mutation_id, CASE WHEN p_size % 2 = 0 THEN 0.05 ELSE 0.1 END::DOUBLE AS af, CAST(p_partkey AS VARCHAR) AS seed FROM part")
def _(t):
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "xSnv").otherwise("xindel"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "af005seed").otherwise("af01seed"), F.col("p_partkey").cast("string"), F.lit("_run"))
    return t.part.select("p_partkey", *text.run_name_fields(name))


@query("X20_repeats_at", "SELECT p_partkey, p_size % 9 + p_partkey % 4 AS n FROM part")
def _(t):
    unit = F.when(F.col("p_size") % 2 == 0, F.lit("AC")).otherwise(F.lit("T"))
    left, right = F.col("p_partkey") % 4, F.col("p_size") % 9
    rep = lambda n: F.call_function("repeat", unit, n.cast("int"))
    seq = F.concat(F.lit("GG"), rep(left), rep(right), F.lit("GG"))
    return t.part.select("p_partkey", text.repeats_at(seq, unit, (F.length(unit) * left + 2).cast("int")).alias("n"))


# Reads that hold the whole repeat, that end within it (the rest is clipped) and that begin within it.
@query("X20_read_repeats", "SELECT p_partkey, p_size % 6 + p_partkey % 4 + 1 AS n FROM part")
def _(t):
    unit = F.when(F.col("p_size") % 2 == 0, F.lit("AC")).otherwise(F.lit("T"))
    one, two, mode = F.col("p_size") % 6, F.col("p_partkey") % 4 + 1, F.col("p_partkey") % 3
    rep = lambda n: F.call_function("repeat", unit, n.cast("int"))
    full = F.concat(F.lit("GG"), rep(one), rep(two), F.lit("CC"))
    aligned = F.when(mode == 0, full).when(mode == 1, F.concat(F.lit("GG"), rep(one))).otherwise(F.concat(rep(two), F.lit("CC")))
    before = F.when(mode == 2, F.concat(F.lit("GG"), rep(one))).otherwise("")
    after = F.when(mode == 1, F.concat(rep(two), F.lit("CC"))).otherwise("")
    offset = F.when(mode == 2, 0).otherwise(2)
    return t.part.select("p_partkey", text.read_repeats(full, aligned, before, after, offset, unit, F.lit("GG"), F.lit("CC")).alias("n"))


@query("X21_price_per_area", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 10000.0 / 50, 4) WHEN 1 THEN round(p_size * 100000000.0 / 50, 4) WHEN 2 THEN round(p_size / 50.0, 4) END::DOUBLE AS price FROM part""")
def _(t):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    price = F.when(k == 0, F.concat(n, F.lit("万"))).when(k == 1, F.concat(n, F.lit("亿"))).when(k == 2, F.concat(n, F.lit("元"))).otherwise("面议")
    return t.part.select("p_partkey", F.round(text.price_per_area(price, F.lit("50m²")), 4).alias("price"))


@query("X22_html_fields", r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def _(t):
    return t.pages.select("page_id", text.html_field(F.col("html"), "<title>([^<]*)</title>").alias("title"), text.html_field(F.col("html"), 'lang="([a-z]+)"').alias("lang"))


@query("X24_bands", """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.005 THEN 'grey' WHEN l_tax < 0.01 THEN 'lightgreen' WHEN l_tax < 0.02 THEN 'yellow' WHEN l_tax < 0.03 THEN 'pink' ELSE 'red' END AS band FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", text.banded(F.col("l_tax"), text.FREQUENCY_BANDS, "red").alias("band"))


@query("X25_splice_annotation", r"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ':NM_1:exon2:c.1A>G' WHEN 1 THEN p_brand || ':NM_2:exon1:c.7del' ELSE p_brand || ':NM_5:exon1:c.5del' END AS annotation FROM part""")
def _(t):
    size = F.col("p_size") % 3
    change = F.when(size == 0, ".").when(size == 1, F.concat("p_brand", F.lit(":NM_3:exon1:c.6del,"), "p_brand", F.lit(":NM_2:exon1:c.7del"))).otherwise(F.concat("p_brand", F.lit(":NM_5:exon1:c.5del")))
    full = text.splice_annotation(change, F.col("p_brand"), F.lit(r"NM_1:exon2:c.1A>G\x3bNM_8:exon2:c.2A>G"))
    return t.part.select("p_partkey", text.reduce_to_canonical(full, F.when(size == 0, "NM_1.4").otherwise("NM_2.2")).alias("annotation"))
