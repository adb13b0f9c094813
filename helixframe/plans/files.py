"""Source and sink queries: lines drawn from the tables, parsed back, or written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.plans import bindings as b
from helixframe.plans.bindings import COUNTS
from helixframe.plans.registry import Suite
from helixframe.session import new_path
from helixframe.sources import annotations as an
from helixframe.sources import blocks, design, lines, metrics, sequences, sinks, variants

suite = Suite()
query = suite.query


def s(prefix, column, suffix=""):
    return F.concat(F.lit(prefix), F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(suffix))


def text(*parts):
    """One line from columns and literals."""
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value")


def col(name):
    return F.col(name).cast("string")


# --- tables and design files -----------------------------------------------------------------

@query("S01_sniffed_table", "SELECT CAST(p_partkey AS VARCHAR) AS \"index\", p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def _(t):
    path = new_path(t.spark, "table")
    rows = t.part.select(col("p_partkey").alias(" "), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    rows.write.option("header", True).option("sep", ";").csv(path)  # every part opens with the header
    return lines.read_table(t.spark, path)


_S = [f"s{i}" for i in range(8)]


@query("S02_melt", f"WITH {COUNTS}, {b.GROUPS} SELECT gene, sample, value, grp FROM counts JOIN groups USING (sample)")
def _(t):
    wide = b.counts(t).groupBy("gene").pivot("sample", _S).agg(F.first("value"))
    return lines.melt(wide, ["gene"]).join(b.groups(t).select("sample", "grp"), "sample")


@query("S03_sample_groups", """SELECT DISTINCT 'x' || s_suppkey AS sample, 'parity' AS scheme, 'g' || (s_suppkey % 2) AS grp FROM supplier
UNION ALL SELECT DISTINCT 'x' || s_suppkey, 'nation', 'n' || s_nationkey FROM supplier""")
def _(t):
    table = t.supplier.select(s("x", "s_suppkey").alias("sample"), s("g", F.col("s_suppkey") % 2).alias("parity"), s("n", "s_nationkey").alias("nation"))
    return design.sample_groups(table)


@query("S04_comparisons", "SELECT DISTINCT 'n' || c_nationkey AS ctrl, 'n' || ((c_nationkey + c_custkey) % 25) AS test FROM customer WHERE c_custkey % 3 <> 0")
def _(t):
    rows = t.customer.select(text(F.when(F.col("c_custkey") % 3 == 0, "#").otherwise(""), s("n", "c_nationkey"), "\t", s("n", (F.col("c_nationkey") + F.col("c_custkey")) % 25)))
    return design.comparisons(rows, t.nation.select(s("n", "n_nationkey").alias("name")))


@query("S05_gene_terms", """SELECT DISTINCT 'K' || p_partkey AS gene, unnest(string_split(p_name, ' ')) AS term FROM part WHERE p_partkey % 5 <> 0""")
def _(t):
    terms = F.concat_ws(";", F.transform(F.split("p_name", " "), lambda x: F.concat(F.lit("path:"), x)))
    rows = t.part.select(text(s("ko:K", "p_partkey"), " ", F.when(F.col("p_partkey") % 5 == 0, "path:map1").otherwise(terms)))
    return design.gene_terms(rows)


@query("S28_fastq_sheet", "SELECT 'x' || o_orderkey AS sample, 'a' || o_custkey || '|b' || o_custkey AS r1, 'c' || o_custkey AS r2 FROM orders WHERE o_orderkey % 4 <> 0")
def _(t):
    rows = t.orders.select(text(F.when(F.col("o_orderkey") % 4 == 0, "#").otherwise(""), s("x", "o_orderkey"), " ", s("a", "o_custkey"), ";", s("b", "o_custkey"), " ", s("c", "o_custkey")))
    return design.fastq_sheet(rows).select("sample", F.concat_ws("|", "read1").alias("r1"), F.concat_ws("|", "read2").alias("r2"))


@query("S38_metagenes", """SELECT DISTINCT 'M' || p_size AS metagene, 'g' || p_partkey AS gene FROM part
UNION ALL SELECT DISTINCT 'L' || p_partkey, unnest(string_split(p_name, ' ')) FROM part""")
def _(t):
    flat = t.part.select(text(s("g", "p_partkey"), " ", s("M", "p_size")))
    listed = t.part.select(text(s("L", "p_partkey"), "\t", F.replace("p_name", F.lit(" "), F.lit(", "))))
    return design.metagenes(flat, False).union(design.metagenes(listed, True))


@query("S39_regulated_genes", """SELECT DISTINCT 'g' || l_partkey AS gene, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_tax > 0.04 THEN 'up' ELSE 'down' END ELSE '' END AS direction FROM lineitem""")
def _(t):
    directed = F.col("l_suppkey") % 2 == 0
    rows = t.lineitem.select(
        s("f", F.col("l_suppkey") % 2).alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"),
        text(s("g", "l_partkey"), F.when(directed, F.when(F.col("l_tax") > 0.04, " up").otherwise(" down")).otherwise("")),
    )
    return design.regulated_genes(rows)


@query("S17_class_hierarchy", """WITH p AS (SELECT p_partkey AS k, p_partkey // 40 AS a, p_partkey // 8 AS b, p_name FROM part)
SELECT lpad(CAST(k AS VARCHAR), 5, '0') AS code, p_name AS name, 'Mid ' || b AS middle, 'Top ' || a AS top FROM p""")
def _(t):
    k = F.col("p_partkey")
    a, m = F.floor(k / 40), F.floor(k / 8)

    def line(order, *parts):
        return t.part.select(s("brite", F.lit(1)).alias("path"), order.alias("line_no"), text(*parts))

    entries = line(k * 3 + 3, "C    ", F.lpad(k.cast("string"), 5, "0"), "  ", F.col("p_name"))
    middle = t.part.filter("p_partkey % 8 = 0").select(s("brite", F.lit(1)).alias("path"), (k * 3 + 2).alias("line_no"), text("B  Mid ", m.cast("string")))
    top = t.part.filter("p_partkey % 40 = 0").select(s("brite", F.lit(1)).alias("path"), (k * 3 + 1).alias("line_no"), text("A<b>Top ", a.cast("string"), "</b>"))
    return design.class_hierarchy(entries.union(middle).union(top))


@query("S30_class_conditions", """SELECT DISTINCT p_brand || ' class' AS variant_class, unnest(['G' || p_size, 'G' || (p_size + 1)]) AS gene, 'p.' || p_partkey AS protein FROM part WHERE p_partkey % 2 = 0
UNION SELECT DISTINCT p_brand || ' class', 'H' || p_size, unnest(['p.' || p_partkey, 'q.' || p_partkey]) FROM part WHERE p_partkey % 2 = 1""")
def _(t):
    size, k = F.col("p_size").cast("string"), col("p_partkey")
    even = F.concat(F.lit("[{'field': 'gene', 'operator': 'eq', 'value': 'G"), size, F.lit(",G"), (F.col("p_size") + 1).cast("string"),
                    F.lit("'}, {'field': 'protein', 'operator': 'eq', 'value': 'p."), k, F.lit("'}]"))
    odd = F.concat(F.lit("[{'field': 'gene', 'operator': 'eq', 'value': 'H"), size, F.lit("'}, {'field': 'protein', 'operator': 'in', 'value': 'p."), k, F.lit(",q."), k, F.lit("'}]"))
    rows = t.part.select(s("", "p_brand", " class").alias("variant_class"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("condition"))
    return design.class_conditions(rows)


_KIND = {
    "exon": ("'G' || p_size || ' exon ' || (p_partkey % 20) || ' deletion'", 0), "half_known": ("'G' || p_size || ' V' || p_partkey || ' mutation'", 1),
    "deleterious": ("'G' || p_size || ' deleterious mutation'", 2), "activating": ("'G' || p_size || ' activating mutation'", 3),
    "mutation": ("'G' || p_size || ' mutation'", 4), "aberration": ("'G' || p_size || ' aberration'", 5), "splice": ("'G' || p_size || ' splice site mutation'", 6),
}


@query("S31_class_members", " UNION ALL ".join(
    f"SELECT DISTINCT '{kind}' AS kind, 'G' || p_size AS gene, " + {"exon": "CAST(p_partkey % 20 AS VARCHAR)", "half_known": "'V' || p_partkey"}.get(kind, "''")
    + f" AS place FROM part WHERE p_partkey % 7 = {i}" for kind, (_, i) in _KIND.items()))
def _(t):
    case = " ".join(f"WHEN {i} THEN {sql}" for sql, i in _KIND.values())
    classes = t.part.selectExpr(f"CASE p_partkey % 7 {case} END AS variant_class")
    out = None
    for kind in _KIND:
        part = design.class_members(classes, kind)
        part = part.select(F.lit(kind).alias("kind"), "gene", F.col("place") if "place" in part.columns else F.lit("").alias("place")).distinct()
        out = part if out is None else out.union(part)
    return out


@query("S40_class_parents", "SELECT DISTINCT 'c' || p_partkey AS class, 'c' || (p_partkey // 3) AS parent FROM part WHERE p_partkey % 4 <> 0")
def _(t):
    three = F.concat(s("", "p_size"), F.lit("\t"), s("c", "p_partkey"), F.lit("\t"), s("c", F.floor(F.col("p_partkey") / 3)))
    return design.class_parents(t.part.select(text(F.when(F.col("p_partkey") % 4 == 0, s("c", "p_partkey")).otherwise(three))))


# --- annotation files ------------------------------------------------------------------------

@query("S11_gtf", """SELECT 'chr' || (p_size % 22) AS chrom, 'exon' AS type, p_partkey * 10 AS start, p_partkey * 10 + p_size AS "end", 'G' || p_size AS gene, 'T' || p_partkey || '.2' AS transcript,
p_size % 9 AS exon FROM part WHERE p_partkey % 3 = 0""")
def _(t):
    start = F.col("p_partkey") * 10
    rows = t.part.select(text(
        s("chr", F.col("p_size") % 22), "\tsrc\texon\t", start.cast("string"), "\t", (start + F.col("p_size")).cast("string"), "\t.\t+\t.\tgene_name \"", s("G", "p_size"),
        "\"; transcript_id \"", s("T", "p_partkey", ".2"), "\"; exon_number ", (F.col("p_size") % 9).cast("string"), ";")).union(t.part.select(text("#!", col("p_name"))))
    wanted = t.part.filter("p_partkey % 3 = 0").select(s("T", "p_partkey").alias("t"))
    return an.gtf(rows, wanted).select("chrom", "type", "start", "end", F.col("attrs")["gene_name"].alias("gene"), F.col("attrs")["transcript_id"].alias("transcript"), F.col("attrs")["exon_number"].cast("int").alias("exon"))


@query("S12_bed", "SELECT 'chr' || (p_size % 22) AS chrom, p_partkey * 10 - 1 AS start, p_partkey * 10 + p_size AS \"end\", p_brand AS name FROM part WHERE p_partkey % 10 > 1")
def _(t):
    start = F.col("p_partkey") * 10
    row = F.concat_ws("\t", s("chr", F.col("p_size") % 22), start.cast("string"), (start + F.col("p_size")).cast("string"), "p_brand")
    k = F.col("p_partkey") % 10
    return an.bed(t.part.select(text(F.when(k == 0, "track name=x a b").when(k == 1, "#c a b d").otherwise(row))), one_based=True)


@query("S13_taxonomy", """SELECT CAST(p_partkey AS VARCHAR) AS tax_id, CAST(p_partkey // 3 AS VARCHAR) AS parent_id, CASE WHEN p_size > 25 THEN 'genus' ELSE 'no rank' END AS rank,
CASE WHEN p_size % 2 = 0 THEN p_name END AS tax_name, CASE WHEN p_partkey % 50 = 0 THEN CAST(p_partkey + 1 AS VARCHAR) END AS new_id FROM part""")
def _(t):
    k = col("p_partkey")
    nodes = an.taxonomy_nodes(t.part.select(text(k, "\t|\t", F.floor(F.col("p_partkey") / 3).cast("string"), "\t|\t", F.when(F.col("p_size") > 25, "genus").otherwise("no rank"), "\t|\tXX\t|")))
    names = an.taxonomy_names(t.part.select(text(k, "\t|\t", F.col("p_name"), "\t|\t\t|\t", F.when(F.col("p_size") % 2 == 0, "scientific name").otherwise("synonym"), "\t|")))
    merged = an.taxonomy_merged(t.part.filter("p_partkey % 50 = 0").select(text(k, "\t|\t", (F.col("p_partkey") + 1).cast("string"), "\t|")))
    return nodes.join(names, "tax_id", "left").join(merged, "tax_id", "left")


@query("S14_accession_taxa", "SELECT 'A' || o_orderkey || '.1' AS seq_id, CAST(o_custkey % 50 AS VARCHAR) AS tax_id FROM orders WHERE o_custkey % 50 <> 0")
def _(t):
    rows = t.orders.select(text(s("A", "o_orderkey"), "\t", s("A", "o_orderkey", ".1"), "\t", (F.col("o_custkey") % 50).cast("string"), "\t9"))
    return an.accession_taxa(rows.union(t.orders.agg(F.lit("accession\taccession.version\ttaxid\tgi").alias("value"))))


@query("S15_gene_id_pairs", "SELECT DISTINCT 'E' || l_partkey AS source, CAST(l_suppkey AS VARCHAR) AS target FROM lineitem WHERE l_linenumber = 2 AND l_partkey % 7 <> 0")
def _(t):
    gene = F.when(F.col("l_partkey") % 7 == 0, F.lit("-")).otherwise(s("E", "l_partkey", ".3"))
    rows = t.lineitem.select(text(col("l_linenumber"), "\t", gene, "\t", col("l_suppkey")))
    return an.gene_id_pairs(rows, "2", 2, 3, strip_version=True)


@query("S16_link_pairs", "SELECT CAST(l_partkey AS VARCHAR) AS source, 'K' || l_suppkey AS target FROM lineitem")
def _(t):
    return an.link_pairs(t.lineitem.select(text("hsa:", col("l_partkey"), "\tko:K", col("l_suppkey"))))


@query("S25_domain_hits", """SELECT 'fam' || l_suppkey AS family, 'PF' || l_partkey || '.4' AS pfam_id, CAST(l_quantity AS INTEGER) AS domain_len, 'a  b ' || l_returnflag AS description FROM lineitem WHERE l_linenumber <> 3""")
def _(t):
    filler = " ".join(str(i) for i in range(4, 23))
    rows = t.lineitem.select(text(F.when(F.col("l_linenumber") == 3, "# ").otherwise(""), s("fam", "l_suppkey"), "   ", s("PF", "l_partkey", ".4"), "  ", F.col("l_quantity").cast("int").cast("string"), f" {filler} a  b ", F.col("l_returnflag")))
    return an.domain_hits(rows).select("family", "pfam_id", F.col("domain_len").cast("int").alias("domain_len"), "description")


@query("S26_microsatellite_sites", """SELECT 'chr' || (p_size % 22) AS chrom, p_partkey AS pos, p_brand AS unit, p_size AS times, 'L' || p_size AS left_flank, 'R' || p_size AS right_flank FROM part""")
def _(t):
    c, k, n = s("chr", F.col("p_size") % 22), col("p_partkey"), col("p_size")
    short = F.concat(c, F.lit(" "), k, F.lit(" "), s("L", "p_size"), F.lit(" "), n, F.lit("["), F.col("p_brand"), F.lit("] "), s("R", "p_size"))
    long = F.concat_ws("\t", c, k, F.lit("1"), F.lit("0"), n, F.lit("0"), F.lit("0"), "p_brand", s("L", "p_size"), s("R", "p_size"))
    return an.microsatellite_sites(t.part.select(text(F.when(F.col("p_partkey") % 2 == 0, short).otherwise(long))))


@query("S27_hotspots", "SELECT 'chr1' AS chrom, CAST(p_partkey AS VARCHAR) AS start, CAST(p_partkey + 1 AS VARCHAR) AS \"end\", 'c.' || p_size AS chgvs, 'p.' || p_size AS phgvs, 'NM_' || p_partkey AS transcript, p_brand AS gene FROM part WHERE p_partkey % 6 <> 0")
def _(t):
    row = F.concat_ws("\t", F.lit("chr1"), col("p_partkey"), (F.col("p_partkey") + 1).cast("string"), s("c.", "p_size"), s("p.", "p_size"), s("NM_", "p_partkey"), "p_brand")
    return an.hotspots(t.part.select(text(F.when(F.col("p_partkey") % 6 == 0, "chr1\tbad").otherwise(row))))


@query("S29_symbol_registry", "SELECT 'HGNC:' || p_partkey AS registry_id, p_brand AS symbol, p_name AS name, NULL::VARCHAR AS previous, p_type AS alias, 'ENSG' || p_size AS gene_id FROM part")
def _(t):
    table = t.part.select(
        s("HGNC:", "p_partkey").alias("HGNC ID"), F.col("p_brand").alias("Approved symbol"), F.col("p_name").alias("Approved name"), F.lit(None).cast("string").alias("Previous symbols"),
        F.col("p_type").alias("Alias symbols"), s("ENSG", "p_size").alias("Ensembl gene ID"), F.col("p_retailprice").alias("Chromosome"))
    return an.symbol_registry(table)


@query("S32_platform_matrix", f"""WITH {COUNTS}, c AS (SELECT 'GPL' || (gene % 3) AS platform, gene AS probe, sample, value FROM counts)
SELECT platform, probe, {", ".join(f"max(value) FILTER (WHERE sample = '{x}') AS {x}" for x in _S)}, max(p_name) AS symbol FROM c LEFT JOIN part ON probe = p_partkey AND p_size > 10 GROUP BY 1, 2""")
def _(t):
    c = b.counts(t).select(s("GPL", F.col("gene") % 3).alias("platform"), F.col("gene").alias("probe"), "sample", "value")
    probes = t.part.filter("p_size > 10").select(s("GPL", F.col("p_partkey") % 3).alias("platform"), F.col("p_partkey").alias("probe"), F.col("p_name").alias("symbol"))
    return an.platform_matrix(c, probes, _S)


# --- tool logs: one log per customer ----------------------------------------------------------

def _log(t, i, *parts):
    return t.customer.select(s("/run/c", "c_custkey", ".Log.out").alias("path"), F.lit(i).cast("long").alias("line_no"), text(*parts))


def _stack(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _star(t):
    k = F.col("c_custkey")
    values = {
        "total_reads": (k * 100).cast("string"), "average_read_length": F.lit("150.5"), "unique_mapped": (k * 60).cast("string"), "unique_mapped_ratio": F.lit("60.25%"),
        "average_mapped_read_length": F.lit("149.5"), "total_splices": (k * 2).cast("string"), "annotated_splices": k.cast("string"), "multiple_mapped": (k * 20).cast("string"),
        "multiple_mapped_ratio": F.lit("20.5%"), "many_mapped": (k * 5).cast("string"), "many_mapped_ratio": F.lit("5.25%"), "chimeric": F.lit("3"),
    }
    frames = [_log(t, i, "   ", metrics.ALIGNER_METRICS[n][0], " |\t", v) for i, (n, v) in enumerate(values.items(), start=2)]
    return _stack([_log(t, 1, "UNIQUE READS:"), *frames])


@query("S18_aligner_summary", """SELECT 'c' || c_custkey AS sample, c_custkey * 100 AS total_reads, 150.5::DOUBLE AS average_read_length, c_custkey * 60 AS unique_mapped, 60.25::DOUBLE AS unique_mapped_ratio, 149.5::DOUBLE AS average_mapped_read_length,
 c_custkey * 2 AS total_splices, c_custkey AS annotated_splices, c_custkey * 20 AS multiple_mapped, 20.5::DOUBLE AS multiple_mapped_ratio, c_custkey * 5 AS many_mapped, 5.25::DOUBLE AS many_mapped_ratio, 3::BIGINT AS chimeric,
 c_custkey * 85 AS mapped, 86.0::DOUBLE AS mapped_ratio FROM customer""")
def _(t):
    return metrics.aligner_summary(_star(t))


@query("S19_described_values", """SELECT 'c' || c_custkey AS sample, unnest(['Number of input reads', 'Average mapped length']) AS description, unnest([CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)]) AS "text" FROM customer""")
def _(t):
    return metrics.described_values(_stack([_log(t, 1, "HEAD:"), _log(t, 2, "  Number of input reads |\t", col("c_custkey")), _log(t, 3, "Average mapped length | ", col("c_nationkey"))]))


@query("S20_section_records", """SELECT 'c' || c_custkey AS sample, CAST(1 AS BIGINT) AS record, unnest(['BAIT', 'TOTAL']) AS metric, unnest([c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""")
def _(t):
    return metrics.section_records(_stack([
        _log(t, 1, "## HEADER"), _log(t, 2, "x\ty"), _log(t, 3, "## METRICS CLASS a"), _log(t, 4, "BAIT\tTOTAL"), _log(t, 5, F.col("c_mktsegment"), "\t", col("c_nationkey")), _log(t, 6, "tail\t1")]))


@query("S21_summary_metrics", """SELECT 'c' || c_custkey AS sample, unnest(['Total reads', 'Mapped reads']) AS metric, unnest([CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""")
def _(t):
    return metrics.summary_metrics(_stack([
        _log(t, 1, "MAP SUMMARY,,Total reads,", col("c_custkey"), ",100.0"), _log(t, 2, "MAP SUMMARY,,Mapped reads,7,", col("c_nationkey")),
        _log(t, 3, "PER RG,,Other,1"), _log(t, 4, "MAP SUMMARY,,Late,1")]), ".Log.out")


@query("S21_coverage_table", """SELECT metric, max(v) FILTER (WHERE n = 0) AS n0, max(v) FILTER (WHERE n = 1) AS n1 FROM (
 SELECT 'Depth ' || c_mktsegment AS metric, c_nationkey % 2 AS n, CAST(count(*) AS VARCHAR) AS v FROM customer GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    sizes = t.customer.groupBy((F.col("c_nationkey") % 2).alias("n"), "c_mktsegment").agg(F.count("*").alias("v"))
    rows = sizes.select(s("/x/n", "n", ".target_bed_coverage_metrics.csv").alias("path"), text("COVERAGE,,Depth ", F.col("c_mktsegment"), ",", col("v"), ",1.0"))
    return metrics.metric_table(metrics.coverage_metrics(rows, ".target_bed_coverage_metrics"), ["n0", "n1"])


@query("S22_flag_counts", """SELECT 'c' || c_custkey AS sample, CAST(i AS BIGINT) AS line_no, CASE i WHEN 1 THEN c_custkey ELSE c_nationkey END AS passed, CAST(0 AS BIGINT) AS failed, CASE i WHEN 1 THEN 'in total (QC-passed)' ELSE 'mapped (97% : N/A)' END AS description FROM customer, (SELECT unnest([1, 2]) AS i)""")
def _(t):
    return metrics.flag_counts(_stack([_log(t, 1, col("c_custkey"), " + 0 in total (QC-passed)"), _log(t, 2, col("c_nationkey"), " + 0 mapped (97% : N/A)")]))


@query("S23_alignment_rate", """SELECT 'c' || c_custkey AS sample, c_custkey + 10 + c_nationkey AS total_reads, c_custkey + c_nationkey AS aligned_reads, round((c_custkey + c_nationkey) / (c_custkey + 10 + c_nationkey), 6) AS aligned_rate FROM customer""")
def _(t):
    total = (F.col("c_custkey") + 10 + F.col("c_nationkey")).cast("string")
    rows = _stack([_log(t, 1, "10 ", col("c_custkey"), " ", col("c_nationkey"), " ", total), _log(t, 2, "1 2 3")])
    return metrics.alignment_rate(rows).withColumn("aligned_rate", F.round("aligned_rate", 6))


@query("S24_tag_shares", """SELECT 'c' || c_custkey AS sample, unnest(['CDS', 'Intron']) AS tag_group, unnest([c_custkey + 1, c_nationkey + 1]) AS tags,
 round(unnest([(c_custkey + 1) / (c_custkey + c_nationkey + 2), (c_nationkey + 1) / (c_custkey + c_nationkey + 2)]), 6) AS share FROM customer""")
def _(t):
    banner = [_log(t, i, "Total 5 6") for i in range(1, 5)]
    rows = _stack([*banner, _log(t, 5, "Group Total_bases Tag_count Tags/Kb"), _log(t, 6, "CDS  100  ", (F.col("c_custkey") + 1).cast("string"), " 0.1"),
                   _log(t, 7, "Intron 9 ", (F.col("c_nationkey") + 1).cast("string"), " 0.2"), _log(t, 8, "=====")])
    return metrics.tag_shares(rows).withColumn("share", F.round("share", 6))


# --- sequences -------------------------------------------------------------------------------
# The letters a, c, g and t of a document make its sequence.

_SEQ = "regexp_replace(lower(text), '[^acgt]', '', 'g')"


def _records(t):
    return t.documents.select(
        s("D", "doc_id", ".1").alias("name"), F.col("lang").alias("description"), F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("sequence"), "doc_id")


def _fasta_text(records):
    wrapped = F.regexp_replace("sequence", "(.{60})", "$1\n")
    return records.select(F.concat(F.lit(">"), "name", F.lit(" "), "description", F.lit("\n# note\n\n"), wrapped).alias("value"))


@query("S06_fasta", f"SELECT 'D' || doc_id || '.1' AS name, lang AS description, {_SEQ} AS sequence FROM documents")
def _(t):
    path = new_path(t.spark, "fasta")
    _fasta_text(_records(t)).write.text(path)
    return sequences.read_fasta(t.spark, path)


@query("S07_both_ids", f"SELECT unnest(['D' || doc_id || '.1', 'D' || doc_id]) AS key, 'D' || doc_id || '.1' AS name, length({_SEQ}) AS n FROM documents")
def _(t):
    records = sequences.parse_fasta(_fasta_text(_records(t)))
    return sequences.keyed_by_both_ids(records).select("key", "name", F.length("sequence").cast("long").alias("n"))


_HEADER = "'@M1:1:F:' || (doc_id % 8) || ':1:1:' || doc_id || ' 1:N:0:I' || (doc_id % 5) || '+J' || (doc_id % 7)"


def _fastq_text(t):
    header = F.concat(s("@M1:1:F:", F.col("doc_id") % 8), s(":1:1:", "doc_id"), s(" 1:N:0:I", F.col("doc_id") % 5), s("+J", F.col("doc_id") % 7))
    seq = F.regexp_replace(F.lower("text"), "[^acgt]", "")
    # '@' opens the quality line on purpose: it is a legal quality character.
    quality = F.concat(F.lit("@"), F.expr("repeat('I', length(sequence))"))
    return t.documents.select(header.alias("h"), seq.alias("sequence")).select(F.concat_ws("\n", "h", "sequence", F.lit("+"), quality).alias("value"))


_FASTQ = f"SELECT {_HEADER} AS header, {_SEQ} AS sequence, '+' AS plus, '@' || repeat('I', length({_SEQ})) AS quality FROM documents"


@query("S08_fastq", _FASTQ)
def _(t):
    path = new_path(t.spark, "fastq")
    _fastq_text(t).repartition(4).write.option("compression", "gzip").text(path)
    return sequences.read_fastq(t.spark, path).drop("path")


@query("S08_fastq_plain", _FASTQ)
def _(t):
    path = new_path(t.spark, "fastq")
    _fastq_text(t).write.text(path)
    return sequences.read_fastq(t.spark, path, compressed=False).drop("path")


@query("S08_fastq_blocks", _FASTQ)
def _(t):
    path = new_path(t.spark, "fastq-blocks")
    blocks.write_blocks(_fastq_text(t), path)
    return blocks.read_blocks(t.spark, path, "fastq", split=4 << 20).drop("path")


@query("X15_header_fields", "SELECT doc_id, lpad(CAST(doc_id % 8 AS VARCHAR), 3, '0') AS lane, '1' AS read, 'I' || (doc_id % 5) AS i1, 'J' || (doc_id % 7) AS i2 FROM documents")
def _(t):
    header = F.concat(s("@M1:1:F:", F.col("doc_id") % 8), s(":1:1:", "doc_id"), s(" 1:N:0:I", F.col("doc_id") % 5), s("+J", F.col("doc_id") % 7))
    return t.documents.select("doc_id", *sequences.header_fields(header))


_BASES = ", ".join(f"count(*) FILTER (WHERE base = '{x}') AS {x}" for x in "acgt")
_RATIOS = ", ".join(f"round(count(*) FILTER (WHERE base = '{x}') / count(*), 6) AS {x}_ratio" for x in "acgt")


@query("A06_base_composition", f"""WITH q AS (SELECT {_SEQ} AS sequence FROM documents), g AS (SELECT 1 AS grp, sequence[1:8] AS part FROM q WHERE length(sequence) >= 20 UNION ALL SELECT 2, sequence[13:20] FROM q WHERE length(sequence) >= 20),
c AS (SELECT grp, unnest(range(8)) AS pos, unnest(string_split(part, '')) AS base FROM g)
SELECT grp, CAST(pos AS INTEGER) AS pos, count(*) AS total, {_BASES}, {_RATIOS} FROM c GROUP BY 1, 2""")
def _(t):
    out = sequences.base_composition(_records(t), "^(.{8}).{4}(.{8})", 2, "acgt")
    return out.select("grp", "pos", "total", *"acgt", *[F.round(f"{x}_ratio", 6).alias(f"{x}_ratio") for x in "acgt"])


@query("A22_sequence_lengths", f"SELECT 'D' || doc_id || '.1' AS name, length({_SEQ}) AS length FROM documents")
def _(t):
    return sequences.sequence_lengths(sequences.parse_fasta(_fasta_text(_records(t))))


# --- variants --------------------------------------------------------------------------------

def _vcf_lines(t):
    k = F.col("l_orderkey").cast("string")
    return t.lineitem.select(text(
        s("chr", F.col("l_suppkey") % 22), "\t", k, "\t.\t", F.col("l_returnflag"), "\t", F.col("l_linestatus"), ",T\t50\tPASS;q10\tDP=", F.col("l_quantity").cast("int").cast("string"), ";DB;AF=",
        col("l_discount"), "\tGT:AD:DP\t0/1:1,2:", col("l_linenumber"), "\t0/0:3,4")).union(
        t.lineitem.agg(F.lit("##INFO=<ID=DP,Number=1,Type=Integer>").alias("value"))).union(
        t.lineitem.agg(F.lit("\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT tumor normal".split())).alias("value")))


_VCF = """SELECT 'chr' || (l_suppkey % 22) AS chrom, l_orderkey AS pos, l_returnflag AS ref, l_linestatus || '/T' AS alt, 'PASS/q10' AS filter, CAST(l_quantity AS INTEGER) AS dp, 'Flagged' AS db, l_discount AS af, '0/1' AS gt, CAST(l_linenumber AS VARCHAR) AS t_dp, '3,4' AS n_ad, NULL::VARCHAR AS n_dp FROM lineitem"""


def _flat(v):
    return v.select("chrom", "pos", "ref", F.concat_ws("/", "alt").alias("alt"), F.concat_ws("/", "filter").alias("filter"), F.col("info")["DP"].cast("int").alias("dp"), F.col("info")["DB"].alias("db"), F.col("info")["AF"].cast("double").alias("af"),
                    F.col("samples")["tumor"]["GT"].alias("gt"), F.col("samples")["tumor"]["DP"].alias("t_dp"), F.col("samples")["normal"]["AD"].alias("n_ad"), F.col("samples")["normal"]["DP"].alias("n_dp"))


@query("S09_vcf", _VCF)
def _(t):
    return _flat(variants.vcf(_vcf_lines(t)))


@query("S09_vcf_blocks", _VCF)
def _(t):
    path = new_path(t.spark, "vcf-blocks")
    blocks.write_blocks(_vcf_lines(t), path)
    return _flat(variants.vcf(blocks.read_blocks(t.spark, path, split=4 << 20)))


@query("S10_field_types", "SELECT CASE WHEN p_size % 2 = 0 THEN 'INFO' ELSE 'FORMAT' END AS section, 'F' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Float' ELSE 'String' END AS type FROM part")
def _(t):
    rows = t.part.select(text("##", F.when(F.col("p_size") % 2 == 0, "INFO").otherwise("FORMAT"), "=<ID=F", col("p_partkey"), ",Number=1,Type=", F.when(F.col("p_size") % 3 == 0, "Float").otherwise("String"), ",Description=\"x, y\">"))
    return variants.field_types(rows.union(t.part.select(text("##contig=<ID=c", col("p_partkey"), ">"))))


# --- sinks -----------------------------------------------------------------------------------

@query("S33_text_table", "SELECT p_partkey AS gene, p_name AS name, p_retailprice AS price FROM part")
def _(t):
    path = new_path(t.spark, "tsv")
    sinks.write_text_table(t.part.select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")), path)
    return t.spark.read.schema("gene long, name string, price double").option("header", True).option("sep", "\t").csv(path)


@query("S34_per_key", "SELECT l_shipmode_stand_in AS sample, count(*) AS n, round(sum(l_quantity), 2) AS total FROM (SELECT *, 's' || (l_suppkey % 8) AS l_shipmode_stand_in FROM lineitem) GROUP BY 1")
def _(t):
    path = new_path(t.spark, "keys")
    sinks.write_per_key(t.lineitem.select(s("s", F.col("l_suppkey") % 8).alias("sample"), "l_orderkey", "l_linenumber", "l_quantity"), path, "sample")
    return t.spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("S35_chunks", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS chunk FROM orders QUALIFY chunk < (SELECT count(*) // 700 FROM orders)")
def _(t):
    return sinks.chunked(t.orders.select("o_orderkey"), "o_orderkey", 700, drop_short=True)


@query("T06_random_chunks", """WITH d AS (SELECT o_orderkey, CAST('0x' || substr(md5('7:' || o_orderkey), 1, 15) AS BIGINT) AS draw FROM orders)
SELECT o_orderkey, draw, (row_number() OVER (ORDER BY draw) - 1) // 500 AS chunk FROM d""")
def _(t):
    return sinks.chunked(sinks.shuffled(t.orders.select("o_orderkey"), "o_orderkey", 7), "draw", 500)


@query("S36_sequence_store", f"SELECT 'D' || doc_id || '.1' AS seq_id, length({_SEQ}) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    name = f"sequences_{uuid.uuid4().hex}"
    sinks.store_sequences(_records(t).select(F.col("name").alias("seq_id"), "sequence"), name, new_path(t.spark, "store"))
    ids = t.labels.select(s("D", "doc_id", ".1").alias("seq_id"))
    return sinks.look_up_sequences(t.spark, name, ids).select("seq_id", F.length("sequence").cast("long").alias("n"))


def _annotated(t):
    """Two annotations per part; the gene's canonical transcript is one of them for every third part."""
    k = F.col("p_partkey")
    one = F.concat_ws(":", s("G", "p_size"), s("NM_", k * 2), F.lit("exon1"), s("c.", k % 10), s("p.", k % 7))
    two = F.concat_ws(":", s("G", "p_size"), s("NM_", k * 2 + 1), F.lit("exon2"), s("c.", k % 10))
    v = t.part.select(F.lit("db").alias("source"), s("chr", F.col("p_size") % 22).alias("chrom"), k.alias("start"), s("v", "p_partkey").alias("var_id"), F.lit("A").alias("ref"), F.lit("T").alias("alt"),
                      F.when(k % 11 == 0, ".").otherwise(F.concat_ws(",", one, two)).alias("hgvs"))
    canonical = t.part.filter("p_partkey % 3 = 0").groupBy("p_size").agg(F.min("p_partkey").alias("m")).select(s("G", "p_size").alias("gene"), s("NM_", F.col("m") * 2, ".4").alias("canonical_transcript"))
    return sinks.variant_rows(v, canonical)


_STORE = """c AS (SELECT p_size, min(p_partkey) AS m FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
b AS (SELECT p_partkey AS k, part.p_size AS z, 'G' || part.p_size || ':NM_' || (p_partkey * 2) || ':exon1:c.' || (p_partkey % 10) || ':p.' || (p_partkey % 7) AS one, 'G' || part.p_size || ':NM_' || (p_partkey * 2 + 1) || ':exon2:c.' || (p_partkey % 10) AS two,
 starts_with('NM_' || (m * 2) || '.4', 'NM_' || (p_partkey * 2)) AS c1, starts_with('NM_' || (m * 2) || '.4', 'NM_' || (p_partkey * 2 + 1)) AS c2 FROM part LEFT JOIN c ON part.p_size = c.p_size WHERE p_partkey % 11 <> 0),
st AS (SELECT k, z, 'c.' || (k % 10) AS chgvs, unnest([one, two || ':None']) AS hg, CASE WHEN c1 AND c2 THEN greatest(one, two) WHEN c1 THEN one WHEN c2 THEN two END AS canonical FROM b)"""


@query("S37_variant_query", f"""WITH {_STORE}, q AS (SELECT DISTINCT p_size AS z, 'c.' || (p_size % 10) AS chgvs FROM part), h AS (SELECT q.z, k, coalesce(canonical, hg) AS annotation, canonical, count(canonical) OVER (PARTITION BY q.z) AS n FROM q JOIN st USING (z, chgvs))
SELECT DISTINCT 'q' || z AS query_id, 'chr' || (z % 22) AS chrom, k AS start, 'v' || k AS var_id, 'A' AS ref, 'T' AS alt, annotation FROM h WHERE n = 0 OR canonical IS NOT NULL""")
def _(t):
    queries = t.part.select(s("q", "p_size").alias("query_id"), s("G", "p_size").alias("gene"), s("c.", F.col("p_size") % 10).alias("chgvs")).distinct()
    return sinks.query_variants(_annotated(t), queries, ["gene", "chgvs"])


_KEPT = f"WITH {_STORE} SELECT 'G' || z AS gene, 'v' || k AS var_id, chgvs, count(*) AS n FROM st WHERE NOT (z = 7 AND chgvs = 'c.1') GROUP BY 1, 2, 3"


@query("S37_variant_delete", _KEPT)
def _(t):
    path = new_path(t.spark, "variants")
    sinks.delete_variants(_annotated(t), {"gene": "G7", "chgvs": "c.1"}).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("gene", "var_id", "chgvs").agg(F.count("*").alias("n"))


@query("S37_delete_stored", _KEPT)
def _(t):
    path = new_path(t.spark, "variant-store")
    sinks.write_per_key(_annotated(t), path, "chrom")
    sinks.delete_stored(t.spark, path, {"gene": "G7", "chgvs": "c.1"})
    return t.spark.read.parquet(path).groupBy("gene", "var_id", "chgvs").agg(F.count("*").alias("n"))
