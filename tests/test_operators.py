import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import hgvs, tails, text
from helixframe.operators import calls, expression, graph, models, pairwise, relations, sets
from helixframe.operators import intervals as intervals_ops
from helixframe.operators import rules as rules_ops
from helixframe.operators import statistics as statistics_ops
from helixframe.operators import variants as variants_ops
from helixframe.plans import load_all
from helixframe.sources import lines, sequences, sinks


def test_every_oracle_belongs_to_a_query():
    suite = load_all()
    assert set(suite.oracle) <= set(suite.queries)
    assert len(suite.queries) > 200


def test_tpm_sums_to_a_million(spark):
    rng = random.Random(1)
    counts = spark.createDataFrame([(g, s, float(rng.randrange(100))) for g in range(50) for s in "xyz"], "gene long, sample string, value double")
    lengths = spark.createDataFrame([(g, 100 + g) for g in range(50)], "gene long, length long")
    for r in expression.tpm(counts, lengths).groupBy("sample").agg(F.sum("tpm").alias("t")).collect():
        assert r.t == pytest.approx(1e6)


def test_nearly_empty_sample_fails_the_job(spark):
    counts = spark.createDataFrame([("a", "x", 3.0)], "gene string, sample string, value double")
    lengths = spark.createDataFrame([("a", 1000)], "gene string, length long")
    with pytest.raises(Exception, match="nearly no counts"):
        expression.guarded_abundance(counts, lengths).collect()


def test_in_all_sets_is_the_intersection(spark):
    rng = random.Random(4)
    parts = {n: spark.createDataFrame([(x,) for x in rng.sample(range(40), 25)], "element int") for n in ("s1", "s2", "s3")}
    named = sets.named(parts)
    all_of = {r.element for r in sets.in_at_least(named, 3).collect()}
    assert all_of == {r.element for r in sets.intersection(list(parts.values())).collect()}
    assert {r.element for r in sets.evaluate(named, ["s1", "s2", "s3"], "s1 & (s2 | s3) - s2").collect()} == (
        lambda a, b, c: a & (b | c) - b
    )(*[{r.element for r in parts[n].collect()} for n in ("s1", "s2", "s3")])


@pytest.mark.parametrize("bad", ["s1; drop", "s1 + s2", "__import__('os')"])
def test_set_expressions_are_not_code(spark, bad):
    named = sets.named({"s1": spark.range(3).withColumnRenamed("id", "element")})
    with pytest.raises((ValueError, KeyError)):
        sets.evaluate(named, ["s1"], bad)


def test_reverse_complement_is_an_involution(spark):
    df = spark.createDataFrame([("ACGTN",), ("ttgac",), ("",)], "s string")
    out = df.select(F.upper("s").alias("s"), text.reverse_complement(text.reverse_complement(F.col("s"))).alias("r")).collect()
    assert all(r.s == r.r for r in out)


def test_duplicate_index_pair_fails(spark):
    reads = spark.createDataFrame([("A", "B")], "i1 string, i2 string")
    sheet = spark.createDataFrame([("x", "A", "B"), ("y", "B", "A")], "sample string, p7 string, p5 string")
    with pytest.raises(Exception, match="used twice"):
        relations.by_index_pair(reads, sheet).collect()


def test_sniffed_separators():
    assert [lines.sniff_separator(x) for x in ("a\tb\tc", "a,b", "a;b;c", "a b")] == ["\t", ",", ";", " "]


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = {r.line_no: r.value for r in lines.read_numbered_lines(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"line {i}" for i in range(1, 2001)}


def test_fastq_with_at_sign_quality_and_small_batches(spark, tmp_path):
    reads = [(f"@r{i} 1:N:0:A+B", "ACGT"[: i % 5], "+", "@@@@"[: i % 5]) for i in range(103)]
    for part, chunk in (("a", reads[:50]), ("b", reads[50:])):
        with gzip.open(tmp_path / f"{part}.fq.gz", "wt") as f:
            f.write("".join("\n".join(r) + "\n" for r in chunk))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequences.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted((r.header, r.sequence, r.plus, r.quality) for r in got) == sorted(reads)


def test_write_per_key_spreads_a_large_key_over_writers(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "IF(id % 10 = 0, 'few', 'most') AS key")
    sinks.write_per_key(df, str(tmp_path / "k"), "key", writer_records=500)
    back = spark.read.parquet(str(tmp_path / "k"))
    assert sorted(r.id for r in back.filter("key = 'most'").collect()) == [k for k in range(20_000) if k % 10]
    held = [r["count"] for r in back.groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().collect()]
    assert sum(held) == 20_000 and max(held) < 5_000  # of one task


def test_write_per_key_and_chunks(spark, tmp_path):
    df = spark.range(95).withColumn("key", F.when(F.col("id") < 80, "hot").otherwise("cold"))
    sinks.write_per_key(df, str(tmp_path / "k"), "key", max_records=10)
    assert spark.read.parquet(str(tmp_path / "k")).groupBy("key").count().count() == 2
    sizes = sinks.chunked(df, "id", 20, drop_short=True).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in sizes) == [20, 20, 20, 20]


def test_components_on_a_star_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k < 100} == {0} and {v for k, v in got.items() if k >= 100} == {100}


def test_longest_way_up(spark):
    edges = spark.createDataFrame([("d", "a"), ("d", "c"), ("c", "b"), ("b", "a")], "node string, parent string")
    assert {r.node: r.depth for r in graph.depth(edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_empty_denominators_count_as_perfect(spark):
    none = spark.createDataFrame([], "sample string, var_id long, af double")
    known = spark.createDataFrame([("x", 1, 0.5)], "sample string, var_id long, af double")
    row = calls.evaluation(none, known, 10).filter("sample = 'x'").first()
    assert (row.ppv, row.sensitivity) == (100.0, 0.0)


def _batch_reference(x, batches, conv=1e-4):
    """The correction on one array, straight from its formulas."""
    levels = sorted(set(batches))
    b = np.array([[float(v == lev) for lev in levels] for v in batches])
    coef = np.linalg.inv(b.T @ b) @ b.T @ x.T
    grand = (b.sum(axis=0) / len(batches)) @ coef
    sd = np.sqrt(((x - (b @ coef).T) ** 2).mean(axis=1))[:, None]
    z = (x - grand[:, None]) / sd
    for lev in levels:
        own = [i for i, v in enumerate(batches) if v == lev]
        part = z[:, own]
        g_hat, d_hat, n = part.mean(axis=1), part.var(axis=1, ddof=1), len(own)
        g_bar, t2, m, s2 = g_hat.mean(), g_hat.var(), d_hat.mean(), d_hat.var(ddof=1)
        a, bb = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
        g, d, change = g_hat, d_hat, 1
        while change > conv:
            g2 = (t2 * n * g_hat + d * g_bar) / (t2 * n + d)
            d2 = (0.5 * ((part - g2[:, None]) ** 2).sum(axis=1) + bb) / (n / 2 + a - 1)
            change = max(((abs(g2 - g)) / g).max(), ((abs(d2 - d)) / d).max())
            g, d = g2, d2
        z[:, own] = (part - g[:, None]) / np.sqrt(d)[:, None]
    return z * sd + grand[:, None]


def test_batch_correction_matches_the_formulas(spark):
    rng = np.random.default_rng(0)
    batches = ["p"] * 5 + ["q"] * 6
    x = rng.normal(10, 2, (60, 11)) + np.where(np.array(batches) == "q", 3.0, 0.0)
    names = [f"s{i}" for i in range(11)]
    rows = [(g, n, float(x[g, i])) for g in range(60) for i, n in enumerate(names)]
    out = models.correct_batches(spark.createDataFrame(rows, "gene long, sample string, value double"), names, batches)
    got = np.zeros_like(x)
    for r in out.collect():
        got[r.gene, names.index(r.sample)] = r.value
    assert np.abs(got - _batch_reference(x, batches)).max() < 1e-3


def test_purity_of_clean_somatic_variants(spark):
    true = 0.6
    rows = [("t", str(i), true / 2, 400, 2) for i in range(30)]
    got = models.tumour_purity(spark.createDataFrame(rows, "sample string, id string, vaf double, depth long, ploidy long"), somatic_only=True)
    final = {r.stage: r.purity for r in got.collect()}
    # A fraction of 0.3 is one of two copies at 0.6, or both after a loss at 2 * 0.3 / 1.3, or two copies at 0.3.
    assert min(abs(final["all"] - p) for p in (0.6, 0.46, 0.3)) <= 0.05


# --- limits that must not cut ------------------------------------------------------------

def test_tails_settle_for_large_parameters():
    assert abs(float(tails.binomial_cdf(5e7, 1e8, 0.5)) - 0.50004) < 1e-5
    t, v = 2.0, 1e10
    assert abs(float(tails.beta_inc(v / 2, 0.5, v / (v + t * t))) - 0.0455002639) < 1e-7  # 1 - x itself has no more digits
    assert abs(float(tails.beta_inc(2.0, 3.0, 0.4)) - 0.5248) < 1e-12
    assert np.allclose(tails.beta_inc(np.array([0.5, 20.0]), np.array([0.5, 30.0]), np.array([0.25, 0.4])), [1 / 3, 0.5093], atol=2e-3)


def test_intervals_of_any_length_hold_points(spark):
    intervals = spark.createDataFrame([("c", 0, 2**61, "long"), ("c", 10, 20, "short"), ("c", None, 5, "open")], "chrom string, start long, end long, name string")
    points = spark.createDataFrame([("c", 15), ("c", 2**40 + 1)], "chrom string, pos long")
    got = sorted((r.pos, r.name) for r in intervals_ops.points_in_intervals(points, intervals).collect())
    assert got == [(15, "long"), (15, "short"), (2**40 + 1, "long")]


def test_correlation_far_from_zero(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=2000)
    y = 0.45 * x + draw.normal(size=2000)
    rows = [(g, s, float(1e8 + v)) for g in range(2000) for s, v in (("a", x[g]), ("b", y[g]), ("k", 0.0))]
    df = spark.createDataFrame(rows, "gene int, sample string, value double")
    got = {(r.a, r.b): r["corr"] for r in pairwise.pearson_matrix(df, ["a", "b", "k"]).collect()}
    assert abs(got["a", "b"] - np.corrcoef(1e8 + x, 1e8 + y)[0, 1]) < 1e-6 and abs(got["a", "a"] - 1) < 1e-12
    assert got["a", "k"] is None
    far = {(r.a, r.b): r.euclidean for r in pairwise.distances(df, ["a", "b", "k"]).collect()}
    assert abs(far["a", "b"] - np.linalg.norm((1e8 + x) - (1e8 + y))) < 1e-5


def test_spearman_over_shared_genes(spark):
    import pandas as pd

    draw = np.random.default_rng(2)
    table = pd.DataFrame(draw.integers(0, 9, (40, 4)).astype(float), columns=list("abcd"))
    table.loc[3:9, "b"] = np.nan
    table.loc[7:20, "d"] = np.nan
    rows = [(i, c, float(v)) for i, r in table.iterrows() for c, v in r.items() if v == v]
    got = pairwise.spearman_matrix(spark.createDataFrame(rows, "gene int, sample string, value double"), list("abcd")).collect()
    want = {}
    for a in "abcd":
        for b in "abcd":
            both = table[[a, b]].dropna() if a != b else table[[a]].dropna()
            want[a, b] = both[a].rank().corr(both[b].rank())
    assert len(got) == 16 and all(abs(r["corr"] - want[r.a, r.b]) < 1e-9 for r in got)


def test_depth_with_a_root_that_is_its_own_parent(spark):
    edges = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "node int, parent int")
    assert {r.node: r.depth for r in graph.depth(edges).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        graph.depth(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "node int, parent int"))
    assert {r.node for r in graph.descendants(edges, spark.createDataFrame([(2,)], "root int")).collect()} == {2, 3}


def test_exact_p_of_small_groups(spark):
    rows = [("g", float(v), grp) for v, grp in ((1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "b"))]
    df = spark.createDataFrame(rows, "gene string, value double, grp string")
    out = statistics_ops.group_test(df, ["gene"], "value", "grp", "a", "b", small_groups=True).first()
    assert abs(out.p - 0.1) < 1e-12  # two of twenty arrangements


def test_hommel_against_closed_testing(spark):
    from itertools import combinations

    p = [0.01, 0.02, 0.022, 0.09, 0.5]
    want = []
    for i in range(5):
        worst = 0.0
        for size in range(1, 6):
            for chosen in combinations(range(5), size):
                if i in chosen:
                    own = sorted(p[k] for k in chosen)
                    worst = max(worst, min(size * q / (k + 1) for k, q in enumerate(own)))
        want.append(worst)
    df = spark.createDataFrame([("s", i, q) for i, q in enumerate(p)], "study string, i int, p double")
    got = {r.i: r.q for r in statistics_ops.adjust(df, ["study"], method="hommel").collect()}
    assert all(abs(got[i] - w) < 1e-12 for i, w in enumerate(want))


def test_categories_and_domain_counts_have_no_limit(spark):
    fields = spark.createDataFrame([("ID", f"v{k}") for k in range(150)] + [("DP", "3"), ("DP", "9")], "field string, value string")
    ranges = variants_ops.field_ranges(fields)
    assert ranges.filter("kind = 'category'").count() == 150
    shown = {r.field: r.text for r in variants_ops.filter_template(ranges).collect()}
    assert shown == {"ID": "150 categories", "DP": "3.0..9.0"}
    rules = rules_ops.parse_family_rules(spark.createDataFrame([("A", "A", "AP2 (>=2) (PF1)", "-", "-")], "family string, subfamily string, binding string, auxiliary string, forbidden string"))
    counts = spark.createDataFrame([("q", "PF1", 40)], "query_id string, domain string, n long")
    assert rules_ops.judge_families(counts, rules).count() == 1


def test_chunks_from_lines(spark):
    text = "ACGTTGCAAGTC" * 7
    lines = spark.createDataFrame([("c", n, text[at:at + 11]) for n, at in enumerate(range(0, len(text), 11))], "chrom string, line_no int, seq string")
    got = {r.chunk_no: r.seq for r in hgvs.lines_to_chunks(lines, 20).collect()}
    assert got == {k: text[20 * k:20 * k + 20] for k in range(5)}
    whole = {r.chunk_no: r.seq for r in hgvs.to_chunks(spark.createDataFrame([("c", text)], "chrom string, seq string"), 20).collect()}
    assert whole == got
    kinds = spark.createDataFrame([("cX10del",), ("c.10del",)], "c string").select("c", hgvs.change_class(F.col("c")).alias("k"))
    assert {r.c: r.k for r in kinds.collect()} == {"cX10del": None, "c.10del": 2}


def test_depth_of_overlapping_reads(spark):
    reads = [("c", 0, 10, "a"), ("c", 5, 15, "a"), ("c", 8, 12, "b"), ("c", 30, 40, "b"), ("d", 0, 5, "a")]
    al = spark.createDataFrame(reads, "chrom string, start long, end long, qname string")
    regions = spark.createDataFrame([("c", 2, 20), ("c", 25, 28)], "chrom string, start long, end long")
    want = {}
    for chrom, start, end in (("c", 2, 20), ("c", 25, 28)):
        for pos in range(start, end):
            names = {q for c, lo, hi, q in reads if c == chrom and lo <= pos < hi}
            if names:
                want[start, pos] = len(names)
    assert {(r.start, r.pos): r.depth for r in intervals_ops.base_depth(al, regions).collect()} == want
    zero = {r.start: r.depth for r in intervals_ops.region_median_depth(al, regions, with_zero=True).collect()}
    line = sorted(want.get((2, p), 0) for p in range(2, 20))
    assert zero == {2: line[len(line) // 2], 25: 0}


def test_p_of_one_stays_one_in_the_sidak_corrections(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 1.0), ("a", 1.2)], "study string, p double")
    got = {r.p: r for r in statistics_ops.adjust_all(df, ["study"], {"sidak": "one", "holm-sidak": "two"}).collect()}
    assert (got[1.0].one, got[1.0].two, got[1.2].one, got[1.2].two) == (1.0, 1.0, 1.0, 1.0)
    assert got[0.01].one == pytest.approx(1 - 0.99**3)


def test_no_interval_where_hits_are_no_part_of_the_trials(spark):
    df = spark.createDataFrame([(5, 3), (-1, 3), (0, 0), (2, 4)], "x long, n long")
    low, high = calls.wilson(F.col("x"), F.col("n"))
    got = {(r.x, r.n): (r.low, r.high) for r in df.select("x", "n", low.alias("low"), high.alias("high")).collect()}
    assert got[5, 3] == got[-1, 3] == got[0, 0] == (None, None)
    assert got[2, 4] == pytest.approx((0.150036, 0.849964), abs=1e-5)


def test_uncorrelated_whole_numbers_have_no_sign(spark):
    rng, rows, genes = random.Random(8), [], 0
    while genes < 60:
        x, y = [rng.randrange(1, 60) for _ in range(7)], [rng.randrange(1, 60) for _ in range(7)]
        if 7 * sum(a * b for a, b in zip(x, y)) == sum(x) * sum(y):
            rows += [(f"x{genes}", f"s{k}", float(v)) for k, v in enumerate(x)] + [(f"y{genes}", f"s{k}", float(v)) for k, v in enumerate(y)]
            genes += 1
    pairs = spark.createDataFrame([(f"x{k}", f"y{k}") for k in range(genes)], "source string, target string")
    out = statistics_ops.pair_correlation(spark.createDataFrame(rows, "gene string, sample string, value double"), pairs).collect()
    assert len(out) == genes and {(r.corr, r.kind) for r in out} == {(0.0, "negative")}


def test_breakpoints_meet_united_features(spark):
    rng = random.Random(2)
    rows = [("c", s, s + rng.randrange(-1, 12), rng.choice(["g1", None]), rng.choice(["T1.1", "T2.1"]), rng.choice([None, 1, 4])) for s in (rng.randrange(200) for _ in range(150))]
    features = spark.createDataFrame(rows, "chrom string, start long, end long, gene string, transcript string, exon int")
    united = intervals_ops._united(features.filter("exon = 1"), ["chrom", "transcript"]).collect()
    for name in ("T1.1", "T2.1"):
        own = [(r.start, r.end) for r in united if r.transcript == name]
        covered = {p for _, s, e, _, t, x in rows if t == name and x == 1 for p in range(s, e + 1)}
        assert sum(e - s + 1 for s, e in own) == len(covered) and {p for s, e in own for p in range(s, e + 1)} == covered
    points = spark.createDataFrame([("c", p) for p in range(210)], "chrom string, pos long")
    none = spark.createDataFrame([], "transcript string")
    got = {tuple(r) for r in intervals_ops.annotate_breakpoints(points, features, none).collect()}
    want = {}
    for _, s, e, g, t, x in rows:
        for p in range(s, e + 1):
            want[p, g, t] = max(want.get((p, g, t), -1), -1 if x is None else x)
    # A gene without a name never met its canonical transcripts, and still does not.
    assert got == {("c", p, g, t, "intronic" if x < 0 else f"exon{x}") for (p, g, t), x in want.items() if g is not None}
