"""Annotation, comparison and lookup joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from helixframe.functions import ordered


def select_table(df: DataFrame, columns: Sequence[str], key: str, rows: DataFrame | None = None) -> DataFrame:
    out = df.select(key, *[c for c in columns if c != key])
    return out if rows is None else out.join(rows.select(key).distinct(), key, "left_semi")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def rename_keys(df: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """Replace keys found in mapping (old, new); others stay. Serves chromosome names as well."""
    return (
        df.join(mapping.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
        .withColumn(key, F.coalesce("_new", F.col(key).cast("string")))
        .drop("_new")
    )


def merge_tables(tables: Sequence[DataFrame], keys: Sequence[str], how: str = "outer") -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def merge_by_position(tables: Sequence[tuple[DataFrame, str]], how: str = "outer") -> DataFrame:
    """Join tables row by row; each comes with the unique numeric column that orders it."""
    numbered = [ordered.number_rows(df, order).drop(order) for df, order in tables]
    return merge_tables(numbered, ["row_no"], how)


def to_matrix(long: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Full outer concatenation of per-column results: one grouped pass, no chain of joins."""
    return long.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def annotate(df: DataFrame, key: str, annotation: DataFrame, default: str = "None") -> DataFrame:
    """Left join of one annotation per key, missing ones get the default."""
    (extra,) = [c for c in annotation.columns if c != key]
    one = annotation.groupBy(key).agg(F.min(extra).alias(extra))
    return df.join(one, key, "left").withColumn(extra, F.coalesce(F.col(extra).cast("string"), F.lit(default)))


def compose(*steps: DataFrame, distinct: bool = True) -> DataFrame:
    """Chain mappings a->b, b->c, ... into (first, last).

    Every two-column step is reduced to distinct pairs first when `distinct` is asked for.
    """
    def pair(df: DataFrame, i: int) -> DataFrame:
        out = df.select(F.col(df.columns[0]).alias(f"_{i}"), F.col(df.columns[1]).alias(f"_{i + 1}"))
        return out.distinct() if distinct else out

    out = pair(steps[0], 0)
    for i, step in enumerate(steps[1:], start=1):
        out = out.join(pair(step, i), f"_{i}").select("_0", f"_{i + 1}")
        if distinct:
            out = out.distinct()
    return out.select(F.col("_0").alias("source"), F.col(out.columns[1]).alias("target"))


def variant_key_join(
    variants: DataFrame, annotation: DataFrame, keys: Sequence[str], how: str = "left", expected: DataFrame | None = None
) -> DataFrame:
    """Join on the variant columns; with `expected`, mark the rows that were expected."""
    out = variants.join(annotation, list(keys), how)
    if expected is None:
        return out
    hits = expected.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return out.join(hits, list(keys), "left").withColumn("expected", F.coalesce("_hit", F.lit(False))).drop("_hit")


def missing_expected(variants: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(variants, list(keys), "left_anti")


def merge_prefixed(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join with every other column prefixed by the table's name."""
    renamed = [
        df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        for name, df in tables.items()
    ]
    return merge_tables(renamed, keys, "full")


def compare_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Call sets (sample, mutation, af, depth) of two rounds, joined through (left_sample, right_sample)."""
    a = left.select(
        F.col("sample").alias("left_sample"), "mutation", F.col("af").alias("left_af"), F.col("depth").alias("left_depth")
    ).join(pairs, "left_sample")
    b = right.select(
        F.col("sample").alias("right_sample"), "mutation", F.col("af").alias("right_af"), F.col("depth").alias("right_depth")
    ).join(pairs, "right_sample")
    both = a.join(b, ["left_sample", "right_sample", "mutation"], "full")
    seen = F.col("left_af").isNotNull() & F.col("right_af").isNotNull()
    return both.select(
        "left_sample", "right_sample", "mutation",
        F.coalesce("left_af", F.lit(0.0)).alias("left_af"), F.coalesce("right_af", F.lit(0.0)).alias("right_af"),
        F.coalesce("left_depth", F.lit(0)).alias("left_depth"), F.coalesce("right_depth", F.lit(0)).alias("right_depth"),
        F.when(seen, "yes").otherwise("no").alias("consistent"),
    )


def expand_groups(known: DataFrame, design: DataFrame) -> DataFrame:
    """Known mutations per group onto the samples of the group; both may hold ';' lists."""
    members = design.select("grp", F.explode(F.split("sample_ids", ";")).alias("sample")).distinct()
    return known.select("grp", F.explode(F.split("mutations", ";")).alias("mutation")).distinct().join(members, "grp")


def subnetwork(
    network: DataFrame, query: DataFrame, source: bool = True, target: bool = True, either: bool = False
) -> DataFrame:
    """Edges whose source and/or target is queried."""
    if not (source or target):
        raise ValueError("one end at least has to be in the query")
    wanted = query.select(F.col(query.columns[0]).alias("_q")).distinct()
    s = wanted.select(F.col("_q").alias("source"), F.lit(True).alias("_s"))
    t = wanted.select(F.col("_q").alias("target"), F.lit(True).alias("_t"))
    if not either:
        out = network
        if source:
            out = out.join(s, "source", "left_semi")
        return out.join(t, "target", "left_semi") if target else out
    flagged = network.join(s, "source", "left").join(t, "target", "left")
    return flagged.filter(F.col("_s") | F.col("_t")).drop("_s", "_t")


def match_samples(again: DataFrame, original: DataFrame, tail: int = 4) -> DataFrame:
    """Original sample whose name, cut by `tail` characters, starts with the cut name of the new one.

    The originals are cut to each length that a cut new name has, so the match is an equi-join, and only stems asked for are
    kept; of several matches the earliest line wins, then the smallest name. `original` is (sample, line_no), `again` is (sample).
    """
    def cut(c: Column) -> Column:
        return F.substring(c, 1, F.length(c) - tail)

    asked = again.select("sample", cut(F.col("sample")).alias("stem"))
    # One number for each length of a name in use.
    lengths = [r["n"] for r in asked.select(F.length("stem").alias("n")).distinct().collect() if r["n"] is not None]
    stem = cut(F.col("sample"))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(stem))
    lines = original.select(F.col("sample").alias("original"), "line_no", F.explode(F.transform(cuts, lambda n: F.substring(stem, 1, n))).alias("stem"))
    wanted = lines.join(asked.select("stem").distinct(), "stem", "left_semi")
    # Numbers are aggregated by hash; names, which are sorted, only for the line that won.
    first = wanted.groupBy("stem").agg(F.min("line_no").alias("line_no"))
    prefixes = wanted.join(first, ["stem", "line_no"]).groupBy("stem").agg(F.min("original").alias("original"))
    return asked.join(prefixes, "stem", "left").drop("stem")


def append_lists(original: DataFrame, again: DataFrame, matches: DataFrame) -> DataFrame:
    """Add the read lists of a repeated run to the original run; the new name wins. A sample without an original is an error."""
    missing = F.raise_error(F.concat(F.lit("no original sample for "), F.col("sample"))).cast("string")
    matches = matches.withColumn("original", F.coalesce("original", missing))
    extra = again.join(matches, "sample").select(
        F.col("original"), F.col("sample").alias("new_name"), F.col("reads").alias("more")
    )
    base = original.withColumnRenamed("sample", "original").join(extra, "original", "left")
    return base.select(
        F.coalesce("new_name", "original").alias("sample"),
        F.concat("reads", F.coalesce("more", F.array().cast("array<string>"))).alias("reads"),
    )


def by_index_pair(reads: DataFrame, sheet: DataFrame) -> DataFrame:
    """Assign reads (i1, i2) to samples by their unordered index pair.

    Two samples with the same pair fail the job.
    """
    def key(a: str, b: str) -> Column:
        return F.concat_ws("+", F.least(a, b), F.greatest(a, b))

    keyed = sheet.withColumn("pair", key("p7", "p5")).groupBy("pair").agg(
        F.count("*").alias("n"), F.min("sample").alias("sample")
    )
    checked = keyed.select(
        "pair",
        F.when(F.col("n") == 1, F.col("sample"))
        .otherwise(F.raise_error(F.concat(F.lit("index pair used twice: "), F.col("pair"))).cast("string"))
        .alias("sample"),
    )
    return reads.withColumn("pair", key("i1", "i2")).join(checked, "pair")


def contained_change(table: DataFrame, hot: DataFrame, texts_in_task: int = 20_000) -> DataFrame:
    """Rows whose gene is hot and whose change text contains a hot change of that gene.

    The distinct changes of a gene become one automaton, and each of its distinct texts is read once, whatever the number of
    changes. A gene with more than `texts_in_task` texts is dealt out over several tasks, each with the gene's changes.
    An empty hot change is contained in every text; null genes, changes and texts match nothing.
    """
    kind = dict(table.dtypes)["gene"]
    changes = hot.select(F.col("gene").cast(kind).alias("gene"), F.regexp_replace("phgvs", "[()]", "").alias("text")).dropna().distinct()
    texts = table.select("gene", F.col("change").alias("text")).dropna().distinct().join(changes.select("gene").distinct(), "gene", "left_semi")
    salts = texts.groupBy("gene").agg(F.ceil(F.count("*") / texts_in_task).cast("int").alias("salts"))
    dealt = texts.join(salts, "gene").select("gene", F.pmod(F.xxhash64("text"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("part"), "text")
    copies = changes.join(salts, "gene").select("gene", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("part"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, automaton, ready, everything = None, None, False, False
        for batch in batches:
            genes, found = batch.column(0), []
            for k, (gene, salt, part, text) in enumerate(zip(genes.to_pylist(), *(c.to_pylist() for c in batch.columns[1:]))):
                if (gene, salt) != now:
                    now, automaton, ready, everything = (gene, salt), ahocorasick.Automaton(), False, False
                if part == 0:
                    everything |= not text
                    if text:
                        automaton.add_word(text, True)
                    continue
                if not ready and len(automaton):
                    automaton.make_automaton()
                ready = True
                if everything or (len(automaton) and next(automaton.iter(text), None) is not None):
                    found.append(k)
            at = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([genes.take(at), batch.column(3).take(at)], names=["gene", "change"])

    placed = dealt.union(copies).repartition("gene", "salt").sortWithinPartitions("gene", "salt", "part")
    hits = placed.mapInArrow(search, f"gene {kind}, change string")
    return table.join(hits, ["gene", "change"], "left_semi")


def symbol_to_id(
    queries: DataFrame, known: DataFrame, registry: DataFrame
) -> DataFrame:
    """Resolve symbols: known pairs, then registry names, then withdrawn symbols' successors.

    registry: (symbol, name, previous, alias, gene_id); known: (symbol, gene_id). Case does not
    matter; one symbol may give several ids. Unresolved symbols keep a null id.
    """
    q = queries.select("query", F.lower("query").alias("k")).distinct()
    first = known.select(F.lower("symbol").alias("k"), "gene_id").distinct()
    withdrawn = F.col("symbol").contains("~withdrawn")
    names = F.array_compact(
        F.concat(
            F.array("symbol"),
            F.coalesce(F.split("previous", r",\s*"), F.array().cast("array<string>")),
            F.coalesce(F.split("alias", r",\s*"), F.array().cast("array<string>")),
        )
    )
    second = (
        registry.filter(~withdrawn & F.col("gene_id").isNotNull())
        .select(F.explode(names).alias("k"), "gene_id")
        .select(F.lower("k").alias("k"), "gene_id")
        .distinct()
    )
    moved = registry.filter(withdrawn & F.col("name").contains("symbol withdrawn")).select(
        F.lower(F.split("symbol", "~withdrawn")[0]).alias("k"),
        F.lower(F.trim(F.split("name", "see")[1])).alias("successor"),
    )
    third = moved.join(second.withColumnRenamed("k", "successor"), "successor").select("k", "gene_id").distinct()
    staged = (
        first.withColumn("stage", F.lit(1)).union(second.withColumn("stage", F.lit(2))).union(third.withColumn("stage", F.lit(3)))
    )
    found = q.join(staged, "k", "left")
    best = found.groupBy("query").agg(F.min("stage").alias("best"))
    return found.join(best, "query").filter(F.col("best").isNull() | (F.col("stage") == F.col("best"))).select(
        "query", "gene_id", "stage"
    )


def classify_sequences(
    sequences: DataFrame, accessions: DataFrame, merged: DataFrame, names: DataFrame, targets: DataFrame
) -> DataFrame:
    """Sequence -> current taxon -> name -> target group, or the reason why there is none.

    accessions (seq_id, tax_id), merged (tax_id, new_id), names (tax_id, tax_name),
    targets (tax_id, taxon): descendants of each target.
    """
    current = (
        sequences.join(accessions, "seq_id", "left")
        .join(merged, "tax_id", "left")
        .withColumn("tax_id", F.coalesce("new_id", "tax_id"))
        .drop("new_id")
        .join(names, "tax_id", "left")
        .join(targets, "tax_id", "left")
    )
    return current.select(
        "seq_id", "tax_id",
        F.when(F.col("tax_id").isNotNull(), F.coalesce("tax_name", F.lit("None"))).alias("tax_name"),
        "taxon",
        F.when(F.col("tax_id").isNull(), "accession unknown")
        .when(F.col("taxon").isNull(), "outside the targets")
        .alias("reason"),
    )


def expand_mirna(column: Column) -> Column:
    """``let-7a/7b`` -> [hsa-let-7a, hsa-let-7b]; a plain name gets the species prefix."""
    prefix = F.regexp_extract(column, "^([^-]*)-", 1)
    rest = F.regexp_replace(column, "^[^-]*-", "")
    many = F.array_distinct(F.transform(F.split(rest, "/"), lambda x: F.concat(F.lit("hsa-"), prefix, F.lit("-"), x)))
    return F.when(column.contains("/"), many).otherwise(F.array(F.concat(F.lit("hsa-"), column)))


def cerna_network(
    circles: DataFrame, circle_targets: DataFrame, mirna_targets: DataFrame, candidates: DataFrame, symbols: DataFrame
) -> DataFrame:
    """Edges circRNA -> miRNA -> gene for the asked circles and candidate genes.

    circles (circ_id, name), circle_targets (circ_id, mir), mirna_targets (mir, genes ';' list),
    candidates (gene), symbols (gene, symbol).
    """
    first = (
        circle_targets.join(circles, "circ_id")
        .select(F.col("name").alias("src"), F.explode(expand_mirna(F.col("mir"))).alias("dst"))
        .distinct()
    )
    reached = first.select(F.col("dst").alias("mir")).distinct()
    second = (
        mirna_targets.join(reached, "mir", "left_semi")
        .select("mir", F.explode(F.split("genes", ";")).alias("gene"))
        .distinct()
        .join(candidates.distinct(), "gene", "left_semi")
        .join(symbols, "gene", "left")
        .select(F.col("mir").alias("src"), F.coalesce("symbol", "gene").alias("dst"))
    )
    return first.union(second).distinct()


def node_attributes(edges: DataFrame, attributes: DataFrame, order: str, kinds: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Nodes of an edge list with a type (first matching kind, else Gene) and their first attribute row."""
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    cases = None
    for i, (label, members) in enumerate(kinds):
        flag = members.select(F.col(members.columns[0]).alias("node")).distinct().withColumn(f"_k{i}", F.lit(True))
        nodes = nodes.join(flag, "node", "left")
        cases = F.when(F.col(f"_k{i}"), label) if cases is None else cases.when(F.col(f"_k{i}"), label)
    values = [c for c in attributes.columns if c not in ("node", order)]
    first = attributes.groupBy("node").agg(F.min_by(F.struct(*values), order).alias("_v")).select("node", "_v.*")
    return nodes.select("node", cases.otherwise("Gene").alias("type")).join(first, "node", "left")


def fusion_reports(fusions: DataFrame, pairs: DataFrame, singles: DataFrame, targets: DataFrame) -> DataFrame:
    """Report name of fusions (g1, g2, ...): the pair, the reversed pair, one gene, else a target gene.

    pairs (g1, g2, name), singles (gene, name), targets (gene). Fusions with none are dropped.
    The second gene's name wins when both genes are known alone.
    """
    p = pairs.select("g1", "g2", F.col("name").alias("_ab"))
    rev = pairs.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("name").alias("_ba"))
    out = fusions.join(p, ["g1", "g2"], "left").join(rev, ["g1", "g2"], "left")
    for end in ("g1", "g2"):
        out = out.join(singles.select(F.col("gene").alias(end), F.col("name").alias(f"_s_{end}")), end, "left")
        out = out.join(
            targets.select(F.col("gene").alias(end)).distinct().withColumn(f"_t_{end}", F.lit(True)), end, "left"
        )
    name = F.coalesce("_ab", "_ba", "_s_g2", "_s_g1")
    kept = out.filter(name.isNotNull() | F.col("_t_g1") | F.col("_t_g2"))
    return kept.select(*fusions.columns, F.coalesce(name, F.lit("")).alias("report_name"))


def value_with_p(values: DataFrame, pvalues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two aligned matrices as text cells ``v(p=...)``."""
    return values.join(pvalues, list(keys)).select(
        *keys,
        F.concat(F.format_string("%.4f", "value"), F.lit("(p="), F.format_string("%.4f", "p"), F.lit(")")).alias("cell"),
    )


def multi_gene_membership(df: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """Rows whose ';' list holds any target gene; the row key is `row_id`."""
    hit = (
        df.select("row_id", F.explode(F.split(column, ";")).alias("gene"))
        .join(targets.distinct(), "gene", "left_semi")
        .select("row_id")
        .distinct()
    )
    return df.join(hit, "row_id", "left_semi")


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. Spark drops all but one row per key and task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
