"""Coding changes: classes, and resolution to position, reference and alternative bases.

The genome is a table of chunks (chrom, chunk_no, seq) of one size, so every mutation joins the
few chunks around it; no task holds a chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.functions.text import reverse_complement

# Patterns of coding changes; the first that matches wholly gives the class. The third takes a
# substitution of several bases with or without the old ones before `>`.
PATTERNS = [
    r"[cg]\.[*]?[0-9+-]+([ATCG])>([ATCG])",
    r"[cg]\.[0-9]+del([ATCG]*)",
    r"[cg]\.([0-9]+)_([0-9]+)(?:[ATCG]*>)?([ATCG]+)",
    r"[cg]\.([0-9]+)_([0-9]+)ins([ATCG]+)",
    r"[cg]\.([0-9]+)[_]?([0-9]*)del([ATCG]*)ins([ATCG]+)",
    r"[cg]\.([0-9]+)_([0-9]+)del([ATCG]*[0-9]*)",
    r"[cg]\.([0-9]+)_([0-9]+)dup([ATCG]+)",
    r"[cg]\.[0-9]+dup([ATCG]?)",
    r"[cg]\.[0-9]+ins([ATCG])",
]


def change_class(c: Column) -> Column:
    """Number of the first pattern from 1, or null."""
    out = None
    for i, pattern in enumerate(PATTERNS, start=1):
        hit = c.rlike(f"^(?:{pattern})$")
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def change_part(c: Column, kind: int, group: int) -> Column:
    return F.regexp_extract(c, f"^(?:{PATTERNS[kind - 1]})$", group)


def to_chunks(sequences: DataFrame, size: int) -> DataFrame:
    """(chrom, seq) to chunks numbered from 0."""
    # One pass of a pattern over the sequence: a substring per chunk would walk from the start each time.
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.filter(F.length("seq") > 0).select("chrom", F.posexplode(pieces).alias("chunk_no", "seq"))


def lines_to_chunks(lines: DataFrame, size: int) -> DataFrame:
    """(chrom, line_no, seq) sequence lines of any widths to chunks, without a row that holds a whole sequence.

    Running lengths give each line its offset; a line is cut at the chunk borders inside it and the parts of a
    chunk are put together.
    """
    sized = lines.filter(F.length("seq") > 0).withColumn("_n", F.length("seq").cast("long"))
    placed = ordered.accumulate(sized, ["chrom"], "line_no", {"_end": ("sum", F.col("_n"))}).withColumn("_at", F.col("_end") - F.col("_n"))
    first, last = F.floor(F.col("_at") / size), F.floor((F.col("_end") - 1) / size)
    cut = placed.withColumn("chunk_no", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_at"), F.col("chunk_no") * size)
    high = F.least(F.col("_end"), (F.col("chunk_no") + 1) * size)
    part = F.substring("seq", (low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.select("chrom", "chunk_no", F.struct(low.alias("at"), part.alias("part")).alias("p"))
    # A chunk's list holds at most `size` letters.
    return parts.groupBy("chrom", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("seq"))


def with_window(df: DataFrame, chunks: DataFrame, size: int, low: Column, high: Column, key: str, name: str) -> DataFrame:
    """Attach bases low..high (0-based, half-open, cut at 0) of `chrom` as `name`, and `<name>_at`, their start."""
    low = F.greatest(low, F.lit(0))
    staged = df.withColumn(f"{name}_at", low.cast("long")).withColumn("_high", high.cast("long"))
    wanted = staged.select(
        key, "chrom", f"{name}_at", "_high",
        F.explode(F.sequence(F.floor(F.col(f"{name}_at") / size), F.floor((F.col("_high") - 1) / size))).alias("chunk_no"),
    )
    # A window covers few chunks: the list holds its length over the chunk size plus one.
    pieces = wanted.join(chunks, ["chrom", "chunk_no"]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_no", "seq"))).alias("_p")
    )
    joined = staged.join(pieces, key, "left")
    text = F.array_join(F.col("_p.seq"), "")
    first = F.col("_p")[0]["chunk_no"] * size
    cut = F.substring(text, F.col(f"{name}_at") - first + 1, F.col("_high") - F.col(f"{name}_at"))
    return joined.withColumn(name, F.upper(F.coalesce(cut, F.lit("")))).drop("_p", "_high")


def resolve(changes: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(mut_id, chrom, start, change, strand) to (…, pos, ref, alt); null where the bases disagree.

    The given start, the one before and the one after are tried in this order. Lengths that do
    not fit the coordinates leave a change unresolved.
    """
    c = F.col("change")
    # Each step is a projection of its own, so that the patterns run once per row. The pattern of the
    # class is padded with empty groups: every row then has four parts.
    wide = F.element_at(F.array(*[F.lit(f"^(?:{p})$()()()") for p in PATTERNS]), F.col("kind"))
    parts = [F.call_function("regexp_extract", c, wide, F.lit(i)).alias(f"_p{i}") for i in (1, 2, 3, 4)]
    split = changes.withColumn("kind", change_class(c)).select("mut_id", "chrom", "start", "change", "strand", "kind", *parts)
    raw = split.selectExpr(
        "mut_id", "chrom", "start", "change", "strand", "kind",
        "CASE WHEN kind IN (3, 4, 5, 6, 7) THEN try_cast(_p1 AS BIGINT) END AS _first",
        "CASE WHEN kind IN (3, 4, 5, 6, 7) THEN try_cast(nullif(_p2, '') AS BIGINT) END AS _second",
        """CASE WHEN kind = 1 THEN _p2 WHEN kind IN (2, 8, 9) THEN _p1 WHEN kind IN (3, 4, 7) THEN _p3 WHEN kind = 5 THEN _p4
           WHEN kind = 6 AND NOT _p3 RLIKE '^[0-9]+$' THEN _p3 ELSE '' END AS _alt""",
        "CASE WHEN kind = 1 THEN _p1 WHEN kind = 5 THEN _p3 ELSE '' END AS _old",
        "strand = '-' AND NOT startswith(change, 'g.') AS _flip",
    )
    staged = raw.select(
        "mut_id", "chrom", "start", "change", "strand", "kind",
        *[F.when(F.col("_flip"), reverse_complement(F.col(x))).otherwise(F.col(x)).alias(x) for x in ("_alt", "_old")],
        F.coalesce(F.coalesce("_second", "_first") - F.col("_first") + 1, F.lit(1)).alias("_n"),
    )
    reach = F.greatest(F.col("_n"), F.length("_alt"), F.lit(1)) + 3
    framed = with_window(
        staged, chunks, size, F.col("start") - reach, F.col("start") + reach, "mut_id", "_w"
    )
    a, o, n = F.col("_alt"), F.col("_old"), F.col("_n")
    la = F.length(a)

    # One row per tried start; the fetched bases are a projection of their own, so that each is cut once.
    tries = framed.withColumn("_try", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))))
    tries = tries.withColumn("_at", F.col("start") + F.col("_try"))
    at = F.col("_at")

    def fetch(low: Column, count: Column) -> Column:
        return F.substring(F.col("_w"), (low - F.col("_w_at") + 1).cast("int"), count.cast("int"))

    tries = tries.select(
        "mut_id", "_try", "_at", "kind", "_alt", "_old", "_n", la.alias("_la"), F.length(o).alias("_lo"),
        fetch(at - 1, F.lit(1)).alias("_one"), fetch(at - 1, F.lit(2)).alias("_two"),
        fetch(at - 1, n).alias("_replaced"), fetch(at - 1, la).alias("_copied"), fetch(at - 1, n + 1).alias("_cut"),
        fetch(at - n - 1, n + 1).alias("_back_cut"), fetch(at - n, la).alias("_back_copied"),
    )
    found = F.expr(
        """CASE
        WHEN kind = 1 AND _one = _old THEN struct(_at AS pos, _one AS ref, _alt AS alt)
        WHEN kind = 2 AND (_la = 0 OR _alt = substr(_two, 2)) THEN struct(_at AS pos, _two AS ref, left(_two, 1) AS alt)
        WHEN kind = 3 AND _n = _la THEN struct(_at AS pos, _copied AS ref, _alt AS alt)
        WHEN kind = 4 AND _n = 2 THEN struct(_at AS pos, _one AS ref, concat(_one, _alt) AS alt)
        WHEN kind = 5 AND (_lo = 0 OR (_lo = _n AND _replaced = _old)) THEN struct(_at AS pos, _replaced AS ref, _alt AS alt)
        WHEN kind = 6 AND (_la = 0 OR (_la = _n AND substr(_cut, 2) = _alt)) THEN struct(_at AS pos, _cut AS ref, left(_cut, 1) AS alt)
        WHEN kind = 6 AND _la = _n AND substr(_back_cut, 2) = _alt THEN struct(_at - _n AS pos, _back_cut AS ref, left(_back_cut, 1) AS alt)
        WHEN kind = 7 AND _la = _n AND _copied = _alt THEN struct(_at AS pos, _copied AS ref, concat(_copied, _alt) AS alt)
        WHEN kind = 7 AND _la = _n AND _back_copied = _alt THEN struct(_at - _n + 1 AS pos, _back_copied AS ref, concat(_back_copied, _alt) AS alt)
        WHEN kind = 8 AND (_la = 0 OR _alt = _one) THEN struct(_at AS pos, _one AS ref, concat(_one, _one) AS alt)
        WHEN kind = 9 THEN struct(_at AS pos, _one AS ref, concat(_one, _alt) AS alt)
        END"""
    )
    order = F.when(F.col("_try") == 0, 0).when(F.col("_try") == -1, 1).otherwise(2)
    hit = tries.withColumn("_r", found).filter(F.col("_r").isNotNull()).groupBy("mut_id").agg(F.min_by("_r", order).alias("_r"))
    return staged.join(hit, "mut_id", "left").select("mut_id", "chrom", "start", "change", "kind", "_r.pos", "_r.ref", "_r.alt")


def flanks(df: DataFrame, chunks: DataFrame, size: int, n: int) -> DataFrame:
    """(key, chrom, pos) with the n bases before the position and the n bases after it."""
    low = F.greatest(F.col("pos") - n, F.lit(0))
    out = with_window(df, chunks, size, low, F.col("pos") + n, "key", "_w")
    before = F.substring("_w", F.lit(1), (F.col("pos") - 1 - F.col("_w_at")).cast("int"))
    return out.select(
        *df.columns, before.alias("up"),
        F.substring("_w", (F.col("pos") - F.col("_w_at")).cast("int"), F.lit(n + 1)).alias("down"),
    )


def fusion_sequence(breaks: DataFrame, chunks: DataFrame, size: int, n: int = 10) -> DataFrame:
    """`left|right` bases over a breakpoint pair (key, c5, s5, strand5, c3, s3, strand3).

    On the plus strand the left part lies before the breakpoint and the right part after it;
    on the minus strand the other way round, and complemented.
    """
    out = breaks
    for end, plus_before in (("5", True), ("3", False)):
        pos, plus = F.col(f"s{end}"), F.col(f"strand{end}") == "+"
        before = plus if plus_before else ~plus
        low = F.when(before, pos - n).otherwise(pos)
        high = F.when(before, pos + 1).otherwise(pos + 1 + n)
        out = with_window(out.withColumn("chrom", F.col(f"c{end}")), chunks, size, low, high, "key", f"w{end}")
        out = out.withColumn(f"w{end}", F.when(plus, F.col(f"w{end}")).otherwise(reverse_complement(F.col(f"w{end}"))))
    return out.select("key", F.concat_ws("|", "w5", "w3").alias("sequence"))
