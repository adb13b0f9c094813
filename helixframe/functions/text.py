"""Column functions on sequences, identifiers and annotation strings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter amino acid names and their letters.
AMINO_ACIDS = {
    "Cys": "C", "Asp": "D", "Ser": "S", "Gln": "Q", "Lys": "K", "Ile": "I", "Pro": "P", "Thr": "T", "Phe": "F", "Asn": "N",
    "Gly": "G", "His": "H", "Leu": "L", "Arg": "R", "Trp": "W", "Ala": "A", "Val": "V", "Glu": "E", "Tyr": "Y", "Met": "M",
}


def strip_version(c: Column) -> Column:
    """Everything before the last dot."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def before_dot(c: Column) -> Column:
    return F.split(c, r"\.")[0]


def reverse_complement(c: Column) -> Column:
    """Upper-case reverse complement; letters other than A, C, G and T stay."""
    return F.reverse(F.translate(F.upper(c), "ATCG", "TAGC"))


def short_amino_acids(c: Column) -> Column:
    for name, letter in AMINO_ACIDS.items():
        c = F.replace(c, F.lit(name), F.lit(letter))
    return c


def fraction(c: Column, percent_column: Column | bool = False) -> Column:
    """`7%` or `0.07` as a number; a bare number counts as percent where the header says so."""
    bare = c.try_cast("double")
    is_percent = F.lit(percent_column) if isinstance(percent_column, bool) else percent_column
    return F.when(c.endswith("%"), F.rtrim(F.regexp_replace(c, "%$", "")).try_cast("double") / 100).otherwise(
        F.when(is_percent, bare / 100).otherwise(bare)
    )


def hgvs_list(c: Column) -> Column:
    """`gene:transcript:exon:c:p,...` as an array of structs; missing trailing fields are null."""
    def one(x: Column) -> Column:
        p = F.split(x, ":")
        return F.struct(
            *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("gene", "transcript", "exon", "chgvs", "phgvs"))]
        )

    return F.transform(F.split(c, ","), one)


def canonical_hgvs(hgvs: Column, canonical: Column) -> Column:
    """First annotation on the canonical transcript; a lone annotation counts as such."""
    hit = F.filter(hgvs, lambda x: canonical.startswith(before_dot(x["transcript"])) | (F.size(hgvs) == 1))
    return F.get(hit, F.lit(0))


def variant_id(chrom: str, pos: str, ref: str, alt: str) -> Column:
    return F.concat_ws(":", chrom, F.col(pos).cast("string"), ref, alt)


def parse_variant(c: Column) -> list[Column]:
    """chrom, pos, ref, alt of `chr:pos,ref>alt`."""
    pattern = r"^([^:]*):(\d+),([^>]*)>(.*)$"
    return [
        F.regexp_extract(c, pattern, 1).alias("chrom"), F.regexp_extract(c, pattern, 2).cast("long").alias("pos"),
        F.regexp_extract(c, pattern, 3).alias("ref"), F.regexp_extract(c, pattern, 4).alias("alt"),
    ]


def deletion_keys(c: Column) -> Column:
    """Comparable coding changes: the deleted bases go; a duplication is an insertion as well."""
    base = F.regexp_replace(c, "del.*$", "del")
    return F.array_distinct(F.array(base, F.replace(base, F.lit("dup"), F.lit("ins"))))


def lowest_version(c: Column) -> Column:
    """The transcript with the lowest version named in a message."""
    found = F.regexp_extract_all(c, F.lit(r"(NM_[0-9]+\.[0-9]+)"), F.lit(1))
    keyed = F.transform(found, lambda x: F.struct(F.split(x, r"\.")[1].cast("int").alias("v"), x.alias("t")))
    return F.get(F.array_sort(keyed), F.lit(0))["t"]


def region_parts(c: Column) -> Column:
    """`chr:g.1_2del__chr:g.7A>C` as an array of (chrom, change, start)."""
    return F.transform(
        F.split(c, "__"),
        lambda x: F.struct(
            F.split(x, ":")[0].alias("chrom"), F.get(F.split(x, ":"), F.lit(1)).alias("change"),
            F.regexp_extract(x, r"g\.([0-9]+)", 1).try_cast("long").alias("start"),
        ),
    )


def run_name_fields(c: Column) -> list[Column]:
    """Mutation id, allele fraction and seed of `…snv12af005seed3…` names."""
    return [
        F.regexp_extract(c, r"(?i)(?:snv|indel)(.*?)af", 1).alias("mutation_id"),
        F.regexp_replace(F.regexp_extract(c, r"af([^s]*)seed", 1), "^0", "0.").try_cast("double").alias("af"),
        F.regexp_extract(c, r"seed(\d*)", 1).alias("seed"),
    ]


def leading_repeats(text: Column, unit: Column) -> Column:
    """How many times `unit` is repeated at the start of the text."""
    run = F.call_function("regexp_extract", text, F.concat(F.lit("^(?:"), unit, F.lit(")*")), F.lit(0))
    return F.floor(F.length(run) / F.length(unit))


def repeats_at(text: Column, unit: Column, offset: Column) -> Column:
    """Repeats of `unit` reading on from an offset (0-based) and backwards from it."""
    ahead = F.substring(text, offset + 1, F.length(text))
    behind = F.reverse(F.substring(text, F.lit(1), offset))
    return leading_repeats(ahead, unit) + leading_repeats(behind, F.reverse(unit))


def read_repeats(
    full: Column, aligned: Column, clip_before: Column, clip_after: Column, offset: Column,
    unit: Column, left: Column, right: Column,
) -> Column:
    """Repeats of a site seen by a read: from the site on, backwards, and on into the clipped ends
    when the aligned end is used up.

    After the left flank a shifted start is found again; without the flank the pattern
    flank-repeats-flank is searched in the whole read.
    """
    before = F.substring(aligned, F.lit(1), offset)
    after = F.substring(aligned, offset + 1, F.length(aligned))
    at_flank = before.endswith(left) | left.endswith(before)
    found = F.call_function("instr", after, unit)
    # Without the unit the last letter is left, as a search result of -1 counts from the end.
    shifted = F.when(found > 0, F.substring(after, found, F.length(after))).otherwise(F.right(after, F.lit(1)))
    pattern = F.concat(left, F.lit("((?:"), unit, F.lit(")+?"), right, F.lit(")"))
    spanned = F.call_function("regexp_extract", full, pattern, F.lit(1))
    ahead = (
        F.when(at_flank & ~after.startswith(unit), shifted)
        .when(~at_flank & (F.length(spanned) > 0), spanned)
        .otherwise(after)
    )
    forward, backward = leading_repeats(ahead, unit), leading_repeats(F.reverse(before), F.reverse(unit))
    used_up_ahead = forward * F.length(unit) == F.length(ahead)
    used_up_before = backward * F.length(unit) == F.length(before)
    return (
        forward + backward
        + F.when(used_up_before, leading_repeats(F.reverse(clip_before), F.reverse(unit))).otherwise(0)
        + F.when(used_up_ahead, leading_repeats(clip_after, unit)).otherwise(0)
    )


def price_per_area(price: Column, area: Column) -> Column:
    """Total price text (units 万 = 10^4, 亿 = 10^8, 元 = 1) over `…m` area text; null if negotiable."""
    number = F.regexp_extract(price, r"([0-9.]+)", 1).try_cast("double")
    unit = F.when(price.contains("万"), 1e4).when(price.contains("亿"), 1e8).otherwise(1.0)
    size = F.regexp_extract(area, r"([0-9.]+)", 1).try_cast("double")
    return F.when(~price.contains("面"), F.try_divide(number * unit, size))


def html_field(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def banded(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """Name of the first band whose upper bound exceeds the value."""
    (bound, name), *rest = bands
    out = F.when(value < bound, name)
    for bound, name in rest:
        out = out.when(value < bound, name)
    return out.otherwise(last)


# Upper bounds and colours of the frequency bands.
FREQUENCY_BANDS = [(0.005, "grey"), (0.01, "lightgreen"), (0.02, "yellow"), (0.03, "pink")]


def allele_fraction(info_af: Column, format_af: Column, alt_reads: Column, depth: Column) -> Column:
    """From the record, else the sample, else reads over depth; four decimals."""
    return F.round(F.coalesce(info_af, format_af, F.when(depth > 0, alt_reads / depth)), 4)


def splice_annotation(aa_change: Column, gene: Column, detail: Column) -> Column:
    """Without a protein annotation, `gene:detail` for every part of the detail field."""
    parts = F.split(detail, r"\\x3b")
    return F.when(aa_change == ".", F.array_join(F.transform(parts, lambda x: F.concat(gene, F.lit(":"), x)), ",")).otherwise(aa_change)


def reduce_to_canonical(aa_change: Column, canonical: Column) -> Column:
    """The annotation on the gene's canonical transcript if there is one, else all of them."""
    hit = F.filter(F.split(aa_change, ","), lambda x: before_dot(F.get(F.split(x, ":"), F.lit(1))) == before_dot(canonical))
    return F.coalesce(F.get(hit, F.lit(0)), aa_change)
