"""Secrets, and how widely each candidate is copied, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shaped
from helixframe.llm.spans import bound, located, parts, unmarked
from helixframe.session import cut_lineage

#: The base kinds in the order of their listing: pattern, and the least length of what decides (a group of it or all).
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
#: A further kind: long mixed tokens that look random. They count only where few owners have them.
MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_HINT = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}|[a-z0-9+/_=-]{20}"


def _found(text: Column, place: int, kind: str, pattern: str, least: int) -> Column:
    def entry(m: Column) -> Column:
        value = F.regexp_replace(m["value"], _VALUE, "") if kind == "assign" else m["value"]
        return F.struct(m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

    return F.filter(F.transform(bound(parts(text, pattern), located), entry), lambda m: F.length(m["value"]) >= least)


def candidates(text: Column) -> Column:
    """array<struct<start, place, end, kind, value>> in order of start, then kind; `value` is the credential itself."""
    found = [_found(text, place, kind, *rule) for place, (kind, rule) in enumerate([*KINDS.items(), ("mixed", (MIXED, 20))])]
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(_HINT), F.array_sort(F.concat(*found))).otherwise(none)


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(rows: DataFrame, salts: int = 32) -> DataFrame:
    """(digest, rows, repositories, owners) of each candidate value of rows with spans, repository and owner.

    A value is a hash from here on. Values are counted by owner and repository before they meet, so a value
    that a third of all rows hold costs no more than the pairs it has; those are counted in `salts` parts first.
    """
    each = rows.select("repository", "owner", F.explode("spans").alias("s")).select(
        F.sha2(F.col("s.value"), 256).alias("digest"), "repository", "owner")
    by_pair = each.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_pair.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(salts))).groupBy("digest", "salt", "owner").agg(
        F.sum("n").alias("n"), F.count("repository").alias("repositories"))
    return by_owner.groupBy("digest").agg(
        F.sum("n").alias("rows"), F.count("owner").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = 3) -> DataFrame:
    """(doc_id, text_key, spans, n_live, n_example), one row per row of `docs`.

    A span has start, end (code points, exclusive), kind, digest of the value, rows, repositories, owners and `live`. A value
    held by `example_owners` owners or more is a widely copied example; what fewer have is live-looking. Base kinds
    are always listed; mixed tokens only where they are live, hold no path and start no other span.
    Null and empty texts have no spans; a null owner or repository counts as none; repeated rows stay; other
    columns are not read; an empty table gives an empty result.
    """
    names = {"doc_id": "long", "text": "string", repository: "string" if repository != "doc_id" else "long", owner: "string"}
    rows = shaped(docs, **names).select("doc_id", "text", F.col(repository).cast("string").alias("repository"), F.col(owner).alias("owner"))
    rows = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("spans", candidates(unmarked(F.col("text"))))
    # The texts are scanned once: what they hold is small and written to the shared folder.
    rows = cut_lineage(rows.drop("text").withColumn("row", F.monotonically_increasing_id()))
    held = rows.filter(F.size("spans") > 0)
    counts = ownership(held)
    spans = held.select("row", F.explode("spans").alias("s")).withColumn("digest", F.sha2(F.col("s.value"), 256)).join(counts, "digest")
    live = F.col("owners") < example_owners
    spans = spans.select("row", F.struct(
        F.col("s.start").alias("start"), F.col("s.place").alias("place"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
        "digest", "rows", "repositories", "owners", live.alias("live")).alias("s"))
    spans = spans.filter((F.col("s.kind") != "mixed") | F.col("s.live"))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("found"))
    base_at = F.transform(F.filter("found", lambda s: s["kind"] != "mixed"), lambda s: s["start"])
    by_row = by_row.withColumn("found", F.filter("found", lambda s: (s["kind"] != "mixed") | ~F.array_contains(base_at, s["start"])))
    kind = dict(by_row.dtypes)["found"]
    out = rows.drop("spans").join(by_row, "row", "left").withColumn("spans", F.coalesce("found", F.array().cast(kind)))
    return out.select(
        "doc_id", "text_key", "spans", F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of what `scan` found."""
    base = F.filter("spans", lambda s: s["kind"] != "mixed")
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_example")


def redacted(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """`docs` with every live-looking span replaced by `mask`, and n_chars (if there) the new length; all rows stay."""
    found = scan(docs, **options).filter("n_live > 0").dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.filter("spans", lambda s: s["live"]).alias("_spans"))
    found = cut_lineage(found)
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_key"])
    joined = docs.join(F.broadcast(found) if found.count() <= 50_000 else found, same, "left")
    text = docs["text"]
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("done"))

    def step(s: Column, m: Column) -> Column:
        gap = F.greatest(m["start"] + 1 - s["at"], F.lit(0))
        inside = (m["start"] + 1 < s["at"])  # overlaps the span before
        return F.struct(F.greatest(s["at"], m["end"] + 1).alias("at"), F.concat(
            s["done"], F.substring(text, s["at"], gap), F.when(inside, "").otherwise(mask)).alias("done"))

    masked = F.aggregate("_spans", state, step, lambda s: F.concat(s["done"], F.substring(text, s["at"], F.length(text))))
    new = F.when(F.col("_spans").isNull(), text).otherwise(masked)
    return joined.select(*[
        new.alias("text") if c == "text" else F.when(F.col("_spans").isNull(), docs[c]).otherwise(F.length(masked)).cast(k).alias(c)
        if c == "n_chars" else docs[c] for c, k in docs.dtypes])
