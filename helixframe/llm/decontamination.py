"""Benchmark decontamination by templates.

Words, which any white space parts, are compared without case and outer punctuation; numbers, names (capitalised words inside a
sentence) and units (unit words after a number) become typed placeholders, so a question with other
numbers or names keeps its template. Windows of templates are joined by hash. A value of the item must then stand for
one value of the document along an alignment, or only long copies in it count. Windows are also joined by their words
as they are, so exact copies are found that have too few ordinary words for a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shaped, text_of, without

#: Words that count as a unit after a number.
UNITS = frozenset(
    "km m cm mm mi ft in yd kg g mg lb lbs oz l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week "
    "weeks month months year years percent dollar dollars cent cents euro euros pound pounds mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres foot feet inch inches degrees "
    "stunde stunden tag tage woche wochen jahr jahre prozent heures jours semaines ans mois horas días semanas años meses por".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*\Z")
_MIXED = re.compile(r"([+-]?\d+(?:[.,:/]\d+)*)[^\W\d_]{1,3}\Z")
LITERAL, NUMBER, BREAK, EMPTY, NAME, UNIT = range(6)
_PLACEHOLDER = {NUMBER: 0x9E3779B97F4A7C15, NAME: 0xC2B2AE3D27D4EB4F, UNIT: 0x165667B19E3779F9}
_EXACT = np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIER = np.uint64(0x9E6C63D0876A9A63)
SCHEMA = "doc_id long, text_key long, at int, size int, digest long, windows int, templates int, exact boolean, slots array<string>"


class Vocabulary:
    """What is known of written words; bounded by `remembered`."""

    def __init__(self, remembered: int = 300_000):
        self.remembered = remembered
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.columns = [np.zeros(1024, np.uint64), *(np.zeros(1024, np.int8) for _ in range(3))]  # with room beyond the index

    def of(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Index of each word, and by index: digest, kind, whether capitalised, whether it ends a sentence."""
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > self.remembered:
            self._clear()
            new = set(words)
        if new:
            rows, start = [], len(self.index)
            for word in new:
                self.index[word] = len(self.index)
                if word.isalpha():
                    low = word.lower()
                    rows.append((xxhash.xxh3_64_intdigest(low), UNIT if low in UNITS else LITERAL, word[0].isupper(), False))
                    continue
                plain = _EDGE.sub("", word)
                low = plain.lower()
                if word == "\n":
                    kind = BREAK
                elif not plain:
                    kind = EMPTY
                elif _NUMBER.match(plain) or _MIXED.match(plain):
                    kind = NUMBER
                else:
                    kind = UNIT if low in UNITS else LITERAL
                digest = xxhash.xxh3_64_intdigest(low)
                rows.append((digest, kind, plain[:1].isupper(), word == "\n" or word.rstrip("\"')]»”").endswith((".", "!", "?", ":", "…"))))
            end = len(self.index)
            if end > len(self.columns[0]):  # doubled, so that a word is copied a bounded number of times
                self.columns = [np.concatenate([old, np.zeros(max(end, 2 * len(old)) - len(old), old.dtype)]) for old in self.columns]
            for column, values in zip(self.columns, zip(*rows)):
                column[start:end] = np.array(values, dtype=column.dtype)
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words)), self.columns


def template(text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Digests of each word in the template and as it is, its kind, the words as written, and the place of each among them."""
    words: list[str] = []
    for line in text.splitlines():
        words.extend(line.split())
        words.append("\n")
    index, (digest, kind, capital, ends) = vocabulary.of(words)
    kind, capital, ends = kind[index], capital[index], ends[index]
    first = np.concatenate([[True], ends[:-1].astype(bool)])
    real = np.flatnonzero((kind != BREAK) & (kind != EMPTY))
    # A word after an empty one takes over whether a sentence begins.
    begins = np.add.reduceat(first[:real[-1] + 1].astype(np.int64), np.concatenate([[0], real[:-1] + 1])) > 0 if len(real) else np.zeros(0, bool)
    kind, capital, digest = kind[real], capital[real].astype(bool), np.tile(digest[index[real]], (2, 1))
    after_number = np.concatenate([[False], kind[:-1] == NUMBER]) if len(real) else np.zeros(0, bool)
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    kind = np.where((kind == LITERAL) & capital & ~begins, NAME, kind)
    for k, value in _PLACEHOLDER.items():
        digest[0, kind == k] = value
    return digest, kind, words, real


def windows(digest: np.ndarray, kind: np.ndarray, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, windows) digests of the windows of `size` words as templates and as they are, and whether a window holds at least
    `literals` ordinary words, without which its template does not count."""
    count = len(kind) - size + 1
    if count <= 0:
        return np.zeros((2, 0), np.uint64), np.zeros(0, bool)
    total = np.zeros((2, count), dtype=np.uint64)
    for k in range(size):
        total *= _MULTIPLIER
        total += digest[:, k:k + count]
    total[1] ^= _EXACT
    plain = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return total, plain[size:] - plain[:-size] >= min(literals, size)


def _windows_of(rows: DataFrame, sizes: list[int], literals: int, bitmap=None, whole: bool = False) -> DataFrame:
    """Windows of (doc_id, text_key, text) rows. With `whole`, a text shorter than the largest size is one window of
    its own length, and `windows` and `templates` say how many a text has; with a bitmap, only windows whose bit is set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                digest, kind, words, real = template(text, vocabulary)
                for size in [min(sizes[0], len(kind))] if whole else sizes:
                    if not size:
                        continue
                    value, common = windows(digest, kind, size, literals)
                    total, templates = len(common), int(np.count_nonzero(common))
                    hit = np.ones_like(value, dtype=bool) if bits is None else bits[value & np.uint64(len(bits) - 1)]
                    hit[0] &= common
                    for way, a in zip(*(x.tolist() for x in np.nonzero(hit))):
                        slots = [] if way else [f"{kind[p]}{_EDGE.sub('', words[real[p]]).lower()}" for p in range(a, a + size) if kind[p] != LITERAL]
                        out.append((doc_id, key, a, size, int(value[way, a].view(np.int64)), total, templates, not common[a], slots))
            if out:
                names = ["doc_id", "text_key", "at", "size", "digest", "windows", "templates", "exact", "slots"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.select("doc_id", "text_key", "text").mapInArrow(made, SCHEMA)


def _keyed(df: DataFrame, id_col: str) -> DataFrame:
    rows = shaped(df, **{id_col: "long", "text": "string"})
    return rows.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 8, literals: int = 4, share: float = 0.5,
            run: int = 6, verbatim: int = 18, bits: int = 1 << 22) -> DataFrame:
    """(doc_id, text_key, item_id, matched, windows, share, changed): items of which a document holds at least `share` of the
    windows, or `run` of them (6 windows of 8 words are 13 words in a row).

    `changed` counts slots in which the document differs from the item: a re-parameterised question has some. An alignment
    in which one value of the item stands for several of the document is another question; of it count only windows
    with the item's own values, if there are `verbatim` of them (18 windows of 8 words are 25 words in a row). `share` is
    that of all windows or that of the windows with a template, which can match with other values, whichever is more.

    Documents' windows pass a bitmap of the benchmark's digests, of a fixed number of bits, before they leave
    Python; the join that decides is exact in any case, and a large benchmark only lets more of them pass. Items
    with fewer than `size` words are one window; windows without `literals` ordinary words match exact copies only. Null and empty texts match nothing; equal items are found each; repeated rows of a document and
    null ids give one row for each id and text; other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = _keyed(benchmark.select(*[benchmark[c] for c in benchmark.columns if c in ("item_id", "text")]), "item_id").distinct()
    own = _windows_of(items, [size], literals, whole=True).select(
        F.col("doc_id").alias("item_id"), F.struct(F.col("at").alias("place"), "exact").alias("window"), "size", "digest", "windows",
        "templates", F.col("slots").alias("item_slots"))
    sizes = sorted({r["size"] for r in own.select("size").distinct().collect()}, reverse=True)
    bitmap = np.zeros(bits, dtype=bool)
    digests = own.select(F.col("digest")).distinct()
    unsigned = F.pmod(F.col("digest"), F.lit(bits))  # bits is a power of two, so the sign does not matter
    bitmap[digests.select(unsigned.alias("b")).distinct().toPandas()["b"].to_numpy(dtype=np.int64)] = True
    candidates = _windows_of(_keyed(docs, "doc_id"), sizes, literals, spark.sparkContext.broadcast(bitmap)).drop("windows", "templates", "exact")
    pairs = candidates.join(own, ["size", "digest"])
    item = ["doc_id", "text_key", "item_id", "windows", "templates"]
    along = pairs.groupBy(*item, (F.col("at") - F.col("window.place")).alias("shift"))
    slots = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    copied = F.collect_set(F.when(F.col("item_slots") == F.col("slots"), F.col("window")))
    aligned = along.agg(F.collect_set("window").alias("all"), copied.alias("copied"), slots.alias("pairs"))
    one_value = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    counted = F.when(one_value, F.col("all")).when(F.size("copied") >= verbatim, F.col("copied"))
    changed = F.size(F.filter("pairs", lambda p: p["item_slots"] != p["slots"]))
    found = aligned.withColumn("held", counted).filter("held IS NOT NULL").groupBy(*item).agg(
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.max(changed).alias("changed"))
    by_template = F.size(F.filter("held", lambda w: ~w["exact"])) / F.nullif("templates", F.lit(0))
    found = found.withColumn("matched", F.size("held")).withColumn("share", F.greatest(F.col("matched") / F.col("windows"), by_template))
    return found.filter((F.col("share") >= share) | (F.col("matched") >= run)).select(
        "doc_id", "text_key", "item_id", "matched", "windows", "share", "changed")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    return without(docs, matches(docs, benchmark, **options))
