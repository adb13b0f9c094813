"""Document fingerprints by a randomised edit embedding.

A text is cut where the last few characters say so, so an edit moves few cuts. Over each stretch a pointer walks:
at every step the current character is put out, and whether the pointer moves on is a random bit that all texts share for
that step and character, until the stretch is read. Stretches at a small edit distance meet again soon and give outputs at a small Hamming
distance. A band is a hash of the output at a few random steps, spread over as many as a stretch of that size takes; similar stretches share bands. The
fingerprint keeps, for each of its slots, the least hash of the bands that fall there, and the share of common slots
verifies how much of their text two documents share. All stretches of a batch walk side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from helixframe.llm.common import shaped, text_of
from helixframe.session import cut_lineage

SLOTS = 128
BANDS, SAMPLES = 4, 5
MEAN, LONGEST, CONTEXT = 8, 24, 4
STEPS = 3 * LONGEST
CLASSES = 1 << 10
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _shared(seed: int) -> tuple[np.ndarray, np.ndarray, list[dict[int, list[tuple[int, np.uint64]]]]]:
    """Walk bits by step and class of characters, a number for each class, and by size of stretches the bands that sample each step."""
    draw = np.random.default_rng(seed)
    bits = draw.integers(0, 2, (STEPS, CLASSES), dtype=np.int64)
    bits[-1] = 1  # so that every walk ends
    numbers = draw.integers(1, 1 << 63, CLASSES, dtype=np.uint64)
    sampled: list[dict[int, list[tuple[int, np.uint64]]]] = [{} for _ in range(LONGEST // MEAN)]
    for size, at in enumerate(sampled, 1):
        for band in range(BANDS):
            for step in np.sort(draw.choice(3 * MEAN * size, SAMPLES, replace=False)).tolist():
                at.setdefault(step, []).append((band, draw.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)))
    return bits, numbers, sampled


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _stretches(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the stretches of texts laid end to end; `ends` are the ends of the texts."""
    rolled = points.astype(np.uint64)
    total = rolled.copy()
    place = np.arange(len(points)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    for k in range(1, CONTEXT):
        total[k:] += np.where(place[k:] >= k, rolled[:-k] * _ODD ** np.uint64(k + 1), np.uint64(0))
    cut = _mixed(total) % np.uint64(MEAN) == 0
    starts = np.unique(np.concatenate([[0], np.flatnonzero(cut) + 1, ends]))
    starts = starts[starts < len(points)]
    sizes = np.diff(np.append(starts, len(points)))
    more = (sizes - 1) // LONGEST
    if more.any():
        base = np.repeat(starts, more)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        starts = np.sort(np.concatenate([starts, base + nth * LONGEST]))
    return starts


def fingerprints(texts: list[str], seed: int = 5) -> np.ndarray:
    """(texts, SLOTS) of bytes; 0 is an empty slot."""
    out = np.zeros((len(texts), SLOTS), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return out
    bits, numbers, sampled = _shared(seed)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum(sizes)
    starts = _stretches(points, ends)
    lengths = np.diff(np.append(starts, len(points)))
    owner = np.searchsorted(ends, starts, side="right")
    classes = (points * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
    hashes = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for size, by_step in enumerate(sampled):
        live = np.flatnonzero((lengths - 1) // MEAN == size)
        at, end, step = starts[live], (starts + lengths)[live], 0
        while len(live):
            here = classes[at]
            for band, factor in by_step.get(step, ()):
                hashes[live, band] += numbers[here] * factor
            at = at + bits[step % STEPS][here]
            step += 1
            going = at < end
            if not going.all():
                live, at, end = live[going], at[going], end[going]
    bands = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    values = _mixed((hashes + bands).ravel())
    # Repeated stretches count more, though not each time: with each doubling, a band is another value.
    owners = np.repeat(owner, BANDS).astype(np.uint64)
    key = (owners << np.uint64(40)) | (values >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    run = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    doublings = np.empty(len(values), dtype=np.uint64)
    doublings[order] = np.frexp(np.arange(len(values)) - np.repeat(run, np.diff(np.append(run, len(values)))))[1]
    values = _mixed(values + doublings * _ODD)
    slot = (values % np.uint64(SLOTS)).astype(np.int64)
    least = np.full((len(texts), SLOTS), np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least.reshape(-1), owners.astype(np.int64) * SLOTS + slot, values)
    there = least != np.iinfo(np.uint64).max
    out[there] = (_mixed(least[there]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row, the share of text in common that the slots show, from 0 to 1; 1 for two empty texts."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    common = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1)
    return np.where(used == 0, 1.0, 2 * common / (1 + common))


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


SCHEMA = ("part int, place int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, text string")


def _compared(ids: list, texts: list[str], others: list[str]) -> list[tuple]:
    new = [edited(t, o) for t, o in zip(texts, others)]
    n = len(texts)
    if all(a is b for a, b in zip(texts[1:], others)):  # in order: each text but the last is the other of the one before
        both, changed = np.split(fingerprints([*texts, others[-1], *new]), [n + 1])
        own, following = both[:-1], both[1:]
    else:
        own, changed, following = np.split(fingerprints([*texts, *new, *others]), [n, 2 * n])
    near, next_ = likeness(own, changed), likeness(own, following)
    return [(i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), float(x), float(y))
            for i, t, e, f, g, x, y in zip(ids, texts, new, own, changed, near, next_)]


def with_edits(docs: DataFrame, rows_per_part: int = 4_000, parts: int = 20_000, batch_chars: int = 1 << 19) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of `docs`.

    The next document is the next in order of doc_id, nulls last, equal ids in order of their texts' hashes; after the
    last comes the first. Texts are shuffled once, by ranges of ids and, within an id, of hashes, so that many rows of one
    id (or without any) are dealt over parts. Each part compares its rows in order; only its first
    and last row are written out, and the last of each part then meets the first of the next. Null texts are
    empty; repeated rows stay; other columns are not read; an empty table gives an empty result.
    """
    rows = shaped(docs, doc_id="long", text="string").select("doc_id", text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    count = max(1, min(parts, -(-rows.select("doc_id").count() // rows_per_part)))
    placed = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, ids, texts, others, size = None, [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if before is None:
                    yield batch_of([(part, 0, doc_id, *[None] * 6, text)])
                else:
                    ids.append(before[0])
                    texts.append(before[1])
                    others.append(text)
                    size += len(before[1])
                before = (doc_id, text)
                if size >= batch_chars:
                    yield batch_of([(part, None, *row, None) for row in _compared(ids, texts, others)])
                    ids, texts, others, size = [], [], [], 0
        if ids:
            yield batch_of([(part, None, *row, None) for row in _compared(ids, texts, others)])
        if before is not None:
            yield batch_of([(part, 1, before[0], *[None] * 6, before[1])])

    done = cut_lineage(placed.mapInArrow(walk, SCHEMA))
    heads = done.filter("place = 0").select("part", F.col("text").alias("other"))
    # One row a part, without texts: the part whose first row follows.
    numbers = sorted(r["part"] for r in heads.select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "part int, next int")
    tails = done.filter("place = 1").join(following, "part").select("next", "doc_id", "text").join(
        heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "other")
    out_names, out_kinds = names[2:-1], kinds[2:-1]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _compared(*(batch.column(k).to_pylist() for k in range(3)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), out_kinds)], names=out_names)

    schema = ", ".join(SCHEMA.split(", ")[2:-1])
    return done.filter("place IS NULL").select(*out_names).unionByName(tails.mapInArrow(last, schema))
