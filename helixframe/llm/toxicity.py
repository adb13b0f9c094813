"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the mean of hashed embeddings of the word and of its first letters, so inflected forms
share what their stem has learnt. Filters of several widths slide over the words, the largest answer of each
filter in the whole text is kept, and a logistic layer weighs these. Since a filter's answer is a sum over
its places, a word needs only its product with every place of every filter: scoring is one table row a
word, sums of shifted rows and a maximum. Long texts are taken in stretches whose maxima are combined.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import by_bytes, shaped, text_of, written

_WORD = re.compile(r"[^\W_]+")
#: Common words that belong to one of these languages only.
COMMON_WORDS = {
    "en": "the of and to is it that for with was on are be this by from at as not have",
    "de": "der die das und ist nicht ein zu von mit für dem den auf eine im sich auch als wie",
    "fr": "le les des et une du qui dans pour est sur pas avec au ce il sont plus par aux",
    "es": "el los las y una por con para se del su como lo más al pero sus este ha ser",
}
LANGUAGES = [*COMMON_WORDS, "other"]
_LANGUAGE = {w: k for k, words in enumerate(COMMON_WORDS.values()) for w in words.split()}
BOUNDARY = 0.3
FEATURES = 4
#: Bits of the set of labelled ids.
BITS = 1 << 25


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def hashed(word: str, buckets: int) -> list[int]:
    """Buckets of the word and of its first 4, 5 and 6 letters."""
    return [zlib.crc32(word[:n].encode(), k) % buckets for k, n in enumerate((None, 4, 5, 6))]


@dataclass
class Model:
    """Parameters; all sizes are fixed, so the model stays small whatever it is trained on."""

    buckets: int = 1 << 15
    size: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 7
    embedding: np.ndarray = field(init=False)
    places: list[np.ndarray] = field(init=False)
    bias: np.ndarray = field(init=False)
    dense: np.ndarray = field(init=False)
    offset: float = 0.0
    #: Of each language, the logit from which on a text counts as toxic.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        self.embedding = draw.normal(0, 0.5, (self.buckets, self.size)).astype(np.float32)
        self.places = [draw.normal(0, 0.5 / w**0.5, (w, self.size, self.filters)).astype(np.float32) for w in self.widths]
        self.bias = np.full(len(self.widths) * self.filters, -0.1, dtype=np.float32)
        self.dense = np.full(len(self.bias), 0.1, dtype=np.float32)

    @property
    def pad(self) -> int:
        return max(self.widths) - 1


class Lexicon:
    """Words seen by a worker, with what the model makes of each; bounded by `remembered`. Row 0 is the gap between texts."""

    def __init__(self, model: Model, remembered: int = 150_000):
        self.model, self.remembered = model, remembered
        self.wide = np.concatenate([p.transpose(1, 0, 2).reshape(model.size, -1) for p in model.places], axis=1)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1, self.wide.shape[1]), dtype=np.float32)
        self.language = np.full(1, len(LANGUAGES) - 1, dtype=np.int8)

    def learn(self, texts: list[list[str]]) -> None:
        new = {w for words in texts for w in words}.difference(self.index)
        if len(self.index) + len(new) > self.remembered:
            self._clear()
            new = {w for words in texts for w in words}
        if not new:
            return
        new = sorted(new)
        at = np.array([hashed(w, self.model.buckets) for w in new])
        self.rows = np.concatenate([self.rows, self.model.embedding[at].mean(axis=1) @ self.wide])
        self.language = np.concatenate([self.language, np.array([_LANGUAGE.get(w, len(LANGUAGES) - 1) for w in new], dtype=np.int8)])
        first = len(self.index) + 1
        self.index.update(zip(new, range(first, first + len(new))))


def _pooled(model: Model, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, stretch: int = 1 << 17) -> np.ndarray:
    """The largest answer of each filter in each text; a text ends in a gap as wide as the widest filter less one."""
    if len(starts) == 1 and len(ids) > stretch + model.pad:
        parts = [_pooled(model, rows, ids[k:k + stretch + model.pad], starts) for k in range(0, len(ids) - model.pad, stretch)]
        return np.maximum.reduce(parts)
    out, at = [], 0
    for width in model.widths:
        sums = rows[ids, at:at + model.filters]
        for place in range(1, width):
            at += model.filters
            sums[:-place] += rows[ids[place:], at:at + model.filters]
        at += model.filters
        out.append(np.maximum.reduceat(sums, starts, axis=0))
    return np.concatenate(out, axis=1)


def logits(lexicon: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language of each text; the language is the one with most common words, the last if there are none."""
    model = lexicon.model
    words = [_WORD.findall(t.lower()) for t in texts]
    lexicon.learn(words)
    known, gap = lexicon.index, [0] * max(model.pad, 1)
    sizes = np.array([len(w) + len(gap) for w in words])
    ids = np.fromiter((i for w in words for i in chain(map(known.__getitem__, w), gap)), dtype=np.int64, count=int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hidden = np.maximum(_pooled(model, lexicon.rows, ids, starts) + model.bias, 0)
    cells = np.repeat(np.arange(len(texts)) * len(LANGUAGES), sizes) + lexicon.language[ids]
    votes = np.bincount(cells, minlength=len(texts) * len(LANGUAGES)).reshape(len(texts), -1)
    votes[:, -1] = 0
    language = np.where(votes.any(axis=1), votes.argmax(axis=1), len(LANGUAGES) - 1)
    return hidden @ model.dense + model.offset, language


class State:
    """A model in training, and the sums of squared gradients that its rates come from."""

    def __init__(self, model: Model, start: float = 1e-8):
        self.model = model
        self.seen = [np.full_like(p, start) for p in model.places]
        self.seen_e = np.full(model.buckets, start, np.float32)
        self.seen_b, self.seen_d, self.seen_o = np.full_like(model.bias, start), np.full_like(model.dense, start), np.full(1, start)

    def _arrays(self) -> list[np.ndarray]:
        return [*self.model.places, self.model.bias, self.model.dense, *self.seen, self.seen_b, self.seen_d, self.seen_o]

    @property
    def small(self) -> np.ndarray:
        """All numbers but those of the buckets."""
        return np.concatenate([*(x.ravel() for x in self._arrays()), [self.model.offset]]).astype(np.float64)

    @small.setter
    def small(self, values: np.ndarray) -> None:
        at = 0
        for x in self._arrays():
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size
        self.model.offset = float(values[-1])

    @property
    def wide(self) -> np.ndarray:
        """The numbers of each bucket."""
        return np.concatenate([self.model.embedding, self.seen_e[:, None]], axis=1)

    @wide.setter
    def wide(self, values: np.ndarray) -> None:
        self.model.embedding, self.seen_e = np.ascontiguousarray(values[:, :-1], dtype=np.float32), values[:, -1].astype(np.float32)


def _best_places(products: list[np.ndarray], flat: np.ndarray, starts: list[int], ends: list[int], stretch: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """The largest answer of each filter in each text and its first place, from the words' products with the filter's places."""
    best = np.full((len(starts), products[0].shape[1]), -np.inf, dtype=np.float32)
    top = np.zeros(best.shape, dtype=np.int64)
    for lo in range(0, len(flat), stretch):
        hi = min(lo + stretch, len(flat))
        sums = products[0][flat[lo:hi]]
        for place in range(1, len(products)):
            after = products[place][flat[lo + place:hi + place]]
            sums[:len(after)] += after
        for k in range(int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(starts, hi, side="left"))):
            own = sums[max(starts[k], lo) - lo:ends[k] - lo]
            at = own.argmax(axis=0)
            value = np.take_along_axis(own, at[None], axis=0)[0]
            more = value > best[k]
            best[k][more], top[k][more] = value[more], at[more] + max(starts[k], lo)
    return best, top


def _in_turn(draw: np.random.Generator, places: np.ndarray) -> Iterator[int]:
    """All places in a random order, again and again."""
    while True:
        yield from draw.permutation(places).tolist()


def learn(state: State, texts: Iterable[str], toxic: list[int], steps: int = 600, batch: int = 64, rate: float = 0.03, drop: float = 0.3, draw: int = 0, most_words: int = 1 << 19) -> None:
    """Gradient descent with per-parameter rates over texts of both kinds, which weigh the same. It takes `steps` steps, and
    goes on until every text was taken. Words are left out at random (`drop`), so that no single one decides. A step takes
    no further text of a kind beyond so many words. Deterministic for an order of texts."""
    model, target = state.model, np.array(toxic, dtype=np.float32)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in _WORD.findall(t.lower())], dtype=np.int32) for t in texts]
    at = np.array([hashed(w, model.buckets) for w in index] or [[0] * FEATURES], dtype=np.int32)
    draw, n = np.random.default_rng([model.seed, draw]), model.filters
    kinds = [np.flatnonzero(target == 1), np.flatnonzero(target == 0)]
    turns, taken = [_in_turn(draw, k) for k in kinds], [0, 0]
    step = 0
    while step < steps or any(t < len(k) for t, k in zip(taken, kinds)):
        step += 1
        chosen, weight = [], []
        for k, turn in enumerate(turns):
            own, size = [], 0
            while len(own) < batch // 2 and size <= most_words:
                own.append(next(turn))
                size += len(docs[own[-1]])
            taken[k] += len(own)
            chosen += own
            weight += [0.5 / len(own)] * len(own)
        ids, starts = [], []
        for d in chosen:
            starts.append(sum(map(len, ids)) if len(ids) < 2 else starts[-1] + len(ids[-2]) + len(ids[-1]))
            ids += [docs[d], np.full(max(model.pad, 1), -1, dtype=np.int32)]
        words, flat = np.unique(np.concatenate(ids), return_inverse=True)
        x = model.embedding[at[words]].mean(axis=1)
        gone = (words < 0) | (draw.random(len(words)) < drop)
        x[gone] = 0
        ends = [*starts[1:], len(flat)]
        hidden, best = zip(*(_best_places([x @ place for place in p], flat, starts, ends) for p in model.places))
        raw = np.concatenate(hidden, axis=1) + model.bias
        out = np.maximum(raw, 0)
        guess = 1 / (1 + np.exp(-(out @ model.dense + model.offset)))
        error = ((guess - target[chosen]) * weight).astype(np.float32)
        back = error[:, None] * model.dense * (raw > 0)
        grad_x = np.zeros_like(x)
        for k, (p, top) in enumerate(zip(model.places, best)):
            own = back[:, k * n:(k + 1) * n]
            for place in range(len(p)):
                there = flat[np.minimum(top + place, len(flat) - 1)]
                grad = np.einsum("dfk,df->kf", x[there], own) + 1e-5 * p[place]
                np.add.at(grad_x, there.ravel(), (own[:, :, None] * p[place].T).reshape(-1, model.size))
                state.seen[k][place] += grad * grad
                p[place] -= rate * grad / np.sqrt(state.seen[k][place])
        live = np.flatnonzero(np.any(grad_x, axis=1) & ~gone)
        grad_e = np.repeat(grad_x[live] / FEATURES, FEATURES, axis=0)
        rows, place = np.unique(at[words[live]].ravel(), return_inverse=True)
        total = np.zeros((len(rows), model.size), dtype=np.float32)
        np.add.at(total, place, grad_e)
        state.seen_e[rows] += (total * total).mean(axis=1)
        model.embedding[rows] -= rate * total / np.sqrt(state.seen_e[rows])[:, None]
        for value, grad, past in ((model.bias, back.sum(axis=0), state.seen_b), (model.dense, error @ out + 1e-5 * model.dense, state.seen_d)):
            past += grad * grad
            value -= rate * grad / np.sqrt(past)
        state.seen_o += float(error.sum()) ** 2
        model.offset -= rate * float(error.sum()) / float(state.seen_o[0]) ** 0.5


def undecided(toxic: int, rows: int, **shape) -> Model:
    """The model of texts of one kind only: every text gets the same score."""
    model = Model(**shape)
    model.dense[:], model.offset = 0, _logit((toxic + 0.5) / (rows + 1))
    return model


def train(texts: list[str], toxic: list[int], steps: int = 600, **shape) -> Model:
    """A model of texts that fit into memory."""
    if not 0 < sum(toxic) < len(toxic):
        return undecided(sum(toxic), len(toxic), **shape)
    state = State(Model(**shape))
    learn(state, texts, toxic, steps)
    return state.model


def packed(text: str) -> bytes:
    """A text in fewer bytes, after its size."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> str:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")


def listed(texts: DataFrame, known: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, chars, packed) of the rows (doc_id, text) whose id is in `known`, and of a few others.

    What is broadcast is a set of `bits` bits, whatever the number of ids: with more ids, more other rows pass.
    """
    spark, place = texts.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    found = known.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("mask")).toArrow()
    words = np.zeros(-(-bits // 64), dtype=np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(words)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["place"].to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            own = batch.filter(pa.array(hit))
            out = [packed(t) for t in own["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["chars"], pa.array(out, pa.binary())], names=["doc_id", "chars", "packed"])

    return texts.select("doc_id", F.length("text").cast("long").alias("chars"), place.alias("place"), "text").mapInArrow(
        pack, "doc_id long, chars long, packed binary")


@F.pandas_udf(T.StringType())
def _text(data: pd.Series) -> pd.Series:
    return data.map(unpacked)


PACKED = "block int, part int, packed binary"


def learnt(rows: DataFrame, parts: int, state: State, steps: int, buckets: int = 1 << 10) -> State:
    """The state after every part of (part, doc_id, packed, toxic) went on from `state` in a task of its own, averaged.

    A bucket is averaged over the parts that have changed it, all else over all parts. Tasks pass on blocks of buckets,
    which are added up in the order of the parts as they arrive; what reaches the driver has the size of one model.
    """
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def teach(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(text=part.pop("packed").map(unpacked)).sort_values(["doc_id", "text"], ignore_index=True)
        own = copy.deepcopy(shared.value)
        learn(own, part.pop("text"), part["toxic"].tolist(), steps, draw=int(key[0]))
        moved = (own.wide - shared.value.wide).astype(np.float32)
        packed = [own.small.tobytes(), *(moved[k:k + buckets].tobytes() for k in range(0, len(moved), buckets))]
        return pd.DataFrame({"block": range(len(packed)), "part": key[0], "packed": packed})

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = total = times = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int32()), pa.array([(total / np.maximum(times, 1)).tobytes()], pa.binary())], names=["block", "part", "packed"])

        for batch in batches:
            for block, _, packed in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(packed, dtype=np.float32).astype(np.float64).reshape(-1, shared.value.model.size + 1) if block else np.frombuffer(packed)
                if block != now:
                    if now is not None:
                        yield out()
                    now, total, times = block, np.zeros_like(values), np.zeros((len(values), 1)) if block else 0
                total += values
                times += values.any(axis=1, keepdims=True) if block else 1
        if now is not None:
            yield out()

    moved = rows.repartitionByRange(parts, "part").groupBy("part").applyInPandas(teach, PACKED)
    found = {r["block"]: np.frombuffer(r["packed"]) for r in moved.repartition("block").sortWithinPartitions("block", "part").mapInArrow(average, PACKED).collect()}
    new = copy.deepcopy(state)
    new.small = found.pop(0)
    new.wide = state.wide + np.concatenate([found[k] for k in sorted(found)]).reshape(state.wide.shape)
    return new


def best_threshold(values: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the gap between two logits at which the weighted F1 is largest."""
    order = np.argsort(-values, kind="stable")
    v, hit, weight = values[order], toxic[order] * weights[order], weights[order]
    caught, marked = np.cumsum(hit), np.cumsum(weight)
    f1 = 2 * caught / (marked + hit.sum())
    f1[:-1][v[:-1] == v[1:]] = -1
    k = int(np.argmax(f1))
    return float((v[k] + v[k + 1]) / 2) if k + 1 < len(v) else float(v[k] - 1)


def calibrate(model: Model, texts: DataFrame, least: int = 8, steps: int = 256, most: int = 32) -> None:
    """A threshold for each language with at least so many of all (text, toxic) of either kind; the others share one.

    Tasks count the texts of each language and kind by logit, in `steps` steps of one, up to `most` either way.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, seen = Lexicon(shared.value), Counter()
        for batch in batches:
            kinds = iter(batch["toxic"])
            for part in by_bytes(batch["text"], 1 << 20):
                value, language = logits(lexicon, part)
                seen.update(zip(language.tolist(), islice(kinds, len(part)), np.floor(np.clip(value, -most, most) * steps).astype(int).tolist()))
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["language", "toxic", "level", "n"])

    found = texts.select("text", "toxic").mapInPandas(count, "language int, toxic int, level int, n long")
    rows = sorted(tuple(r) for r in found.groupBy("language", "toxic", "level").agg(F.sum("n").alias("n")).collect())
    language, toxic, level, n = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    values = (level + 0.5) / steps
    if not 0 < (toxic * n).sum() < n.sum():
        model.thresholds[:] = model.offset + 1 if not model.dense.any() else 0
        return
    model.thresholds[:] = best_threshold(values, toxic, n)
    for k in range(len(LANGUAGES)):
        own = language == k
        if min((toxic * n)[own].sum(), ((1 - toxic) * n)[own].sum()) >= least:
            model.thresholds[k] = best_threshold(values[own], toxic[own], n[own])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def dealt(rows: DataFrame, toxic: int, clean: int, parts: int, least: int = 2_000) -> DataFrame:
    """The rows with a column `part`. A kind of few rows is given to several parts, so that each has about `least` of them or all."""
    times = [min(parts, max(1, -(-least * parts // n))) for n in (clean, toxic)]
    own = F.sequence(F.lit(0), F.when(F.col("toxic") == 1, times[1]).otherwise(times[0]) - 1)
    return rows.withColumn("turn", F.explode(own)).withColumn(
        "part", F.pmod(F.pmod(F.xxhash64("doc_id", "packed", F.lit(12)), F.lit(parts)) + F.col("turn"), F.lit(parts)).cast("int")).drop("turn")


def fit(docs: DataFrame, labels: DataFrame, part_rows: int = 12_000, part_chars: int = 1 << 25) -> Model:
    """A model from all labelled rows that are not held out: three quarters of them teach it, a quarter (by a hash of the
    id) sets the thresholds.

    Rows are dealt to parts of about `part_rows` rows and `part_chars` characters at most. One part teaches a first model in many steps;
    from there every part goes over all its rows in a task of its own, and the results are averaged. Rows of one part
    only teach that first model. An id with several labels is toxic if one of them says so. Null labels, ids and texts
    are left out. Without labels of both kinds, every score is the same and no text is toxic. Only texts of labelled ids
    are shuffled, packed.
    """
    known = shaped(labels, doc_id="long", toxic="int").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = shaped(docs, doc_id="long", text="string").dropna().filter(~held_out(F.col("doc_id")))
    # Both sides are shuffled whatever their size, so the work grows in proportion.
    rows = written(listed(texts, known).join(known.hint("merge"), "doc_id").withColumn("teaches", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) != 0), "labelled")
    of = rows.groupBy("teaches", "toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    own = {r["toxic"]: r["n"] for r in of if r["teaches"]}
    toxic, clean = own.get(1, 0), own.get(0, 0)
    if not toxic or not clean:
        model = undecided(toxic, toxic + clean)
    else:
        parts = max(-(-(toxic + clean) // part_rows), -(-sum(r["chars"] for r in of if r["teaches"]) // part_chars))
        teaching = dealt(rows.filter("teaches").select("doc_id", "packed", "toxic"), toxic, clean, parts)
        state = learnt(teaching.filter("part = 0"), 1, State(Model()), 600)
        model = (learnt(teaching, parts, state, 0) if parts > 1 else state).model
    calibrate(model, rows.filter(~F.col("teaches")).select(_text("packed").alias("text"), "toxic"))
    return model


def scores(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column: 0.3 is the threshold of the text's own language. Null texts are empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(shared.value)
        for texts in batches:
            parts = [np.empty(0)]
            for part in by_bytes(texts, 1 << 20):
                value, language = logits(lexicon, part)
                parts.append(1 / (1 + np.exp(-np.clip(value - shared.value.thresholds[language] + _logit(BOUNDARY), -700, 700))))
            yield pd.Series(np.concatenate(parts))

    return score(text_of(text))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`, by a model fitted to `labels`.

    The score sees the text alone; the language whose threshold counts is read from the text. Null and empty
    texts get the score of a text without words; repeated rows stay; null ids are not held out; other columns
    are not read; an empty table gives an empty result.
    """
    rows = shaped(docs, doc_id="long", text="string")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                         scores(docs.sparkSession, fit(docs, labels, **bounds), F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= BOUNDARY).cast("int"))


def clean_only(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of `docs` that score below the boundary, with all their columns."""
    return docs.filter(scores(docs.sparkSession, fit(docs, labels, **bounds), docs["text"]) < BOUNDARY)
