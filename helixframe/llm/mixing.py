"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Words of the dictionary (the most frequent ones of the training texts) are
paths in a code tree, other words take the tree's escape and are spelled bit by bit, so every text has a probability.
Each bit is predicted in four ways: by the counts of its tree node (or of the byte before), by two hashed contexts (the
word before and the two words before; the last three and the last four bytes) whose counts come from all training texts,
and by the counts of the text itself so far. The predictions are combined in the logistic domain by a set of weights
that a gate chooses from the kind of the bit and from how much each context has seen. The answer is refined by a map
from mixed to observed odds. Weights and map start from values learnt on training texts and are adapted after every
block of a text, so the bits of a block are computed side by side for many texts.

Counting, learning and scoring are passes over the texts in tasks. What meets is counts: words, and blocks of the hashed
tables. Only the dictionary and the tables, whose sizes are parameters, reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from helixframe.llm.common import shaped, text_of, written
from helixframe.session import cut_lineage

DICTIONARY = 1 << 18
TABLE_BITS = 21
#: Slots of a counted block of a table.
PART = 1 << 14
#: Tokens of a block, characters of texts that are scored together, bytes of a long text that are read at once, tokens whose bits are computed at once.
BLOCK, SLICE, PIECE, CHUNK = 128, 1 << 19, 1 << 18, 1 << 13
#: A spelled word is taken in parts of so many bytes.
SEGMENT = 128
#: Own counts of a text are halved after so many bits, so that no count leaves 16 bits.
HALVED = 12_000
INPUTS, GATES, CELLS = 4, 2 * 4 * 4 * 3, 33
#: Steps of the weights while they are learnt and within a text, their first value, what is added to counts, and how often a cell of
#: the map counts as seen before a text.
LEARNING, RATE, START, ADDED, MAP_WEIGHT = 0.005, 0.01, 0.3, 0.4, 24.0
SPACE = 0x20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Mixed odds stay within this; odds in steps of 1/256, up to 32 either way, and the logarithms of chances there.
_MOST, _HALF = np.float32(15), 32 * 256
_ODDS = np.arange(-_HALF, _HALF + 1) / 256
_CHANCE = (1 / (1 + np.exp(-_ODDS))).astype(np.float32)
_RIGHT = -np.logaddexp(0, -_ODDS)
_LOG = np.log(np.arange(1 << 16) + ADDED).astype(np.float32)
_SEEN = np.digitize(np.arange(1 << 17), (1, 3, 16)).astype(np.int32)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a long one in pieces that end at white space."""
    data, at = text.encode("utf-8", "surrogatepass").lower(), 0
    while len(data) - at > PIECE:
        blank = _BLANK.search(data, at + PIECE)
        if not blank:
            break
        yield data[at:blank.start()].split()
        at = blank.end()
    yield data[at:].split()


# --- the code tree -----------------------------------------------------------------------

@dataclass
class Code:
    """The paths of symbols in a binary tree."""

    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    prior: np.ndarray  # the odds of each node

    def sizes(self, symbol: np.ndarray) -> np.ndarray:
        return self.start.take(symbol + 1) - self.start.take(symbol)


def code(weights: list[int]) -> Code:
    """The tree of least mean path length over the symbols (two at least) of these weights. Ties go by their order."""
    n = len(weights)
    weight = [*weights, *[0] * (n - 1)]
    parent, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.int8)
    leaves = np.argsort(np.array(weights, dtype=np.int64), kind="stable").tolist()
    leaf, inner = 0, n
    for made in range(n, 2 * n - 1):
        pair = []
        for _ in range(2):
            if leaf < n and (inner == made or weight[leaves[leaf]] <= weight[inner]):
                pair.append(leaves[leaf])
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        weight[made] = weight[pair[0]] + weight[pair[1]]
        parent[pair], side[pair[1]] = made, 1
    owners, nodes, bits, at, own = [], [], [], np.arange(n), np.arange(n)
    while len(at):
        owners.append(own)
        nodes.append(parent[at] - n)
        bits.append(side[at])
        at = parent[at]
        on = at < 2 * n - 2
        at, own = at[on], own[on]
    order = np.argsort(np.concatenate(owners), kind="stable")
    owner, node, bit = (np.concatenate(x)[order] for x in (owners, nodes, bits))
    mass = np.zeros((2, n - 1))
    np.add.at(mass, (side[:-1].astype(int), parent[:-1] - n), np.array(weight[:-1], dtype=float))
    prior = np.log((mass[1] + ADDED) / (mass[0] + ADDED)).astype(np.float32)
    return Code(np.searchsorted(owner, np.arange(n + 1)), node.astype(np.uint32), bit, prior)


@dataclass
class Tree:
    """The code of the words of the dictionary, the end and the escape, and that of the bytes of spelled words, where a space ends a word."""

    words: list[bytes]
    counts: np.ndarray  # of the words
    symbols: Code
    letters: Code

    @cached_property
    def index(self) -> dict[bytes | None, int]:
        """Places of the words; that of the end is under None."""
        return {w: k for k, w in enumerate([*self.words, None])}

    @property
    def escape(self) -> int:
        return len(self.words) + 1


def tree_of(words: list[bytes], counts: list[int], ends: int, escapes: int, letters: list[int]) -> Tree:
    """Every symbol and byte counts once more than it was seen."""
    return Tree(words, np.array(counts, dtype=np.int64), code([*counts, ends + 1, escapes + 1]), code([n + 1 for n in letters]))


# --- bits of texts -----------------------------------------------------------------------

def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _parted(words: list[bytes | None]) -> tuple[list[bytes | None], list[bool]]:
    """Words in parts of SEGMENT bytes, and whether a part goes on a word."""
    parts, more = [], []
    for word in words:
        if word is None or len(word) <= SEGMENT:
            parts.append(word)
            more.append(False)
        else:
            cut = [word[k:k + SEGMENT] for k in range(0, len(word), SEGMENT)]
            parts += cut
            more += [False] + [True] * (len(cut) - 1)
    return parts, more


class Tokens:
    """The tokens of some texts (lanes): symbols, hashes of the words before, and the bytes of spelled words."""

    def __init__(self, tree: Tree, texts: list[list[bytes]], before: np.ndarray, ends: bool):
        """`before`: the keys of the last two words of each text, brought up to date."""
        words = [w for own in texts for w in ([*own, None] if ends else own)]
        sizes = [len(own) + ends for own in texts]
        symbol = np.fromiter(map(tree.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        rare = np.flatnonzero(symbol < 0)
        goes_on = np.zeros(len(words), dtype=bool)
        if any(len(words[k]) > SEGMENT for k in rare.tolist()):
            parted = [_parted([w if tree.index.get(w, -1) < 0 else w[:0] for w in own]) for own in texts]  # known words stay whole
            known = [[tree.index.get(w, -1) for w in own] for own in texts]
            words, flags, found, sizes = [], [], [], []
            for (parts, more), own, full in zip(parted, known, texts):
                whole, k = [], -1
                for part, on in zip(parts, more):
                    k += not on
                    whole.append(full[k] if own[k] >= 0 else part)
                    found.append(own[k])
                words += whole + [None] * ends
                flags += more + [False] * ends
                found += [len(tree.words)] * ends
                sizes.append(len(parts) + ends)
            symbol, goes_on = np.array(found, dtype=np.int64), np.array(flags, dtype=bool)
            rare = np.flatnonzero(symbol < 0)
        spelled = [words[k] for k in rare.tolist()]
        self.rare, self.goes_on, self.spelled = rare, goes_on, spelled
        self.sizes = np.array(sizes, dtype=np.int64)
        self.lane = np.repeat(np.arange(len(texts)), self.sizes)
        firsts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(words)) - np.repeat(firsts, self.sizes)
        keys = symbol.astype(np.uint32)
        keys[rare] = np.fromiter(map(zlib.crc32, spelled), dtype=np.uint32, count=len(spelled))
        keys = keys * _B + np.uint32(1)
        self.symbol = np.where(goes_on, -1, np.where(symbol < 0, tree.escape, symbol))
        one, two = np.empty_like(keys), np.empty_like(keys)
        one[1:], two[2:] = keys[:-1], keys[:-2]
        some, more = self.sizes > 0, self.sizes > 1
        one[firsts[some]], two[firsts[some]] = before[some, 0], before[some, 1]
        two[firsts[more] + 1] = before[more, 0]
        lasts = firsts + self.sizes - 1
        before[some, 1] = before[some, 0]
        before[more, 1] = keys[lasts[more] - 1]
        before[some, 0] = keys[lasts[some]]
        self.one = (one ^ (one >> np.uint32(15))) * _A
        mixed = self.one ^ (two * _C)
        self.two = (mixed ^ (mixed >> np.uint32(13))) * _B + np.uint32(7)
        # Bytes of spelled words with a space after the last part, and the four bytes before each, within its part.
        closed = np.append(~goes_on[1:], True)[rare] if len(rare) else np.zeros(0, dtype=bool)
        spelled = [w + b" " if last else w for w, last in zip(spelled, closed.tolist())]
        lengths = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        self.bytes_size, self.bytes_start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        begin = np.cumsum(lengths) - lengths
        self.bytes_size[rare], self.bytes_start[rare] = lengths, begin
        self.data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        inside = np.arange(len(self.data)) - np.repeat(begin, lengths)
        self.past = np.zeros(len(self.data), dtype=np.uint32)
        for k in range(1, 5):
            shifted = np.full(len(self.data), SPACE, dtype=np.uint32)
            shifted[k:] = self.data[:-k]
            shifted[inside < k] = SPACE
            self.past |= shifted << np.uint32(8 * (k - 1))


    def unlisted(self) -> Iterator[tuple[int, bytes]]:
        """The words outside the dictionary with their lanes."""
        held: list = []
        for k, lane, word in zip(self.rare.tolist(), self.lane[self.rare].tolist(), self.spelled):
            if self.goes_on[k]:
                held[1].append(word)
                continue
            if held:
                yield held[0], b"".join(held[1])
            held = [lane, [word]]
        if held:
            yield held[0], b"".join(held[1])


@dataclass
class Bits:
    """The bits of some tokens: where each input finds its counts, the lane and the bit itself. The first `words` bits are of
    words, the rest of spelled bytes."""

    zero: np.ndarray
    one: np.ndarray
    two: np.ndarray
    own: np.ndarray
    lane: np.ndarray
    bit: np.ndarray
    words: int


def _slot(context: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
    mixed = place * _A
    mixed += context
    mixed *= _C
    mixed ^= mixed >> np.uint32(16)
    mixed *= _B
    mixed >>= np.uint32(32 - TABLE_BITS)
    out[:] = mixed


def bits_of(tree: Tree, tokens: Tokens, at: np.ndarray) -> Bits:
    """The bits of the tokens at the places `at`."""
    coded = at[tokens.symbol.take(at) >= 0]
    symbol = tokens.symbol.take(coded)
    sizes = tree.symbols.sizes(symbol)
    path = _ranges(tree.symbols.start.take(symbol), sizes)
    node = tree.symbols.node.take(path)
    spelled = at[tokens.bytes_size.take(at) > 0]
    lengths = tokens.bytes_size.take(spelled)
    byte = _ranges(tokens.bytes_start.take(spelled), lengths)
    letter, past = tokens.data.take(byte).astype(np.intp), tokens.past.take(byte)
    steps = tree.letters.sizes(letter)
    way = _ranges(tree.letters.start.take(letter), steps)
    turn = tree.letters.node.take(way)
    n, words = len(node) + len(turn), len(node)
    bits = Bits(*(np.empty(n, dtype=kind) for kind in (np.intp, np.intp, np.intp, np.uint32, np.intp, np.int8)), words)
    bits.zero[:words] = node
    bits.zero[words:] = turn
    last = (past & np.uint32(0xFF)).astype(np.intp) * 256 + len(tree.symbols.prior)
    bits.zero[words:] += np.repeat(last, steps)
    turn += np.uint32(1 << 24)
    _slot(np.repeat(tokens.one.take(coded), sizes), node, bits.one[:words])
    _slot(np.repeat((past & np.uint32(0xFFFFFF)) * _C, steps), turn, bits.one[words:])
    _slot(np.repeat(tokens.two.take(coded), sizes), node, bits.two[:words])
    _slot(np.repeat((past ^ (past >> np.uint32(11))) * _B, steps), turn, bits.two[words:])
    np.multiply(node + np.uint32(1), _A, out=bits.own[:words])
    np.multiply(turn + np.repeat((past & np.uint32(0xFFFFFF)) * _C, steps), _A, out=bits.own[words:])
    bits.lane[:words] = np.repeat(tokens.lane.take(coded), sizes)
    bits.lane[words:] = np.repeat(np.repeat(tokens.lane.take(spelled), lengths), steps)
    bits.bit[:words] = tree.symbols.bit.take(path)
    bits.bit[words:] = tree.letters.bit.take(way)
    return bits


# --- counting ----------------------------------------------------------------------------

def _slices(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts of about one length and together at most SLICE characters, or of one longer text."""
    held, size = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if held and size + len(texts[k]) > SLICE:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(texts[k])
    if held:
        yield held


def _rounds(texts: list[str]) -> Iterator[tuple[list[list[bytes]], bool]]:
    """The words of texts, and whether the texts end there: all at once, or one long text piece by piece."""
    if len(texts) > 1:
        yield [words_of(t) for t in texts], True
        return
    held = None
    for piece in word_pieces(texts[0]):
        if held is not None:
            yield [held], False
        held = piece
    yield [held], True


def word_counts(texts: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, n) over the column `text`. Tasks count up to `most` different words before they pass them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in word_pieces(text):
                    seen.update(words)
                    if len(seen) >= most:
                        yield out()
                        seen.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(rare: DataFrame) -> list[int]:
    """How often each byte occurs in the spelled words (word, n); the space after a word counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            data = np.frombuffer(b"".join(words), dtype=np.uint8)
            total += np.bincount(data, weights=np.repeat(times, lengths), minlength=256).astype(np.int64)
            total[SPACE] += times.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["byte", "n"])

    rows = rare.select("word", "n").mapInArrow(count, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    found = {r["byte"]: r["n"] for r in rows}
    return [found.get(k, 0) for k in range(256)]


#: Slots of the counted tables: the byte before, and the two hashed contexts.
TABLES = (1 << 16, 1 << TABLE_BITS, 1 << TABLE_BITS)


def _added(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sums of pairs of counts, each held within 16 bits."""
    low = np.minimum((one & np.uint32(0xFFFF)) + (two & np.uint32(0xFFFF)), np.uint32(0xFFFF))
    high = np.minimum((one >> np.uint32(16)) + (two >> np.uint32(16)), np.uint32(0xFFFF))
    return low | high << np.uint32(16)


def _spellings(tree: Tree) -> np.ndarray:
    """Tables that hold the spelling of each word of the dictionary once: new words are built like known ones."""
    bare = Tree([], np.zeros(0, dtype=np.int64), code([1, 1]), tree.letters)
    tables = [np.zeros(2 * size, dtype=np.int32) for size in TABLES]
    for lo in range(0, len(tree.words), CHUNK):
        words = tree.words[lo:lo + CHUNK]
        tokens = Tokens(bare, [words], np.zeros((1, 2), dtype=np.uint32), False)
        bits = bits_of(bare, tokens, np.arange(len(tokens.lane)))
        own = slice(bits.words, None)
        for table, slot in ((tables[0], bits.zero[own] - len(bare.symbols.prior)), (tables[1], bits.one[own]), (tables[2], bits.two[own])):
            np.add.at(table, 2 * slot + bits.bit[own], np.int32(1))
    counts = np.minimum(np.concatenate(tables), 0xFFFF).astype(np.uint32)
    return counts[0::2] | counts[1::2] << np.uint32(16)


def context_counts(texts: DataFrame, shared: Broadcast) -> np.ndarray:
    """The counted tables, one after the other, as pairs of 16-bit counts of zeros (low) and ones (high).

    Every task counts its texts and passes blocks of slots on; blocks are added up as they arrive.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        tables = [np.zeros(2 * size, dtype=np.int32) for size in TABLES]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for places in _slices(texts):
                before = np.zeros((len(places), 2), dtype=np.uint32)
                for words, ends in _rounds([texts[k] for k in places]):
                    tokens = Tokens(tree, words, before, ends)
                    for lo in range(0, len(tokens.lane), CHUNK):
                        bits = bits_of(tree, tokens, np.arange(lo, min(lo + CHUNK, len(tokens.lane))))
                        for table, slot, bit in ((tables[0], bits.zero[bits.words:] - len(tree.symbols.prior), bits.bit[bits.words:]),
                                                 (tables[1], bits.one, bits.bit), (tables[2], bits.two, bits.bit)):
                            np.add.at(table, 2 * slot + bit, np.int32(1))
        for k, table in enumerate(tables):
            for part, own in enumerate(table.reshape(-1, 2 * PART)):
                if own.any():
                    planes = own.view(np.uint8).reshape(-1, 4).T.tobytes()
                    packed = pa.compress(planes, codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["place", "part", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(2 * PART, dtype=np.int64)

        def out() -> pa.RecordBatch:
            pairs = total.reshape(-1, 2)
            scale = np.maximum(1, -(-pairs.max(axis=1) // 0xFFFF))[:, None]
            small = ((pairs + scale - 1) // scale).astype(np.uint32)  # what was seen stays above zero
            packed = (small[:, 0] | small[:, 1] << np.uint32(16)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed], pa.binary())], names=["place", "part", "packed"])

        for batch in batches:
            for place, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and now != (place, part):
                    yield out()
                    total[:] = 0
                now = (place, part)
                planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * PART, codec="zstd", asbytes=True), dtype=np.uint8)
                total += np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
        if now is not None:
            yield out()

    schema = "place int, part int, packed binary"
    parts = texts.select("text").mapInArrow(count, schema).repartition("place", "part").sortWithinPartitions("place", "part").mapInArrow(add, schema)
    firsts = np.cumsum([0, *TABLES])
    pairs = _spellings(shared.value)
    for r in parts.collect():  # the size of the tables, whatever the number of texts
        at = firsts[r["place"]] + r["part"] * PART
        pairs[at:at + PART] = _added(pairs[at:at + PART], np.frombuffer(r["packed"], dtype=np.uint32))
    return pairs


# --- mixing ------------------------------------------------------------------------------

def packed_cells(pairs: np.ndarray) -> np.ndarray:
    """The odds of pairs of counts in steps of 1/256, and in the last two bits how much was seen."""
    zeros, ones = pairs & np.uint32(0xFFFF), pairs >> np.uint32(16)
    odds = np.rint((_LOG[ones] - _LOG[zeros]) * 256).astype(np.int32) + 4096
    return (odds * 4 + _SEEN[zeros + ones]).astype(np.uint16)


@dataclass
class Model:
    """Tree and tables, and where the weights and the refining map of a text start."""

    tree: Tree
    zero: np.ndarray  # odds by node, then by byte before and node
    one: np.ndarray  # of the hashed contexts: packed cells, or to learn from the pairs of counts
    two: np.ndarray
    weights: np.ndarray  # (gates, inputs)
    odds: np.ndarray  # (kinds, cells, 2): counts of zeros and ones by mixed odds


def model_of(tree: Tree, pairs: np.ndarray, weights: np.ndarray, odds: np.ndarray, learn: bool = False) -> Model:
    spelled, one, two = np.split(pairs, np.cumsum(TABLES[:2]))
    zero = np.concatenate([tree.symbols.prior, _LOG[spelled >> np.uint32(16)] - _LOG[spelled & np.uint32(0xFFFF)]])
    return Model(tree, zero, one if learn else packed_cells(one), two if learn else packed_cells(two), weights, odds)


def start_weights() -> np.ndarray:
    return np.full((GATES, INPUTS), START, dtype=np.float32)


def start_odds() -> np.ndarray:
    """Counts of (zeros, ones) for each kind and cell of the mixed odds, as if those were right."""
    chance = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) / 2))
    return np.tile(np.stack([1 - chance, chance], axis=1) * MAP_WEIGHT, (2, 1, 1))


class Mixer:
    """Scores the bits of some texts block by block and adapts to each. With `learn`, all texts share weights and map,
    and a bit is left out of the counts that predict it."""

    def __init__(self, model: Model, texts: list[str], learn: bool = False):
        self.model, self.learn = model, learn
        lanes = len(texts)
        self.before = np.zeros((lanes, 2), dtype=np.uint32)
        sets = 1 if learn else lanes
        self.weights = np.tile(model.weights.astype(np.float32).T, (1, sets))  # (inputs, sets x gates)
        self.odds = np.tile(model.odds, (sets, 1, 1, 1)).reshape(-1, 2)
        # Every text has its own region for its own counts, by its size alone.
        sizes = np.array([max(6, min(22, len(t).bit_length())) for t in texts], dtype=np.int64)
        self.shift = (32 - sizes).astype(np.uint32)
        self.region, self.slots = np.cumsum(1 << sizes) - (1 << sizes), 1 << sizes
        self.seen = np.zeros(2 * int(self.slots.sum()), dtype=np.uint16)
        self.fresh = np.zeros(lanes, dtype=np.int64)  # bits since the own counts were halved
        self.taught = np.zeros(GATES)
        self.tokens: Tokens | None = None

    def advance(self, words: list[list[bytes]], ends: bool) -> np.ndarray:
        """The natural logarithm of the probability of the next words of each text."""
        self.tokens = tokens = Tokens(self.model.tree, words, self.before, ends)
        block = tokens.place // BLOCK
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(block.max(initial=0) + 2))
        blocks = -(-tokens.sizes // BLOCK)
        total = np.zeros(len(words))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            going = (blocks > k + 1) | (not ends) | self.learn
            # Some texts at a time, so that what is computed for them stays close to the processor.
            lane = tokens.lane[order[lo:hi]]
            first = np.searchsorted(lane, lane[::CHUNK], side="left") + lo
            for a, b in zip(first, [*first[1:], hi]):
                if a < b:
                    total += self._block(tokens, order[a:b], going)
        return total

    def _hashed(self, table: np.ndarray, slot: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odds, and how much was seen in four steps."""
        cell = table.take(slot)
        if self.learn:
            zeros, ones = (cell & np.uint32(0xFFFF)).astype(np.int32), (cell >> np.uint32(16)).astype(np.int32)
            ones -= (bit == 1) & (ones > 0)
            zeros -= (bit == 0) & (zeros > 0)
            cell = packed_cells(zeros.astype(np.uint32) | ones.astype(np.uint32) << np.uint32(16))
        odds = cell.astype(np.float32)
        odds *= np.float32(1 / 1024)
        odds -= np.float32(16)
        cell &= np.uint16(3)
        return odds, cell

    def _block(self, tokens: Tokens, at: np.ndarray, going: np.ndarray) -> np.ndarray:
        model = self.model
        bits = bits_of(model.tree, tokens, at)
        lane, bit, words = bits.lane, bits.bit, bits.words
        one, gate = self._hashed(model.one, bits.one, bit)
        two, seen_two = self._hashed(model.two, bits.two, bit)
        own = bits.own >> self.shift.take(lane)
        own = own + self.region.take(lane)
        counts = self.seen.view(np.uint32).take(own)
        zeros, ones = counts & np.uint32(0xFFFF), counts >> np.uint32(16)
        x = (model.zero.take(bits.zero), one, two, _LOG.take(ones) - _LOG.take(zeros))
        ones += zeros
        gate += seen_two * np.uint16(4)
        gate *= np.uint16(3)
        gate += ones > 0
        gate += ones > 2
        gate[words:] += np.uint16(GATES // 2)
        gate = gate.astype(np.intp)
        if not self.learn:
            gate += lane * GATES
        mixed = self.weights[0].take(gate)
        mixed *= x[0]
        for weights, odds in zip(self.weights[1:], x[1:]):
            part = weights.take(gate)
            part *= odds
            mixed += part
        np.clip(mixed, -_MOST, _MOST, out=mixed)
        # The map: between two cells of the mixed odds, what was seen there.
        spot = np.clip(mixed * 2 + np.float32(CELLS // 2), np.float32(0), np.float32(CELLS - 1.001))
        cell = spot.astype(np.intp)
        spot -= cell
        if not self.learn:
            cell += lane * (2 * CELLS)
        cell[words:] += CELLS
        odds = np.log(self.odds[:, 1] / self.odds[:, 0]).astype(np.float32)
        low = odds.take(cell)
        final = odds.take(cell + 1)
        final -= low
        final *= spot
        final += low
        final += mixed
        # Odds in steps of 1/256 (half the sum of two, so 1/128 of the sum), and the cost of a one there.
        final *= np.where(bit == 1, np.float32(128), np.float32(-128))
        final += np.float32(_HALF + 0.5)
        logs = _RIGHT.take(final.astype(np.intp), mode="clip")
        total = np.bincount(lane, weights=logs, minlength=len(going))
        if going.any():
            self._adapt(bits, x, gate, own, mixed, cell + (spot > 0.5), going)
        return total

    def _adapt(self, bits: Bits, x: tuple, gate: np.ndarray, own: np.ndarray, mixed: np.ndarray, near: np.ndarray, going: np.ndarray) -> None:
        bit, lane = bits.bit, bits.lane
        if not going.all():
            keep = np.flatnonzero(going.take(lane))
            bit, lane, gate, own, mixed, near = (v.take(keep) for v in (bit, lane, gate, own, mixed, near))
            x = tuple(v.take(keep) for v in x)
        own *= 2
        own += bit
        np.add.at(self.seen, own, np.uint16(1))
        self.fresh += np.bincount(lane, minlength=len(self.fresh))
        for k in np.flatnonzero(self.fresh > HALVED).tolist():
            self.seen[2 * self.region[k]:2 * (self.region[k] + self.slots[k])] >>= np.uint16(1)
            self.fresh[k] = 0
        error = bit - _CHANCE.take((mixed * 256 + np.float32(_HALF + 0.5)).astype(np.intp), mode="clip")
        sets = self.weights.shape[1]
        count = np.bincount(gate, minlength=sets)
        rate = (LEARNING if self.learn else RATE) / np.sqrt(np.maximum(count, 1))
        for weights, odds in zip(self.weights, x):
            weights += (np.bincount(gate, weights=error * odds, minlength=sets) * rate).astype(np.float32)
        if self.learn:
            self.taught += count
        self.odds += np.bincount(2 * near + bit, minlength=2 * len(self.odds)).reshape(-1, 2)


@dataclass
class Scored:
    """Of each text: the natural logarithm of its probability, its words, how many are in the dictionary, the sum of the decimal
    logarithms of their counts and one, and the other words with their numbers."""

    score: np.ndarray
    words: np.ndarray
    known: np.ndarray
    logs: np.ndarray
    rare: list[Counter]


def scored(model: Model, texts: list[str]) -> Scored:
    """A text's numbers do not depend on the other texts."""
    n, listed = len(texts), len(model.tree.words)
    out = Scored(np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), [Counter() for _ in texts])
    logs = np.log10(model.tree.counts + 1.0)
    for places in _slices(texts):
        own = [texts[k] for k in places]
        mixer, at = Mixer(model, own), np.array(places)
        for words, ends in _rounds(own):
            out.score[at] += mixer.advance(words, ends)
            tokens = mixer.tokens
            found = np.flatnonzero((tokens.symbol >= 0) & (tokens.symbol < listed))
            lane = tokens.lane[found]
            out.known[at] += np.bincount(lane, minlength=len(own))
            out.logs[at] += np.bincount(lane, weights=logs[tokens.symbol[found]], minlength=len(own))
            out.words[at] += [len(w) for w in words]
            for lane, word in tokens.unlisted():
                out.rare[places[lane]][word] += 1
    return out


def teach(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights after these texts, how many bits taught each gate, and what the map has seen."""
    weights, bits, odds = model.weights, np.zeros(GATES), np.zeros_like(model.odds)
    for places in _slices(texts):
        own = [texts[k] for k in places]
        mixer = Mixer(replace(model, weights=weights), own, learn=True)
        for words, ends in _rounds(own):
            mixer.advance(words, ends)
        weights = mixer.weights.T
        bits += mixer.taught
        odds += mixer.odds.reshape(odds.shape) - model.odds
    return weights, bits, odds


def started(odds: np.ndarray) -> np.ndarray:
    """A map of what was seen, as if each cell had been seen MAP_WEIGHT times."""
    seen = odds + start_odds()
    return seen * (MAP_WEIGHT / seen.sum(axis=2, keepdims=True))


def taught(texts: DataFrame, shared: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map that tasks learn online on their texts, averaged by the bits that taught them."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        bits, odds = np.zeros(GATES), np.zeros_like(model.odds)
        for batch in batches:
            weights, more, seen = teach(model, batch.column(0).to_pylist())
            model, bits, odds = replace(model, weights=weights), bits + more, odds + seen
        cells = [*(model.weights * bits[:, None]).ravel().tolist(), *bits.tolist(), *odds.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells, pa.float64())], names=["cell", "value"])

    sums = texts.select("text").mapInArrow(learn, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    cells = np.zeros(GATES * (INPUTS + 1) + start_odds().size)
    for r in sums:
        cells[r["cell"]] = r["value"]
    weighted, bits, odds = np.split(cells, [GATES * INPUTS, GATES * (INPUTS + 1)])
    weights = np.where(bits[:, None] > 0, weighted.reshape(GATES, INPUTS) / np.maximum(bits, 1)[:, None], start_weights())
    return np.round(weights, 6), started(odds.reshape(start_odds().shape))


# --- the operator ------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 7 == 2, F.lit(False))


def _dictionary(counts: DataFrame, most: int) -> tuple[list[bytes], list[int], int]:
    """The words that occur at least so often that they are `most` at most, and that number (2 at least)."""
    fine = 64
    level = F.floor(F.log2("n") * fine).cast("int")
    held = 0
    least = 1 << 62
    for r in counts.filter("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        if (held := held + r["words"]) > most:
            break
        least = r["n"]
    rows = sorted(((-r["n"], bytes(r["word"])) for r in counts.filter(F.col("n") >= least).collect()))  # `most` words at most
    return [w for _, w in rows], [-n for n, _ in rows], least


SCORED = "key long, doc_id long, n_bytes long, words long, known long, logs double, score double, rare array<binary>, times array<int>"


def _scored(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """A row of SCORED for each text: of the words outside the dictionary, each once with its number."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            found = scored(model, texts)
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            out = list(zip(range(key, key + len(ids)), ids, size, found.words.tolist(), found.known.tolist(), found.logs.tolist(),
                           (found.score / math.log(10)).tolist(), [list(c) for c in found.rare], [list(c.values()) for c in found.rare]))
            key += len(ids)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in SCORED.split(", ")])

    return rows.mapInArrow(score, SCORED)


def scores(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of `docs`.

    Training texts are those that are not held out; counts, weights and map are learnt from them all. Tokens are the words of the text, A to Z in
    lower case, and one end. The base gives a token of count c (c + 1) / (N + V + 1). `score` is the logarithm to the base
    ten of the model's probability of the tokens; `bits_per_byte` is the same in bits, by the bytes of the text (null for an
    empty text). At most `dictionary` words are coded whole, those that occur twice at least; all others are spelled. Null texts
    are empty, null ids are not held out and train; repeated rows stay and count each; a text's score does not depend on the
    other rows but through the training counts. Without training texts the tables are empty. Other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = shaped(docs, doc_id="long", text="string").select("doc_id", text_of().alias("text"))
    training = rows.filter(~held_out(F.col("doc_id")))
    counts = written(word_counts(training), "word-counts")
    ends = training.select("doc_id").count()
    about = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, different = about["n"] + ends, about["v"] + (ends > 0)
    words, times, least = _dictionary(counts, dictionary)
    tree = tree_of(words, times, ends, about["n"] - sum(times), letter_counts(counts.filter(F.col("n") < least)))
    pairs = context_counts(training, spark.sparkContext.broadcast(tree))
    learnt = taught(training, spark.sparkContext.broadcast(model_of(tree, pairs, start_weights(), start_odds(), learn=True)))
    found = cut_lineage(_scored(rows, spark.sparkContext.broadcast(model_of(tree, pairs, *learnt))))
    rare = found.select("key", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("key", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    counted = rare.join(counts.filter(F.col("n") < least), "word").groupBy("key").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    n_tokens = (F.col("words") + 1).alias("n_tokens")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - (F.col("words") + 1) * F.lit(math.log10(tokens + different + 1))
    return found.join(counted, "key", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), n_tokens,
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
