"""Packing of documents into training sequences, balanced by attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.taskcontext import TaskContext

from helixframe.llm.common import by_bytes, shaped, text_of
from helixframe.llm.encoding import encoder

SCHEMA = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Sequence numbers of a task start at its number times this.
PER_TASK = 1 << 36


def capacities(total: int, size: int) -> np.ndarray:
    """Room of the sequences for `total` tokens: full ones, and powers of two for the rest, so that nothing is padded."""
    rest = total % size
    return np.array([size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


def place(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Documents longer than a sequence give up full sequences first. What is left goes in descending order
    (ties in the order given) to the cheapest sequence that has room for it, a piece of n tokens costing
    linear * n + quadratic * n * n. Where none has room, the roomiest takes what it can.
    """
    room = capacities(int(lengths.sum()), size)
    cost, used, next_full = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64), 0
    for doc in np.flatnonzero(lengths >= size):
        for start in range(0, int(lengths[doc]) - size + 1, size):
            yield int(doc), start, size, next_full, 0
            next_full += 1
    first = next_full
    room, cost, used = room[first:], cost[first:], used[first:]
    rest = lengths % size
    for doc in np.argsort(-rest, kind="stable"):
        need, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        while need:
            fits = room >= need
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            part = min(need, int(room[at]))
            yield int(doc), start, part, first + at, int(used[at])
            room[at] -= part
            used[at] += part
            cost[at] += linear * part + quadratic * part * part
            need, start = need - part, start + part


def pack(docs: DataFrame, path: str, ranks: str | None = None, size: int = 1024, end_id: int = 0, linear: float = 1.0,
         quadratic: float = 1.0 / 1024, block_tokens: int = 1_000_000, batch_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, start, length, token_ids, doc_tokens, sequence_id, offset, sequence_tokens): the pieces of all documents.

    A document is its ids by the file at `path`, followed by `end_id`; `ranks` may name the same vocabulary as
    a rank file, which is faster. Every task packs its own rows in blocks of about
    `block_tokens`, so nothing is shuffled and memory is bounded by a block or by one longer document. The
    sequences of a block have `size` tokens, but for a few whose lengths are smaller powers of two; none
    is padded. `token_ids` holds little-endian unsigned 32-bit ids. Null and empty texts are documents of
    one token; repeated rows are packed each; other columns are not read; an empty table gives an empty
    result. Sequence numbers are unique and depend only on how the input is split.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, ranks).encode, np.array([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() * PER_TASK
        ids, held, tokens = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*place(lengths, size, linear, quadratic)))
            total = np.bincount(sequence, weights=length).astype(np.int64)
            out = [
                pa.array([ids[d] for d in doc], pa.int64()), pa.array(start), pa.array(length),
                pa.array([held[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, length)], pa.binary()),
                pa.array(lengths[doc]), pa.array(sequence + first), pa.array(offset), pa.array(total[sequence]),
            ]
            first += len(total)
            return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for part in by_bytes(texts, batch_chars):
                for encoded in encode(part):
                    ids.append(doc_ids[at])
                    held.append(encoded + end)
                    tokens += len(held[-1]) // 4
                    at += 1
                    if tokens >= block_tokens:
                        yield packed()
                        ids, held, tokens = [], [], 0
        if held:
            yield packed()

    return shaped(docs, doc_id="long", text="string").select("doc_id", text_of().alias("text")).mapInArrow(blocks, SCHEMA)
