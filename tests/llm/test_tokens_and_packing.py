import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm import packing, tokens
from helixframe.llm.encoding import UnitEncoder

from .conftest import ODD

FILE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "a  b\n\n c <|endoftext|> d<|endoftext|>e", " x  y  z \t\n q's 12 3,4", "日本 語 テ\n", "\x85 a\xa0 b", "é è  ", "x " * 50, "don't  I'll",
         "   a", "\n \n", "a　 b", "Ünïcode — dash… €5 ½ ²"]


def test_every_token_encodes_to_itself():
    # With this, the rank file and the tokenizer file give the same ids; see encoding.py.
    tokenizer = Tokenizer.from_file(FILE)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    wrong = [t for t, i in vocabulary.items() if i < 50256 and [x.id for x in tokenizer.model.tokenize(t)] != [i]]
    assert wrong == []
    with open(FILE, encoding="utf-8") as file:
        assert json.load(file)["pre_tokenizer"]["type"] == "ByteLevel"


def test_units_give_the_ids_of_whole_texts():
    whole = Tokenizer.from_file(FILE)
    for encoder in (UnitEncoder(FILE), UnitEncoder(FILE, RANKS), UnitEncoder(FILE, RANKS, remembered=3, piece=7)):
        for text in [*TEXTS, *(t for _, t in ODD if t)]:
            ids = whole.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids
            assert encoder.count([text, text]) == [len(ids)] * 2


def test_counts(llm, odd, none):
    whole = Tokenizer.from_file(FILE)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(odd, FILE).collect())
    want = []
    for i, t in ODD:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i or -1, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert tokens.token_counts(none, FILE).count() == 0


def test_counts_of_other_files(llm):
    import sentencepiece

    docs = llm.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, model).collect()} == {k: len(pieces.encode(t)) for k, t in enumerate(TEXTS)}
    words = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(words)
    want = {k: len(whole.encode(t, add_special_tokens=False).ids) for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, words).collect()} == want


def test_packing(llm, odd, none):
    whole = Tokenizer.from_file(FILE)
    for block in (1_000_000, 300):
        rows = packing.pack(odd.coalesce(2), FILE, RANKS, block_tokens=block).collect()
        pieces = defaultdict(list)
        for r in rows:
            assert len(r.token_ids) == 4 * r.length and r.length > 0
            pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.token_ids)))
        for i, t in ODD:
            ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
            parts = sorted(pieces[i, len(ids)])
            copies = sum((j, u) == (i, t) for j, u in ODD)
            assert sum(len(p) for _, p in parts) == 4 * len(ids) * copies
            if copies == 1 and sum(j == i and len(whole.encode(u or "", add_special_tokens=False).ids) + 1 == len(ids) for j, u in ODD) == 1:
                assert b"".join(p for _, p in parts) == np.array(ids, "<u4").tobytes()
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
        for own in sequences.values():
            at = 0
            for offset, length, total in sorted(own):
                assert offset == at
                at += length
            assert at == own[0][2] and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(none, FILE).count() == 0


def test_cost_balance():
    lengths = np.array([512, 512, 256, 256, 256, 256, 128])
    pieces = list(packing.place(lengths, 1024, 1.0, 1 / 1024))
    assert sum(p[2] for p in pieces) == lengths.sum()
    first = {p[0]: p[3] for p in pieces if p[0] < 2}
    assert first[0] != first[1]  # the second longest goes to the cheapest sequence, not beside the longest
    assert list(packing.place(np.array([2500]), 1024, 1.0, 0.0))[:2] == [(0, 0, 1024, 0, 0), (0, 1024, 1024, 1, 0)]


def test_checksum_matches_little_endian_ids(llm):
    docs = llm.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = packing.pack(docs, FILE).select(F.crc32("token_ids").alias("c")).first()
    ids = Tokenizer.from_file(FILE).encode("hello world", add_special_tokens=False).ids + [0]
    data = np.array(ids, "<u4").tobytes()
    # three ids: one sequence of two and one of one
    assert row.c in {zlib.crc32(data[:8]), zlib.crc32(data[8:])}
