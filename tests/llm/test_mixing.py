"""Context mixing: a proper distribution, counts by hand, and odd rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import mixing as M


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def sentences():
    draw = np.random.default_rng(1)
    one, two = (["the cat", "sat on", "a mat", "and saw", "the moon"], ["der hund", "lief zum", "see und", "trank das", "wasser"])
    return [" ".join(draw.choice(side, 30)) + f" x{k}y" for k in range(120) for side in ((one, two)[k % 2],)]


def model_of(texts):
    """The model that `scores` fits, by plain Python counts."""
    counts = Counter(w for t in texts for w in words(t))
    listed = sorted((-n, w) for w, n in counts.items() if n > 1)
    rare = {w: n for w, n in counts.items() if n == 1}
    letters = [0] * 256
    for w in rare:
        for b in w + b" ":
            letters[b] += 1
    tree = M.tree_of([w for _, w in listed], [-n for n, _ in listed], len(texts), len(rare), letters)
    return tree, np.zeros(sum(M.TABLES), dtype=np.uint32)


def test_code_is_a_prefix_code_of_least_length():
    code = M.code([5, 1, 1, 3, 10])
    paths = [tuple(zip(code.node[a:b].tolist(), code.bit[a:b].tolist())) for a, b in zip(code.start, code.start[1:])]
    assert sum(2.0 ** -len(p) for p in paths) == 1
    assert sum(n * len(p) for n, p in zip([5, 1, 1, 3, 10], paths)) == 2 + 5 + 10 + 20  # inner nodes of 2, 5, 10 and 20
    assert all(set(a) != set(b) for a, b in itertools.combinations(paths, 2))


def test_chances_of_all_next_symbols_add_up():
    """After any beginning, the end, a listed word and the escape with all first bytes share one."""
    tree, pairs = model_of(["a b a b c", "a c"])
    pairs[:] = np.random.default_rng(2).integers(0, 9, len(pairs)).astype(np.uint32) * np.uint32(65537)
    model = M.model_of(tree, pairs, M.start_weights(), M.start_odds())
    begin = ["a", "b", "zz", "a"]

    def logs(parts, ends):
        mixer = M.Mixer(model, ["x" * 40])
        return mixer.advance([[p.encode() for p in parts]], ends)[0]

    # The chance of a longer run of words is that of the shorter times what follows.
    head = logs(begin, False)
    total = math.exp(logs(begin, True) - head) + sum(math.exp(logs([*begin, w.decode()], False) - head) for w in tree.words)
    spelled = 0.0
    code = tree.letters
    assert sum(2.0 ** -(b - a) for a, b in zip(code.start, code.start[1:])) == pytest.approx(1)
    for k in range(256):  # one-byte words that are not listed; longer ones share the rest
        word = bytes([k])
        if word.strip() and word not in tree.index:
            mixer = M.Mixer(model, ["x" * 40])
            spelled += math.exp(mixer.advance([[p.encode() for p in begin] + [word]], False)[0] - head)
    assert total < 1 and total + spelled < 1 + 1e-6


def test_text_scores_do_not_depend_on_neighbours(sentences):
    tree, pairs = model_of(sentences)
    model = M.model_of(tree, pairs, M.start_weights(), M.start_odds())
    texts = [*sentences[:40], "", "y" * 1000, "the cat " * 3000, " \t\n", "é 日本 😀 \x00\x01"]
    together = M.scored(model, texts)
    for k in (0, 17, 40, 41, 42, 43, 44):
        alone = M.scored(model, [texts[k]])
        assert alone.score[0] == together.score[k] and alone.words[0] == together.words[k] == len(words(texts[k]))
        assert alone.rare[0] == together.rare[k] == Counter(w for w in words(texts[k]) if w not in tree.index)


def test_long_texts_come_in_pieces(monkeypatch, sentences):
    monkeypatch.setattr(M, "PIECE", 100)
    text = " ".join(sentences[:20]) + " " + "q" * 500 + "  end"
    assert [w for part in M.word_pieces(text) for w in part] == words(text) and len(list(M.word_pieces(text))) > 5
    tree, pairs = model_of(sentences)
    model = M.model_of(tree, pairs, M.start_weights(), M.start_odds())
    found = M.scored(model, [text])
    assert found.words[0] == len(words(text)) and found.rare[0][b"q" * 500] == 1
    assert found.known[0] == sum(w in tree.index for w in words(text))


def test_texts_adapt(sentences):
    tree, pairs = model_of(sentences)
    model = M.model_of(tree, pairs, M.start_weights(), M.start_odds())
    once, often = "qwxv zzkj " * 64, "qwxv zzkj " * 640
    a, b = M.scored(model, [once, often]).score
    assert b / 640 > 0.5 * a / 64  # bits a word fall as the text goes on


def brute(rows):
    """Everything but the model's own score, by plain counts."""
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    end = len(train)
    out = []
    for i, t in rows:
        own = words(t)
        logs = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((end + 1) / (n + v + 1))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(own) + 1, sum(c[w] > 0 for w in own) + bool(train), n, logs))
    return out


def check(llm, rows, **more):
    docs = llm.createDataFrame([(i, t, 0.5, 3, "x") for i, t in rows], "doc_id long, text string, score double, words int, rare string")
    found = M.scores(docs.repartition(3), **more).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=str)
    want = sorted(brute(rows), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    return found


@pytest.mark.parametrize("dictionary", [M.DICTIONARY, 10])
def test_counts_and_base_score_equal_brute_force(llm, sentences, dictionary):
    found = check(llm, list(enumerate(sentences)), dictionary=dictionary)
    if dictionary > 10:
        held = [r for r in found if r.held_out]
        assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # two languages: the text tells which


def test_odd_rows(llm):
    rows = [(1, "the cat sat"), (2, None), (3, ""), (None, "no id"), (None, None), (5, "same same"), (5, "same same"), (6, "\x01 \x00 é 日本 😀"),
            (7, "word and more " * 4000), (8, "x" * 50_000), (9, "A B a b"), (10, " \t\n\r\x0b\x0c")]
    found = check(llm, rows)
    empty = [r for r in found if r.n_tokens == 1]
    assert len({r.score for r in empty}) == 1 and all((r.bits_per_byte is None) for r in empty if r.doc_id != 10)


def test_without_training_texts(llm):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    found = check(llm, [(i, "some words") for i in held])
    assert {r.base_score for r in found} == {0.0} and {r.train_tokens for r in found} == {0}


def test_empty_table(llm):
    docs = llm.createDataFrame([], "doc_id long, text string")
    assert M.scores(docs).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    assert M.scores(docs).count() == 0


def test_every_training_text_teaches_the_weights(llm, sentences, monkeypatch):
    seen, plain = [], M.taught
    monkeypatch.setattr(M, "taught", lambda texts, shared: seen.append(texts.count()) or plain(texts, shared))
    rows = M.scores(llm.createDataFrame(list(enumerate(sentences)), "doc_id long, text string")).collect()
    assert seen == [sum(not r.held_out for r in rows)] and 0 < seen[0] < len(sentences)
