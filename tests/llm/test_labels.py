import random

import numpy as np

from helixframe.llm import toxicity
from tests.llm.test_filters import _labelled


def test_labels_of_long_texts_and_of_all_parts_teach(llm):
    """A word that only long labelled texts hold is learnt, in one part as in several."""
    docs, labels = _labelled(llm, 600)
    draw, filler = random.Random(8), sorted({w for _, t in docs[1:200:5] for w in t.split()})  # words of clean texts
    kinds = {i: y for i, _, y in labels}
    docs = [(i, t + (" blorptang " if kinds[i] else " ") + " ".join(draw.choices(filler, k=4500)) if i % 15 == 0 or i % 5 == 1 else t) for i, t in docs]
    assert sum(len(t) > 20_000 for _, t in docs) > 150
    fresh = [" ".join([*draw.choices(filler, k=20), *["blorptang"] * (k % 2)]) for k in range(40)]
    frame, marks = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bounds in ({}, {"part_rows": 150}):
        model = toxicity.fit(frame, marks, **bounds)
        value, _ = toxicity.logits(toxicity.Lexicon(model), fresh)
        assert np.median(value[1::2]) > value[::2].max() + 1


def test_only_labelled_texts_are_written_and_packed(llm, monkeypatch):
    docs, labels = _labelled(llm, 400)
    docs = [(k, f"{t} straße \ud7ff\U0001f600 " * 40) for k, t in docs]
    frame, marks = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels[::10], "doc_id long, quality int, toxic int")
    kept, write = [], toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, label: kept.append(write(df, label)) or kept[-1])
    toxicity.fit(frame, marks)
    own = {k for k, _, _ in labels[::10]} & {r.doc_id for r in frame.filter(~toxicity.held_out(frame["doc_id"])).collect()}
    texts = dict(docs)
    rows = kept[0].collect()
    assert {r.doc_id: toxicity.unpacked(r.packed) for r in rows} == {k: texts[k] for k in own}
    assert sum(len(r.packed) for r in rows) < 0.5 * sum(len(texts[k].encode()) for k in own)
    passed = {r.doc_id for r in toxicity.listed(frame, marks.select("doc_id")).collect()}
    assert {k for k, _, _ in labels[::10]} <= passed and len(passed) < 50
    assert {r.doc_id for r in toxicity.listed(frame, marks.select("doc_id"), bits=1).collect()} == set(texts)  # all may pass, none is lost


def test_stretches_find_the_same_places():
    draw = np.random.default_rng(3)
    products, flat = [draw.normal(size=(50, 4)).astype(np.float32) for _ in range(3)], draw.integers(0, 50, 1000)
    starts, ends = [0, 30, 700], [30, 700, 1000]
    for whole, cut in zip(toxicity._best_places(products, flat, starts, ends), toxicity._best_places(products, flat, starts, ends, stretch=64)):
        assert (whole == cut).all()


def test_thresholds_count_every_text(llm):
    docs, labels = _labelled(llm, 300)
    kinds = np.array([y for _, _, y in labels])
    model = toxicity.train([t for _, t in docs], kinds.tolist(), steps=30)
    value, _ = toxicity.logits(toxicity.Lexicon(model), [t for _, t in docs])
    toxicity.calibrate(model, llm.createDataFrame([(t, int(y)) for (_, t), y in zip(docs, kinds)], "text string, toxic int"), least=1000)
    f1 = lambda marked: 2 * (marked & (kinds == 1)).sum() / (marked.sum() + kinds.sum())
    best = max(f1(value >= v) for v in value)
    assert f1(value >= model.thresholds[-1]) >= best - 0.01
