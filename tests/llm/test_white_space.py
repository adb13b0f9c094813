"""Copies of benchmark passages with other white space."""

import random

from helixframe.llm import decontamination


def test_any_white_space_parts_words(llm):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(30)]
    gaps = [" ", "\t", "\r\n", "\u00a0", "\u3000", "\u2003", "\v", "  \n "]
    items = llm.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = [(k, gap.join(words)) for k, gap in enumerate(gaps)] + [(90, "_".join(words)), (91, "\u3000\t\r\n")]
    got = decontamination.matches(llm.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.matched, r.changed) for r in got} == {(k, 23, 0) for k in range(len(gaps))}


def test_sentences_begin_alike(llm):
    """Names are told from words that begin a sentence or a line, whatever white space stands before them."""
    kinds = []
    for gap in (" ", "\t", "\u00a0"):
        text = gap.join("The boy met Anna there. Then Bob came".split()) + "\r\n" + gap.join("Next Carl ran 5 km".split())
        kinds.append(decontamination.template(text, decontamination.Vocabulary())[1].tolist())
    assert kinds[0] == kinds[1] == kinds[2]
    lit, name = decontamination.LITERAL, decontamination.NAME
    assert kinds[0] == [lit, lit, lit, name, lit, lit, name, lit, lit, name, lit, decontamination.NUMBER, decontamination.UNIT]
