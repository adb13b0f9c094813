import pytest

from helixframe.llm.common import prepare

#: Odd rows that every operator on documents must take: nulls, empty and blank texts, repeated rows, marks, a long text.
ODD = [
    (1, "the cat sat on the mat and looked at the moon"), (2, None), (3, ""), (4, " \t\n "), (None, "an id is missing here"), (None, None),
    (5, "same same same"), (5, "same same same"), (5, "another text with the same id"), (6, "control \x01 and \x00 marks   é 日本 😀"),
    (7, "word and more " * 4000), (8, "x" * 50_000), (9, "<|endoftext|> in a text"),
]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Documents with odd rows, and extra columns whose names clash with those of results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, root long, spans string, sequence_id int, row int"
    return llm.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 0.5, 1, 2, "x", 3, 4) for i, t in ODD], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
