"""Surrogates end and stay distinct where a form has no or few values."""

import string

import pytest
from pyspark.sql import functions as F

from helixframe.llm import surrogates


def given(llm, kind, values):
    df = llm.createDataFrame([(kind, v) for v in values], "kind string, canon string")
    return {r.canon: r.surrogate for r in surrogates.assigned(df, "key").collect()}


@pytest.mark.parametrize("values", [["___@--.com"], ["___@--.com", "__@--.com", "a@b.de"], [f"{a}@d.co" for a in string.ascii_lowercase + string.digits]])
def test_addresses_without_room(llm, values):
    out = given(llm, "email", values)
    assert set(out) == set(values) and len(set(out.values())) == len(values) and not set(out.values()) & set(values)
    assert all("@" in v and v.rsplit(".", 1)[1] == k.rsplit(".", 1)[1] for k, v in out.items())


def test_a_text_with_such_an_address_ends(llm):
    docs = llm.createDataFrame([(1, "write to ___@--.com now"), (2, "or to ___@--.com, then")], "doc_id long, text string")
    rows = {r.doc_id: r for r in surrogates.pseudonymised(docs, "key").collect()}
    column = next(c for c in ("text", "pseudonymised", "masked") if c in rows[1].asDict())
    assert "___@--.com" not in rows[1][column].split() and rows[1][column].startswith("write to ")


def test_a_full_space_of_digits_grows(llm):
    values = [str(k) for k in range(10)]
    out = given(llm, "phone", values)
    assert len(set(out.values())) == 10 and not set(out.values()) & set(values) and all(v.isdigit() for v in out.values())


def test_longer_digits_are_written_whole(llm):
    row = llm.range(1).select(surrogates._worn(F.lit("12-34"), F.lit("phone"), F.lit("567890")).alias("w"), surrogates._worn(F.lit("12-34"), F.lit("phone"), F.lit("5678")).alias("v")).first()
    assert (row.w, row.v) == ("56-7890", "56-78")
