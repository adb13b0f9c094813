"""Edited texts where one id, or none, holds most rows."""

import hashlib

from pyspark.sql import functions as F

from helixframe.llm import edits


def test_rows_of_one_id_are_dealt_over_parts(llm):
    rows = [(None, f"text {k} " + "abc def " * (k % 7)) for k in range(150)] + [(5, f"five {k}") for k in range(80)] + [(9, "last of the ids"), (5, "five 3")]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    ordered = docs.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()
    want = []
    for r, following in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(r.text)
        text = r.text[:n - n // 2] + following.text[:n // 2]
        want.append((r.doc_id or -1, n, hashlib.sha256(text.encode()).hexdigest()))
    got = edits.with_edits(docs, rows_per_part=20)
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got.collect()) == sorted(want)
    placed = docs.repartitionByRange(11, F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    assert max(r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()) < 60
