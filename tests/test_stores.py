"""Deletion inside a store, and capturing pages of a stream without a horizon."""

import json
from datetime import datetime
from pathlib import Path

import pytest

from helixframe.sources import sinks
from helixframe.streaming import incremental

ROWS = [("chr1", 1, "A"), ("chr1", 2, "B"), ("chr2", 3, "A"), ("chr3", 4, "B"), ("chr 4=x", 5, "A"), ("chr 4=x", 6, "A"), (None, 7, "A"), (None, 8, "B"), ("chr5", 9, None)]


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.write_per_key(spark.createDataFrame(ROWS, "chrom string, id int, gene string"), path, "chrom")
    return path


def _files(path, folder):
    return sorted(str(p) for p in Path(path).glob(f"{folder}/*.parquet"))


def _left(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_only_hit_partitions_are_written_anew(spark, store):
    before = {c: _files(store, f"chrom={c}") for c in ("chr1", "chr3", "chr5")}
    assert sinks.delete_stored(spark, store, {"gene": "A"}) == 5
    assert _left(spark, store) == [2, 4, 8, 9]
    assert _files(store, "chrom=chr3") == before["chr3"] and _files(store, "chrom=chr5") == before["chr5"]
    assert _files(store, "chrom=chr1") != before["chr1"]
    assert not list(Path(store).glob("chrom=chr2")) and not list(Path(store).glob("_deletion"))
    assert sinks.delete_stored(spark, store, {"gene": "A"}) == 0
    assert sinks.delete_stored(spark, store, {"gene": None}) == 1 and _left(spark, store) == [2, 4, 8]
    with pytest.raises(ValueError):
        sinks.delete_stored(spark, store, {})


def test_a_failed_deletion_is_ended(spark, store):
    assert sinks.finish_deletion(spark, store) == 0
    spark.createDataFrame([(json.dumps([{"chrom": "chr1", "gene": "B"}, "chrom"]),)], "value string").write.text(f"{store}/_deletion")
    assert sinks.finish_deletion(spark, store) == 1
    assert 2 not in _left(spark, store) and not list(Path(store).glob("_deletion"))


def test_captured_keys_are_skipped_for_ever(spark, tmp_path):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")
    schema = "page_id int, url string, seen_at timestamp"

    def run(rows, state):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(pages)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(pages)
        incremental.capture_new_pages(stream, out, str(tmp_path / state), "seen_at").awaitTermination()
        return sorted((r.page_id, r.url_key) for r in spark.read.parquet(out).collect())

    day = lambda y: datetime(y, 1, 1)
    first = [(2, "a?x=2", day(2020)), (1, "a?x=1", day(2020)), (3, "a", day(2021)), (4, "b", None), (5, "b?y", day(2022)), (6, None, day(2020))]
    assert run(first, "one") == [(1, "a"), (5, "b")]
    later = [(7, "a?z", day(2040)), (8, "c", day(1990)), (9, "b", day(2040))]
    assert run(later, "one") == [(1, "a"), (5, "b"), (8, "c")]
    assert run([(10, "c?again", day(2050)), (11, "d", day(2050))], "two") == [(1, "a"), (5, "b"), (8, "c"), (11, "d")]
