"""Block-compressed files at every split size against a plain read."""

import gzip
import random

import pyarrow.fs as pafs
import pytest

from helixframe.sources import blocks


def _file(path, data, sizes):
    draw, at = random.Random(3), 0
    with open(path, "wb") as out:
        while at < len(data):
            size = draw.choice(sizes)
            out.write(blocks.compress_block(data[at:at + size]))
            at += size
        out.write(blocks.END)
    return path


def _read(path, form, split):
    reader = blocks.BlockReader(str(path), form, split)
    return [tuple(row.values())[1:] for p in reader.partitions() for b in reader.read(p) for row in b.to_pylist()]


def _fastq(n):
    draw = random.Random(1)
    out = []
    for k in range(n):
        length = draw.choice([0, 1, 5, 300])
        out.append((f"@r{k}", "".join(draw.choices("ACGT", k=length)), draw.choice(["+", f"+r{k}"]), "".join(draw.choices("@+I#", k=length))))
    return out


@pytest.mark.parametrize("sizes", [[1, 2, 7], [40, 400], [5000]])
def test_every_split_gives_the_records_once(tmp_path, sizes):
    records = _fastq(60)
    text = "".join("\n".join(r) + "\n" for r in records).encode()
    path = _file(tmp_path / "reads.gz", text, sizes)
    assert gzip.open(path).read() == text
    size = path.stat().st_size
    for split in [1 + size // k for k in (1, 2, 3, 5, 11, 40)] + [size, size * 2]:
        assert _read(path, "fastq", split) == records
        assert _read(path, "lines", split) == [(x,) for x in text.decode().split("\n")[:-1]]


def test_line_ends_at_block_ends(tmp_path):
    """Blocks that end with a line, empty blocks inside the file, no line end at the end, carriage returns."""
    path = tmp_path / "x.gz"
    rows = [b"one\n", b"", b"two\r\n", b"", b"", b"three\nfour", b"\n", b"\n", b"last"]
    path.write_bytes(b"".join(map(blocks.compress_block, rows)) + blocks.END)
    want = [(x,) for x in ("one", "two", "three", "four", "", "last")]
    for split in range(1, path.stat().st_size + 1):
        assert _read(path, "lines", split) == want


def test_a_header_inside_a_block_is_no_block(tmp_path):
    """Text that holds block headers is stored as it is if it does not shrink."""
    draw = random.Random(2)
    noise = bytes(draw.choices([b for b in range(256) if b != 10], k=3000))
    text = b"\n".join([noise + blocks.HEADER + b"\x20\x00" + noise[:50]] * 3)
    path = _file(tmp_path / "n.gz", text, [900])
    size, file = path.stat().st_size, pafs.LocalFileSystem().open_input_file(str(path))
    starts = {at for at, _ in blocks._blocks(file, 0, size)}
    assert {blocks.first_block(file, at, size) for at in range(0, size, 13)} <= starts | {size}


def test_not_block_compressed(tmp_path):
    path = tmp_path / "plain.gz"
    path.write_bytes(gzip.compress(b"a\nb\n"))
    with pytest.raises(ValueError):
        _read(path, "lines", 10)


def test_written_files_are_read_by_many_tasks(spark, tmp_path):
    lines = spark.range(50_000).selectExpr("concat('line ', id, ' ', sha2(string(id), 256)) AS value").repartition(2).cache()
    path = str(tmp_path / "out")
    blocks.write_blocks(lines, path)
    back = blocks.read_blocks(spark, path, split=100_000)
    assert back.rdd.getNumPartitions() > 10
    assert back.select("value").exceptAll(lines).isEmpty() and back.count() == 50_000
    empty = str(tmp_path / "empty")
    blocks.write_blocks(lines.limit(0), empty)
    assert blocks.read_blocks(spark, empty).count() == 0
    with pytest.raises(ValueError):
        blocks.read_blocks(spark, path, split=0)
