"""Block-compressed text (BGZF): one large file is read by many tasks.

Such a file is a chain of gzip members of at most 64 KiB, each of which names its own length. A task takes the blocks that
begin in its range of bytes, finds the first by its header, and owns the lines (or FASTQ records) that begin after its
first byte, up to and with the one that begins at the first byte of the next range.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: the header up to the length, and the empty block at the end of a file.
HEADER = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END = HEADER + b"\x1b\x00\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_MAGIC, _FIELD = HEADER[:4], HEADER[10:16]
LARGEST, PAYLOAD = 1 << 16, 0xFF00
SCHEMAS = {"lines": "path string, value string", "fastq": "path string, header string, sequence string, plus string, quality string"}
WIDTHS = {"lines": 1, "fastq": 4}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def compress_block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return HEADER + struct.pack("<H", len(HEADER) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _length(data: bytes, at: int) -> int:
    """Length of the block that begins at `at`, or 0 if none does."""
    if data[at:at + 4] != _MAGIC or data[at + 10:at + 16] != _FIELD or len(data) < at + 18:
        return 0
    return struct.unpack_from("<H", data, at + 16)[0] + 1


def first_block(file, at: int, size: int) -> int:
    """Offset of the first block at or after `at`: a header at which a whole block unpacks with its checksum."""
    while at < size:
        data = file.read_at(min(3 * LARGEST, size - at), at)
        found = data.find(_MAGIC)
        while 0 <= found < LARGEST:
            length = _length(data, found)
            if length and found + length <= len(data):
                try:
                    _unpack(data[found:found + length])
                    return at + found
                except (zlib.error, ValueError):
                    pass
            found = data.find(_MAGIC, found + 1)
        at += LARGEST
    return size


def _unpack(block: bytes) -> bytes:
    out = zlib.decompress(block[18:-8], -15)
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(out), len(out)):
        raise ValueError("a block does not have its checksum")
    return out


def _blocks(file, at: int, size: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of each block from `at` on."""
    data, base = b"", at
    while at < size:
        if at + LARGEST > base + len(data) and base + len(data) < size:
            data, base = file.read_at(min(max(chunk, LARGEST), size - at), at), at
        length = _length(data, at - base)
        if not length or at - base + length > len(data):
            raise ValueError(f"no whole block at byte {at}")
        yield at, _unpack(data[at - base:at - base + length])
        at += length


def lines_from(file, start: int, end: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """(line, owned) of the lines that begin after the first byte of the range, or at the start of the file; lines of the
    next range follow, which are not owned, until the caller stops."""
    at = first_block(file, start, size)
    if start == 0 and at and size:
        raise ValueError("not a block-compressed file")
    if at >= end:
        return
    limit, skip = first_block(file, end, size), at > 0
    seen, begin, last = 0, 0, None  # unpacked bytes so far, where the line begins, and where the next range does
    pieces: list[bytes] = []
    for here, data in _blocks(file, at, size):
        if last is None and here >= limit:
            last = seen
        *whole, tail = data.split(b"\n")
        place = seen
        for part in whole:
            line, pieces = b"".join([*pieces, part]), []
            if not skip:
                yield line, last is None or begin <= last
            skip = False
            place += len(part) + 1
            begin = place
        pieces.append(tail)
        seen += len(data)
    line = b"".join(pieces)
    if line and not skip:
        yield line, last is None or begin <= last


@dataclass
class BlockRange(InputPartition):
    path: str
    start: int
    end: int
    size: int

    def __post_init__(self):
        super().__init__(None)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, form: str, split: int):
        self.path, self.form, self.split = path, form, split

    def partitions(self) -> list[BlockRange]:
        fs, path = file_system(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path))
        prefix = self.path if info.is_file else None
        out = []
        for f in files:
            if f.is_file and not f.base_name.startswith(("_", ".")):
                name = prefix or f"{self.path.rstrip('/')}/{f.base_name}"
                out += [BlockRange(name, a, min(a + self.split, f.size), f.size) for a in range(0, f.size, self.split)]
        return out

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        width = WIDTHS[self.form]
        fs, path = file_system(partition.path)
        names = [c.split()[0] for c in SCHEMAS[self.form].split(", ")]

        def batch(rows: list[list[bytes]]) -> pa.RecordBatch:
            columns = [pa.array([r[k].removesuffix(b"\r").decode("utf-8", "replace") for r in rows], pa.string()) for k in range(width)]
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), *columns], names=names)

        with fs.open_input_file(path) as file:
            rows: list[list[bytes]] = []
            for record in self._records(lines_from(file, partition.start, partition.end, partition.size), width, partition.start > 0):
                rows.append(record)
                if len(rows) == 4096:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    @staticmethod
    def _records(lines: Iterator[tuple[bytes, bool]], width: int, inside: bool) -> Iterator[list[bytes]]:
        """Records of `width` lines whose first line is owned. Inside a file of FASTQ records, one begins where a line opens
        with @ and the second after it with +: after a quality that opens with @ that line is a sequence."""
        window: list[tuple[bytes, bool]] = []
        aligned = width == 1 or not inside
        for line in lines:
            window.append(line)
            if not window[0][1]:
                return
            if not aligned:
                if len(window) < 3:
                    continue
                if window[0][0][:1] != b"@" or window[2][0][:1] != b"+":
                    del window[0]
                    continue
                aligned = True
            if len(window) == width:
                yield [text for text, _ in window]
                window = []


@dataclass
class Written(WriterCommitMessage):
    name: str


class BlockWriter(DataSourceArrowWriter):
    """Each task writes one file of its own name under `_temporary`; the commit moves those that count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.gz"
        fs.create_dir(f"{path}/_temporary")
        with fs.open_output_stream(f"{path}/_temporary/{name}", compression=None) as out:
            waiting = bytearray()
            for batch in iterator:
                for value in batch.column("value").to_pylist():
                    waiting += (value or "").encode() + b"\n"
                    while len(waiting) >= PAYLOAD:
                        out.write(compress_block(bytes(waiting[:PAYLOAD])))
                        del waiting[:PAYLOAD]
            if waiting:
                out.write(compress_block(bytes(waiting)))
            out.write(END)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path)
        for m in messages:
            if m is not None:
                fs.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{path}/_temporary/{m.name}")


class BlockText(DataSource):
    """Options: path, form (lines or fastq), split (bytes of a file a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "block_text"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("form", "lines")]

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], self.options.get("form", "lines"), int(self.options.get("split", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"])


def read_blocks(spark: SparkSession, path: str, form: str = "lines", split: int = 128 << 20) -> DataFrame:
    """Lines (path, value) or FASTQ records of a BGZF file or a folder of such files, by tasks of `split` compressed bytes.

    Paths are those that pyarrow opens (local and shared folders, hdfs, s3, gs). An unfinished record at the end of a file is left out,
    as is a last line without any byte; a carriage return at the end of a line is cut. A file that is not block-compressed is an error.
    """
    if split < 1:
        raise ValueError("split is a number of bytes")
    spark.dataSource.register(BlockText)
    return spark.read.format("block_text").option("form", form).option("split", str(split)).load(path)


def write_blocks(lines: DataFrame, path: str) -> None:
    """The column `value` as BGZF files, one a task, lines in the order of the rows of a task."""
    spark = lines.sparkSession
    spark.dataSource.register(BlockText)
    lines.select("value").write.format("block_text").mode("append").save(path)
