"""Packed two-bit sequence files as a Spark data source, read by byte ranges.

A file has a header, an index of names and offsets, and one record a sequence: its length, the runs of
unknown letters, the runs of lower-case letters, and four letters a byte. Partitions are planned from the
index alone; a task reads the head of its record and the bytes of its letters, never a whole file.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import shipped
from .files import opened

# Fixed values of the format: its mark, and the letters of the codes 0 to 3.
SIGNATURE = 0x1A412743
LETTERS = b"TCAG"

TILE = 65_536  # letters a row
LETTERS_PER_TASK = 1 << 25
LETTERS_PER_BATCH = 1 << 22
BYTES_PER_FILE = 1 << 26
LIST = "_files.json"
SCHEMA = "chrom string, size bigint, tile bigint, start bigint, part string"

_CODE = np.zeros(256, np.uint8)
_KNOWN = np.zeros(256, bool)
for _i, _c in enumerate(LETTERS):
    _CODE[[_c, _c + 32]] = _i
    _KNOWN[[_c, _c + 32]] = True


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n letters lie in the runs [start, end)."""
    step = np.bincount(np.maximum(starts, 0), minlength=n + 1) - np.bincount(np.minimum(ends, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def packed(seq: str) -> bytes:
    """One record. Letters other than A, C, G and T, in either case, become unknown."""
    raw = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    code = _CODE[raw]
    code = np.concatenate((code, np.zeros(-len(code) % 4, np.uint8))).reshape(-1, 4)
    out = [struct.pack("<I", len(raw))]
    for starts, sizes in (_spans(~_KNOWN[raw]), _spans((raw >= 97) & (raw <= 122))):
        out += [struct.pack("<I", len(starts)), starts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()]
    out += [struct.pack("<I", 0), (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8).tobytes()]
    return b"".join(out)


def file_bytes(names: Sequence[str], records: Sequence[bytes]) -> Iterator[bytes]:
    """A whole file in pieces. Offsets have 64 bits (version 1) where 32 do not reach."""
    keys = [n.encode() for n in names]
    if any(len(k) > 255 for k in keys):
        raise ValueError("a sequence name has more than 255 bytes")
    wide = 16 + sum(len(k) + 5 for k in keys) + sum(map(len, records)) >= 1 << 32
    at = 16 + sum(len(k) + (9 if wide else 5) for k in keys)
    yield struct.pack("<IIII", SIGNATURE, int(wide), len(keys), 0)
    for k, r in zip(keys, records):
        yield bytes([len(k)]) + k + struct.pack("<Q" if wide else "<I", at)
        at += len(r)
    yield from records


def index(f: pa.NativeFile) -> tuple[str, list[tuple[str, int]]]:
    """Byte order and (name, offset) of every sequence."""
    head = f.read(16)
    order = next((o for o in "<>" if len(head) == 16 and struct.unpack(o + "I", head[:4])[0] == SIGNATURE), None)
    if order is None:
        raise ValueError("not a two-bit file")
    version, count, _ = struct.unpack(order + "III", head[4:])
    if version > 1:
        raise ValueError(f"two-bit version {version} is unknown")
    form, width = (order + "Q", 8) if version else (order + "I", 4)
    out = []
    for _ in range(count):
        name = f.read(f.read(1)[0]).decode()
        out.append((name, struct.unpack(form, f.read(width))[0]))
    return order, out


class Record:
    """The head of one record: length and runs; `part` reads and unpacks a range of letters."""

    def __init__(self, f: pa.NativeFile, offset: int, order: str):
        self.f = f
        f.seek(offset)
        self.size = self._number(order)
        runs = []
        for _ in range(2):
            n = self._number(order)
            starts, sizes = (np.frombuffer(f.read(4 * n), order + "u4").astype(np.int64) for _ in range(2))
            runs.append((starts, starts + sizes))
        self.unknown, self.lower = runs
        f.read(4)
        self.letters = f.tell()

    def _number(self, order: str) -> int:
        return struct.unpack(order + "I", self.f.read(4))[0]

    def part(self, start: int, end: int) -> str:
        end = min(end, self.size)
        self.f.seek(self.letters + start // 4)
        raw = np.frombuffer(self.f.read((end + 3) // 4 - start // 4), np.uint8)
        if len(raw) < (end + 3) // 4 - start // 4:
            raise ValueError("the two-bit file ends within a sequence")
        code = ((raw[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()[start % 4 :][: end - start]
        text = np.frombuffer(LETTERS, np.uint8)[code]
        for name, (starts, ends) in (("N", self.unknown), ("a", self.lower)):
            first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(starts, end)
            if first < last:
                mask = _inside(starts[first:last] - start, ends[first:last] - start, len(text))
                text = np.where(mask, np.uint8(ord("N")) if name == "N" else text | 32, text)
        return text.tobytes().decode()


class Stretch(InputPartition):
    """Tiles [first, last) of several sequences of one file; an open end is bounded by the sequence."""

    def __init__(self, path: str, order: str, records: list[tuple[str, int, int, int]]):
        self.path, self.order, self.records = path, order, records


class TwoBitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tile", TILE))
        if self.tile <= 0 or self.tile % 4:
            raise ValueError("a tile is a positive multiple of four letters")
        self.per_task = max(int(options.get("lettersPerTask", LETTERS_PER_TASK)) // self.tile, 1)

    def _files(self) -> list[str]:
        fs, at = opened(self.path)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            return [self.path]
        with fs.open_input_stream(f"{at}/{LIST}") as f:
            return [f"{self.path.rstrip('/')}/{n}" for n in json.loads(f.read())]

    def partitions(self) -> list[Stretch]:
        """A record's bytes bound its letters, so no record is read here."""
        out = []
        for path in self._files():
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                order, entries = index(f)
                entries.sort(key=lambda e: e[1])
                ends = [o for _, o in entries[1:]] + [f.size()]
            held, tiles = [], 0
            for (name, offset), end in zip(entries, ends):
                most = max(-(-max(end - offset - 16, 0) * 4 // self.tile), 1)
                for first in range(0, most, self.per_task):
                    n = min(self.per_task, most - first)
                    if held and tiles + n > self.per_task:
                        out.append(Stretch(path, order, held))
                        held, tiles = [], 0
                    held.append((name, offset, first, first + n))
                    tiles += n
            if held:
                out.append(Stretch(path, order, held))
        return out or [Stretch("", "<", [])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """Tiles in batches of some LETTERS_PER_BATCH letters."""
        rows, held = [], 0
        for row in self._tiles(partition):
            rows.append(row)
            held += len(row[4]) + 64
            if held >= LETTERS_PER_BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names, sizes, tiles, starts, parts = zip(*rows)
        columns = [pa.array(names, pa.string()), *[pa.array(c, pa.int64()) for c in (sizes, tiles, starts)], pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["chrom", "size", "tile", "start", "part"])

    def _tiles(self, partition: Stretch) -> Iterator[tuple]:
        if not partition.records:
            return
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            for name, offset, first, last in partition.records:
                r = Record(f, offset, partition.order)
                if first == 0 and r.size == 0:
                    yield name, 0, 0, 0, ""
                for tile in range(first, min(last, -(-r.size // self.tile))):
                    yield name, r.size, tile, tile * self.tile, r.part(tile * self.tile, (tile + 1) * self.tile)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class TwoBitWriter(DataSourceWriter):
    """Rows (chrom, seq) as files of about BYTES_PER_FILE in one folder. The list of files is written when
    every task has ended, so files of a task that was lost or run twice are not part of the result."""

    def __init__(self, options: dict):
        self.path, self.bound = options["path"], int(options.get("bytesPerFile", BYTES_PER_FILE))

    def _put(self, names: list[str], records: list[bytes]) -> str:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        file = f"part-{uuid.uuid4().hex}.2bit"
        with fs.open_output_stream(f"{at}/{file}") as out:
            for piece in file_bytes(names, records):
                out.write(piece)
        return file

    def write(self, iterator: Iterator) -> Written:
        done, names, records, held = [], [], [], 0
        for row in iterator:
            record = packed(row["seq"] or "")
            if records and held + len(record) > self.bound:
                done.append(self._put(names, records))
                names, records, held = [], [], 0
            names.append(str(row["chrom"]))
            records.append(record)
            held += len(record)
        if records:
            done.append(self._put(names, records))
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{LIST}") as out:
            out.write(json.dumps(sorted(n for m in messages if m is not None for n in m.names)).encode())

    def abort(self, messages: list[Written]) -> None:
        fs, at = opened(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            fs.delete_file(f"{at}/{n}")


class TwoBit(DataSource):
    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TwoBitReader:
        return TwoBitReader(self.options)

    def writer(self, schema, overwrite: bool) -> TwoBitWriter:
        return TwoBitWriter(self.options)


def read_two_bit(spark: SparkSession, path: str, tile: int = TILE, letters_per_task: int = LETTERS_PER_TASK) -> DataFrame:
    """Tiles (chrom, size, tile, start, part) of a file, or of a folder that `write_two_bit` wrote.

    Unknown letters read as N, masked ones in lower case; an empty sequence is one empty tile. `path` is
    mounted on every worker, or on a store that pyarrow opens (see `files.SCHEMES`). Names that occur in
    several files come out as often.
    """
    shipped(spark.range(0))
    spark.dataSource.register(TwoBit)
    return spark.read.format("twobit").option("tile", tile).option("lettersPerTask", letters_per_task).load(path)


def write_two_bit(sequences: DataFrame, path: str, chrom: str = "chrom", seq: str = "seq", bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Sequences as two-bit files in a new folder. A NULL sequence is an empty one, a NULL name an error."""
    from pyspark.sql import functions as F

    named = F.coalesce(F.col(chrom).cast("string"), F.raise_error(F.lit("a sequence has no name")).cast("string"))
    rows = shipped(sequences).select(named.alias("chrom"), F.col(seq).alias("seq"))
    sequences.sparkSession.dataSource.register(TwoBit)
    rows.write.format("twobit").option("bytesPerFile", bytes_per_file).mode("append").save(path)
