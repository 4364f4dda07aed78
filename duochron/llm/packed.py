"""Token ids in fixed-width bit-packed files.

An id takes the bits that the largest id of the vocabulary needs. Documents lie in ascending order of
their id, in files that each hold a range of them (a shard); a file is a sequence of blocks of whole
documents. A block carries its offset (the ids before it in its shard), its documents' ids and offsets,
and one packed payload: id i is at bits [i * width, (i + 1) * width) of little-endian 64-bit words. So 64
ids take `width` words, numpy packs and unpacks 64 columns at a time, and any id range is found from the
offsets alone. Blocks are rows of Parquet files without compression: any Spark file system takes them,
Spark's committer makes writing safe against lost executors, and offsets are read without payloads.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_batches

BLOCK = 1 << 17  # ids; a block ends with the document that reaches it
KNOWN = 700_000  # pieces kept per process
SENT = 200_000  # shards, of some 20 bytes each, whose offsets go to every task; more are joined by a shuffle
SCHEMA = "shard int, block int, offset bigint, n_ids bigint, width int, doc_ids array<bigint>, doc_offsets array<bigint>, payload binary"


# ------------------------------------------------------------------ packing
def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids under 2**width in fixed-width fields of little-endian 64-bit words."""
    n = len(ids)
    rows = -(-n // 64)
    grid = np.zeros((rows, 64), np.uint64)
    grid.ravel()[:n] = ids
    words = np.zeros((rows, width), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, at] |= grid[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * width // 8)]


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload, from the words that hold them alone."""
    low, high = start // 64, -(-stop // 64)
    part = payload[low * width * 8 : high * width * 8]
    part += bytes((high - low) * width * 8 - len(part))
    words = np.frombuffer(part, "<u8").reshape(-1, width)
    out = np.empty((high - low, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        value = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, at + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[start - low * 64 : stop - low * 64].astype(np.uint32)


# ------------------------------------------------------------------ encoding
_OTHER_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of texts by a byte-level file of the tokenizers library.

    The file's pattern never lets a piece cross a single blank (which opens the next piece) or a single
    line break (a piece of its own), so such texts are encoded piece by piece and each piece of a batch
    once, all new pieces in one call. Texts with runs of white space, or with what may be a special
    token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the cores
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.largest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.by_piece = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["pre_tokenizer"]["use_regex"] and not spec["normalizer"] and spec["model"]["vocab"].get("Ċ") is not None
        self.line = spec["model"]["vocab"].get("Ċ")
        names = [t["content"] for t in spec["added_tokens"]]
        self.runs = ["  ", " \n", "\n ", "\n\n", "\0", *names]
        self.whole = re.compile("|".join([r"\s\s", "\0", *map(re.escape, names)]))
        self.odd = re.compile(r"[^\S \n]| (?:\n|$)")
        self.kind = np.uint16 if self.largest < 1 << 16 else np.uint32
        self.fixed = {"": b"", "\n": self.kind(self.line or 0).tobytes()}
        self.known: dict[str, bytes] = dict(self.fixed)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        size, known = self.kind().itemsize, self.known
        groups = [new[at : at + 64] for at in range(0, len(new), 64)]
        joined = ["\n".join(g) for g in groups]
        for g, text, found in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            if self.odd.search(text):  # white space beside the line breaks: each piece alone
                known.update((p, self._ids(p)) for p in g)
                continue
            ids = np.array(found.ids, self.kind)
            cuts = (np.flatnonzero(ids == self.line) * size).tolist()
            data, at = ids.tobytes(), 0
            for p, end in zip(g, [*cuts, len(data)], strict=True):
                known[p] = data[at:end]
                at = end + size

    def _in_pieces(self, text: str) -> bool:
        """Whether nothing in the text needs to be seen whole: see the class."""
        if not self.by_piece:
            return False
        if text.isascii() and not any(c in text for c in _OTHER_BLANKS):
            return not any(x in text for x in self.runs)
        return not self.whole.search(text)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if self._in_pieces(t) else None for t in (x or "" for x in texts)]
        values = [None if c is None else list(map(self.known.get, c)) for c in cut]
        new = set().union(*(compress(c, map(not_, v)) for c, v in zip(cut, values, strict=True) if c)) - {""}  # "" has no ids
        if len(self.known) + len(new) > KNOWN:  # a full table keeps what this batch uses, the frequent pieces
            self.known = self.fixed | {p: x for c, v in zip(cut, values, strict=True) if c for p, x in zip(c, v, strict=True) if x is not None}
        self._learn(list(new))
        known = self.known
        out = []
        for t, c, v in zip(texts, cut, values, strict=True):
            data = self._ids(t or "") if c is None else b"".join([known[p] if x is None else x for p, x in zip(c, v, strict=True)] if None in v else v)
            out.append(np.frombuffer(data, self.kind))
        return out


def encoder(path: str) -> Encoder:
    """One per process and file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


# ------------------------------------------------------------------ writing
def write(docs: DataFrame, to: str, path: str, id: str = "doc_id", text: str = "text", end: int = 0) -> None:
    """Encode every text (null: empty), append `end`, and write shards in ascending id order (nulls
    first, repeated ids by text) to folder `to`. One range partition is one shard. Ids are numbers: text
    that is none is an error where Spark is strict about casts, else null."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    ordered = slim.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", "text").withColumn("shard", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = bits_for(max(enc.largest, end))
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        block = offset = filled = 0
        shard = 0
        stop = np.array([end], enc.kind)

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(h) + 1 for h in held], np.int64)
            flat = np.concatenate([x for h in held for x in (h, stop)])
            values = [[shard], [block], [offset], [int(sizes.sum())], [width], [ids], [np.concatenate(([0], np.cumsum(sizes[:-1]))).tolist()], [pack(flat, width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                shard = b.column(2)[0].as_py()
                for i, found in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist()), strict=True):
                    held.append(found)
                    ids.append(i)
                    filled += len(found) + 1
                    if filled >= BLOCK:
                        yield flush()
                        block, offset, filled = block + 1, offset + filled, 0
                        held.clear()
                        ids = []
        if held:
            yield flush()

    map_batches(ordered, run, SCHEMA).write.option("compression", "none").parquet(to)


# ------------------------------------------------------------------ reading
def bases(spark: SparkSession, at: str) -> DataFrame:
    """(shard, base): the ids before each shard that was written, read from the offsets."""
    sizes = spark.read.schema(SCHEMA).parquet(at).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = [0, *accumulate(r.n for r in sizes)]
    out = spark.createDataFrame([(r.shard, b) for r, b in zip(sizes, before)], "shard int, base bigint")
    return F.broadcast(out) if len(sizes) <= SENT else out


def documents(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, unpacked from the files in `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                edges = [*r["doc_offsets"], r["n_ids"]]
                ids = unpack(r["payload"], r["width"], 0, r["n_ids"]).astype("<u4")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["base"] + r["offset"] + a for a in edges[:-1]], pa.int64()), pa.array([b - a for a, b in zip(edges, edges[1:])], pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(SCHEMA).parquet(at).join(bases(spark, at), "shard")
    return map_batches(blocks.select("base", "offset", "n_ids", "width", "doc_ids", "doc_offsets", "payload"), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def ids_between(spark: SparkSession, at: str, start: int, stop: int) -> DataFrame:
    """(position, id) for positions start to stop of all ids: only the blocks that hold them are unpacked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = max(0, start - r["first"]), min(r["n_ids"], stop - r["first"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + r["first"], pa.int64()), pa.array(unpack(r["payload"], r["width"], a, b).astype(np.int64))], names=["position", "id"])

    blocks = spark.read.schema(SCHEMA).parquet(at).join(bases(spark, at), "shard").withColumn("first", F.col("base") + F.col("offset"))
    held = blocks.where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))
    return map_batches(held.select("first", "n_ids", "width", "payload"), run, "position bigint, id bigint")
