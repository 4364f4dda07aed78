"""Near-duplicate texts by SimHash, linked through anchors of a covering code.

A text's fingerprint has a bit set where more than half of its word shingles' XXH64 hashes have it.
Two texts are linked if their fingerprints differ in at most four of 64 bits.

The 64 bits are cut into three blocks (21, 21, 22), so a linked pair differs in at most one bit of
some block. In each block the anchors are a covering code of radius one: the [15,11] Hamming code
on 15 bits, every value on the rest. A fingerprint's home is the one anchor within radius one on the
coded bits; it is replicated to every anchor within radius plus block threshold (1 + 1 = 2) of it,
14.5 on average. If two fingerprints differ by one bit in the block, the home of either is within
two of the other, so each link meets at a home. Only homes are compared with members.

Inside an anchor a link is passed on only if it joins two parts that are not joined yet, so a dense
group of n copies gives n - 1 rows and never n^2. An anchor with more than `large` fingerprints is not
compared at all: its members take the finest code of all, radius zero, in which every 64-bit word is
an anchor, and go to the words within two bits. Two fingerprints share such a word exactly if they
differ in four bits or fewer; this is linear in the members and splits over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.knn import components
from .common import fresh, map_batches, map_text, materialize, raw

BITS = 64
DISTANCE = 4
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODED = 15
LARGE = 1 << 15


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text; no words: zero."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)]), np.uint8).reshape(-1, 8)
    total, votes = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, total, 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, keep: list[str], text: str, shingle: int, name: str) -> DataFrame:
    """The `keep` columns and the text's fingerprint as a signed 64-bit number in column `name`."""

    def build():
        def make(column: pa.Array) -> dict[str, object]:
            return {name: np.array([fingerprint(t, shingle) for t in raw(column)], np.uint64).view(np.int64)}

        return make

    return map_text(docs, keep, text, build, f"`{name}` bigint")


# ------------------------------------------------------------------ the covering code
def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the low 15 bits under the Hamming code whose check columns are 1 to 15."""
    s = np.zeros(len(x), np.int64)
    for i in range(CODED):
        s ^= np.where((x >> i) & 1, i + 1, 0)
    return s


def patterns(width: int, reach: int) -> list[np.ndarray]:
    """By syndrome: every flip of at most `reach` of `width` bits that leads to an anchor."""
    by: list[list[int]] = [[] for _ in range(CODED + 1)]
    for k in range(reach + 1):
        for bits in combinations(range(width), k):
            s = 0
            for i in bits:
                s ^= i + 1 if i < CODED else 0
            by[s].append(sum(1 << i for i in bits))
    return [np.array(x, np.int64) for x in by]


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint, whether the anchor is its home) over all three blocks."""
    anchors, index, home = [], [], []
    for b, (low, width) in enumerate(BLOCKS):
        x = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = _syndrome(x)
        own = np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0)
        for value, flips in enumerate(patterns(width, 2)):
            at = np.flatnonzero(s == value)
            to = x[at][:, None] ^ flips[None, :]
            anchors.append((to | (b << 32)).ravel())
            index.append(np.repeat(at, len(flips)))
            home.append((flips[None, :] == own[at][:, None]).ravel())
    return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


def joined(members: np.ndarray, is_home: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links between one anchor's members that join all which linked homes join, and no more."""
    part, out = np.arange(len(members)), []
    for h in np.flatnonzero(is_home):
        near = np.flatnonzero(np.bitwise_count(members ^ members[h]) <= distance)
        if len(near) < 2:
            continue
        labels = part[near]
        if (labels == part[h]).all():
            continue
        for label, first in zip(*np.unique(labels, return_index=True), strict=True):
            if label != part[h]:
                out.append((h, near[first]))
                part[part == label] = part[h]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> links. An anchor's rows may span batches."""
    held: list[np.ndarray] = []

    def links(anchor, fp, home):
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(anchor)]))
        homes = np.concatenate(([0], np.cumsum(home)))
        some = (stops - starts > 1) & (homes[stops] > homes[starts])
        a, b = [], []
        for lo, hi in zip(starts[some].tolist(), stops[some].tolist(), strict=True):
            for i, j in joined(fp[lo:hi], home[lo:hi]):
                a.append(fp[lo + i])
                b.append(fp[lo + j])
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["src", "dst"])

    for batch in batches:
        now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)]
        if not len(now[0]):
            continue
        held.append(now)
        if now[0][0] == now[0][-1]:  # still one anchor
            continue
        anchor, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(anchor, anchor[-1]))
        yield links(anchor[:last], fp[:last], home[:last])
        held = [[anchor[last:], fp[last:], home[last:]]]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            anchor, index, home = replicas(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


def _words_within_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    flips = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 64):
            part = fps[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["word", "fp"])


def linked(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """(src, dst) between the distinct fingerprints in column `fp`, enough to join every class."""
    spread = materialize(map_batches(fps.select("fp"), _expand, "anchor bigint, fp bigint, home boolean"))
    crowded = spread.groupBy("anchor").count().where(F.col("count") > large).select("anchor")
    crowd = materialize(spread.join(crowded, "anchor", "left_semi").select("fp").distinct())
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = (
        map_batches(spread.join(crowded, "anchor", "left_anti").repartition(parts, "anchor").sortWithinPartitions("anchor"), _compare, "src bigint, dst bigint")
    )
    if crowd.isEmpty():
        return pairs
    words = map_batches(crowd, _words_within_two, "word bigint, fp bigint")
    low = words.groupBy("word").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "src")
    # every member of a crowded anchor meets its links here, whichever anchor they came from
    return pairs.unionByName(words.join(low, "word").where("src <> fp").select("src", F.col("fp").alias("dst")).distinct())


def classes(rows: DataFrame, id: str, fp: str, large: int = LARGE) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the smallest non-null id among the rows of
    its class. Null where no row of the class has an id."""
    distinct = materialize(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("least")))
    links = materialize(linked(distinct, large))
    touched = links.select(F.col("src").alias("fp")).unionByName(links.select(F.col("dst").alias("fp"))).distinct()
    of = materialize(components(links, touched, "fp"))
    small = of.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    known = of.join(small, "component").select("fp", "component_id")
    return distinct.join(known.withColumn("known", F.lit(True)), "fp", "left").select("fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, large: int = LARGE) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    Null, empty and blank texts have fingerprint zero and link like any other; repeated rows come out
    repeated; a null id keeps its row and takes its class's smallest id; an empty table gives no rows.
    Other columns of `docs` are ignored, whatever their names.
    """
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = materialize(with_fingerprints(slim, ["id"], "text", shingle, "fp"))
    return rows.join(classes(rows, "id", "fp", large), "fp").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, large: int = LARGE) -> DataFrame:
    """The rows of `docs`, one from each class of near-duplicates: that with the smallest id (null ids
    last; the first of repeated rows). `docs` must be a stored table, whose row numbers stay the same."""
    (row,) = fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    slim = numbered.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(row).alias("row"))
    prints = with_fingerprints(slim, ["id", "row"], "text", shingle, "fp")
    rows = materialize(prints.withColumn("last", F.col("id").isNull()))
    order = F.struct("last", "id", "row")
    best = materialize(rows.groupBy("fp").agg(F.min(order).alias("best")))
    links = materialize(linked(best.select("fp"), large))
    touched = links.select(F.col("src").alias("fp")).unionByName(links.select(F.col("dst").alias("fp"))).distinct()
    of = components(links, touched, "fp")
    won = best.join(of, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(won, row, "left_semi").drop(row)
