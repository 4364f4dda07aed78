"""Substring dedup: passages of at least `window` words that start anywhere else are removed.

A De Bruijn graph of token k-mers over the positions that matter. In every run of window - K + 1 k-mers
the smallest hash is chosen, so each window holds a chosen k-mer and equal windows hold equal ones at
equal places; about one position in fourteen is an edge of the graph (and the first of each text). An
edge's reach is the text from it to the end of the first chosen k-mer that ends all windows starting
before the next edge, or to the end of the text.

1. Edges that occur twice or more are kept with their source coordinates (row, word).
2. An edge is tied to the next one if every occurrence of it has the same reach, and the next edge
   occurs as often: the path between them does not branch. Spark joins find the ties; the islands of tied
   edges along the first occurrence of each are the compacted paths (unitigs).
3. A path of at least `window` words is a repeated span wherever it lies: all its occurrences run in
   step, so its windows can only equal each other and nothing in it needs to be looked at again.
4. Elsewhere, windows that start before the next edge are repeated if the whole reach occurs twice. One
   occurrence of each such reach, the first, puts its windows forward for comparison, with weight two.
5. What is left, windows next to a difference, is verified at its source coordinates: 128-bit hashes of
   the windows whose own smallest k-mer is repeated are counted, together with those from 4.

A k-mer or window that a third of all rows share is counted with partial sums before the shuffle. Texts
are compressed before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, raw, stored

WINDOW = 35
K = 5
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of them."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, 1 << 15)
        out = []
        for b in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[which] = (out[0], out[1])
    return _POWERS[which]


class Words:
    """A text's words, with hashes of any run of them."""

    def __init__(self, text: bytes | None):
        self.words = (text or b"").split()
        self.n = len(self.words)
        self._sums: dict[int, np.ndarray] = {}
        self._of: np.ndarray | None = None

    def runs(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of the words from start to stop, for arrays of both."""
        if which not in self._sums:
            if self._of is None:
                self._of = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), _U, self.n)
            h = self._of if which == 0 else _mix(self._of + _U(which))
            self._sums[which] = np.concatenate((np.zeros(1, _U), np.cumsum(h * _powers(which, self.n + 1)[0][: self.n])))
        s = self._sums[which]
        return _mix((s[stop] - s[start]) * _powers(which, self.n + 1)[1][start] + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def chosen(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, hashes) of the chosen k-mers and of the first, and the place of each window's own."""
        if self.n < window:
            return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.arange(self.n - K + 1)
        h = self.runs(at, at + K)
        width = window - K + 1
        least = np.lib.stride_tricks.sliding_window_view(h, width)
        first = np.empty(len(least), np.int64)
        for a in range(0, len(least), 1 << 14):
            first[a : a + (1 << 14)] = least[a : a + (1 << 14)].argmin(axis=1)
        first += np.arange(len(first))
        at = np.unique(np.concatenate((np.zeros(1, np.int64), first)))
        return at, h[at], first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ------------------------------------------------------------------ the graph
def reaches(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Where the reach of each chosen k-mer of a text of n words ends."""
    need = np.concatenate((at[1:] - 1, [n])) + window  # the last window before the next edge ends here
    end = np.concatenate((at + K, [n]))
    return np.minimum(end[np.minimum(np.searchsorted(at + K, need), len(at))], n)


def edges(numbered: DataFrame, window: int) -> DataFrame:
    """(edge, reach, row, at) of every chosen k-mer."""

    def batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, reach, row, at = (np.concatenate(p) for p in parts)
        return pa.RecordBatch.from_arrays([_signed(h), _signed(reach), pa.array(row), pa.array(at.astype(np.int32))], names=["edge", "reach", "row", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for row, text in zip(whole.column(0).to_pylist(), raw(whole.column(1)), strict=True):
                w = Words(text)
                at, h, _ = w.chosen(window)
                if not len(at):
                    continue
                for o, x in zip(out, (h, w.runs(at, reaches(at, w.n, window)), np.full(len(at), row), at), strict=True):
                    o.append(x)
                if sum(map(len, out[3])) > 200_000:
                    yield batch(out)
                    out = [[], [], [], []]
            if out[0]:
                yield batch(out)

    return map_batches(numbered.select("row", "text"), run, "edge bigint, reach bigint, row bigint, at int")


def repeated(occurrences: DataFrame) -> DataFrame:
    """The occurrences of edges that occur twice or more. The counts are written first, so that the join
    meets plain tables on both sides and Spark can split an edge that very many texts share."""
    twice = stored(occurrences.groupBy("edge").count().where("count > 1").select("edge"), "twice")
    return occurrences.join(twice, "edge", "left_semi")


def paths(occ: DataFrame, window: int) -> DataFrame:
    """(edge, path, tied, copies): the compacted path of each repeated edge, named by its first edge.

    `tied` says that the edge continues the one before it wherever it lies.
    """
    along = Window.partitionBy("row").orderBy("at")
    near = occ.withColumn("next", F.when(F.lead("at").over(along) - F.col("at") <= window - K + 1, F.lead("edge").over(along)))
    by = stored(
        near.groupBy("edge").agg(
            F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"), F.count("next").alias("nexts"), F.min("next").alias("next"), F.min(F.struct("row", "at")).alias("first")
        ),
        "edges",
    )
    # one reach for all occurrences: the next chosen k-mer lies in it, so it is the same too
    onward = by.where((F.col("low") == F.col("high")) & (F.col("nexts") == F.col("n"))).select(F.col("next").alias("edge"), F.col("n").alias("before"), F.col("edge").alias("prior"))
    tied = by.select("edge", "n").join(onward, "edge").where((F.col("before") == F.col("n")) & (F.col("prior") != F.col("edge"))).select("edge", F.lit(True).alias("tied")).distinct()
    marked = by.join(tied, "edge", "left").select("edge", "n", F.col("first.row").alias("row"), F.col("first.at").alias("at"), F.coalesce("tied", F.lit(False)).alias("tied"))
    head = F.last(F.when(~F.col("tied"), F.col("edge")), ignorenulls=True).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("edge", head.alias("path"), "tied", F.col("n").alias("copies"))


# ------------------------------------------------------------------ spans and windows of one text
def spans_of(at: list[int], tied: list[bool], longest: int) -> list[tuple[int, int]]:
    """Maximal runs of tied edges of a text, as word ranges, in order. `at` is sorted."""
    out: list[list[int]] = []
    for i, (a, t) in enumerate(zip(at, tied, strict=True)):
        if out and t and a - at[i - 1] <= longest:
            out[-1][1] = a + K
        else:
            out.append([a, a + K])
    return [(a, b) for a, b in out]


def sort_windows(w: Words, found: list[dict], spans: list[tuple[int, int]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows known to be repeated, starts put forward with weight two, starts to verify).

    `found`: the text's repeated edges: at, tied, twice (its reach occurs twice), first (here first).
    """
    chosen, _, own = w.chosen(window)
    n = len(own)
    place = np.searchsorted(chosen, np.arange(n), side="right") - 1  # the last edge at or before each start
    twice, first, edge = (np.zeros(len(chosen), bool) for _ in range(3))
    where = np.searchsorted(chosen, [f["at"] for f in found])
    edge[where] = True
    twice[where] = [f["twice"] for f in found]
    first[where] = [f["first"] for f in found]
    loose = np.ones(n, bool)
    for a, b in spans:
        loose[a : b - window + 1] = False
    known = twice[place] & loose
    return np.flatnonzero(known), np.flatnonzero(known & first[place]), np.flatnonzero(edge[np.searchsorted(chosen, own)] & loose & ~known)


def covered(n: int, starts: np.ndarray, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


_SPANS = "array<struct<start:int,stop:int>>"
_JUDGED = f"n_words bigint, kept_sha256 string, text binary, spans {_SPANS}, starts array<int>, weights array<int>, h1 array<bigint>, h2 array<bigint>"
_RANGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def ranges_of(flags: np.ndarray) -> list[dict[str, int]]:
    flips = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(flips[::2], flips[1::2], strict=True)]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    small = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([small.compress(t or b"") for t in raw(b.column(2))], pa.binary())], names=["row", "id", "text"])


def _judge(window: int):
    """Texts with their repeated edges: done if they have none, else with what is known to be repeated
    (spans) and the windows to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                b = whole.slice(low, 500)
                out: dict[str, list] = {k: [] for k in ("n_words", "sha", "text", "spans", "starts", "weights", "h1", "h2")}
                for packed, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    w = Words(big.decompress(packed))
                    out["n_words"].append(w.n)
                    if not found:
                        out["sha"].append(hashlib.sha256(b" ".join(w.words)).hexdigest())
                        for k in ("text", "spans", "starts", "weights", "h1", "h2"):
                            out[k].append(None)
                        continue
                    found.sort(key=lambda e: e["at"])
                    spans = [s for s in spans_of([e["at"] for e in found], [e["tied"] for e in found], window - K + 1) if s[1] - s[0] >= window]
                    known, forward, verify = sort_windows(w, found, spans, window)
                    starts = np.concatenate((forward, verify))
                    out["sha"].append(None)
                    out["text"].append(packed)
                    out["spans"].append(ranges_of(covered(w.n, known, spans, window)))
                    out["starts"].append(starts.astype(np.int32))
                    out["weights"].append(np.repeat(np.array([2, 1], np.int32), (len(forward), len(verify))))
                    for i, k in enumerate(("h1", "h2")):
                        out[k].append(w.runs(starts, starts + window, i).view(np.int64))
                kinds = [pa.int64(), pa.string(), pa.binary(), _RANGES, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["row", "id", "n_words", "kept_sha256", *list(out)[2:]])

    return run


def _finish(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, kept, shas, ranges = [], [], [], []
            for text, spans, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = big.decompress(text).split()
                gone = covered(len(words), np.array(starts or [], np.int64), [(s["start"], s["stop"]) for s in spans], window)
                line = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(line).hexdigest())
                kept.append(line.decode() if texts else None)
                ranges.append(ranges_of(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(ranges, _RANGES), pa.array(kept, pa.string())], names=["row", "n_removed", "sha", "removed", "kept"])

    return run


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, removed (word ranges), and with texts=True the kept
    words of every text that lost some.

    Words are runs between ASCII white space. Null, empty and short texts lose nothing; of repeated rows
    with a window or more every copy loses all that they share; other columns are ignored. `docs` must be
    a stored table, whose row numbers stay the same each time it is read.
    """
    numbered = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    occ = stored(repeated(stored(edges(numbered, window), "kmers")), "repeated")
    whole = occ.groupBy("edge", "reach").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at")).alias("first"))
    facts = stored(whole.join(paths(occ, window), "edge").select("edge", "reach", "tied", (F.col("times") > 1).alias("twice"), "first"), "facts")
    own = F.struct("at", "tied", "twice", (F.col("first") == F.struct("row", "at")).alias("first"))
    found = occ.join(facts, ["edge", "reach"]).groupBy("row").agg(F.collect_list(own).alias("found"))
    kind = docs.schema[id].dataType.simpleString()
    packed = map_batches(numbered.select("row", "id", "text"), _shrink, f"row bigint, id {kind}, text binary")
    judged = stored(map_batches(packed.join(found, "row", "left").select("row", "id", "text", "found"), _judge(window), f"row bigint, id {kind}, {_JUDGED}"), "judged")
    each = judged.select("row", F.explode(F.arrays_zip("starts", "weights", "h1", "h2")).alias("w")).select("row", "w.*")
    twice = stored(each.groupBy("h1", "h2").agg(F.sum("weights").alias("n")).where("n > 1").select("h1", "h2"), "windows")
    again = each.where("weights = 1").select("row", "starts", "h1", "h2").join(twice, ["h1", "h2"], "left_semi").groupBy("row").agg(F.collect_list("starts").alias("again"))
    waiting = judged.where(F.col("text").isNotNull()).select("row", "text", "spans").join(again, "row", "left")
    ended = map_batches(waiting.select("row", "text", "spans", "again"), _finish(window, texts), f"row bigint, n_removed bigint, sha string, removed {_SPANS}, kept string")
    out = judged.select("row", "id", "n_words", "kept_sha256").join(ended, "row", "left")
    cols = [F.col("id").alias(id), "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"), "removed"]
    return out.select(*cols, *(["kept"] if texts else []))
