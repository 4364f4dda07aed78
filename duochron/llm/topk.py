"""Exact top-k search by integer inner product: MaxScore over shards, merged in Spark.

A vector's dimensions are the terms; a term's postings are its column of a shard. Rows are packed where
they lie into shards, and within a shard similar rows into blocks, with the largest and smallest entry of
every term in every block. For one query and one block:

1. The sum of the terms' upper bounds is the block's bound. Below the query's threshold (its k-th best
   score so far) the block is passed over.
2. Terms are ordered by the width of their bounds. The narrowest ones that together cannot lift a row
   whose other terms are all at their lower bounds to the threshold are non-essential, the rest essential.
3. The essential postings are traversed, giving partial sums for all rows of the block. Rows whose partial
   sum plus the upper bounds of the non-essential terms stays below the threshold are done.
4. The others are probed in their non-essential terms, widest first, and given up as soon as they can no
   longer compete.

Thresholds begin at the k-th best score among the query rows themselves, which a first round of the same
search finds, so every shard can pass over what cannot win. Each shard yields at most k rows a query, and
those of all shards are merged by a window. Rows that tie with a threshold stay: a smaller id may win.

Queries meet shards as blocks of some hundred vectors, never row by row; Spark broadcasts the query
blocks only where their stored size is under its own limit and otherwise reads them for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, map_batches, materialize, stored
from .vectors import LARGEST, floors, matrices, narrow

SHARD = 16_384  # rows
BLOCK = 128  # rows with common bounds
QUERIES = 1_024  # in one block of queries
PROBED = 16  # non-essential terms looked up at once
FEW = 1 / 16  # of a block's pairs; beyond, a matrix product is the cheaper probe
NO_ID = LARGEST  # stands for a null id, so that it comes last among ties
_PACKED = "part bigint, dim int, n int, kind string, ids binary, entries binary"


def _pack(rows: int):
    """Batches of (id, vector) to packed rows; `part` is unique within the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part = TaskContext.get().partitionId() << 33

        def out(d: int) -> pa.RecordBatch:
            nonlocal part
            ids = np.concatenate([i for i, _ in held[d]])
            x = narrow(np.concatenate([x for _, x in held.pop(d)]))
            part += 1
            return pa.RecordBatch.from_pydict({"part": [part], "dim": pa.array([d], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "kind": [x.dtype.str], "ids": [ids.astype("<i8").tobytes()], "entries": [x.tobytes()]})

        for b in batches:
            ids = np.asarray(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), np.int64)
            for at, x in matrices(b.column(1)):
                x, d = floors(x), x.shape[1]
                for lo in range(0, len(at), rows):
                    piece = slice(lo, lo + rows)
                    if d in held and sum(len(i) for i, _ in held[d]) + len(at[piece]) > rows:
                        yield out(d)
                    held.setdefault(d, []).append((ids[at[piece]], x[piece]))
        for d in list(held):
            yield out(d)

    return run


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """Doubles where they hold every possible sum of products exactly, else Python's integers."""
    return x.astype(np.float64) if most < 2**53 else x.astype(object)


class Shard:
    """Rows of one packed shard in blocks of similar ones, with each block's bounds by term."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        pivots = x[:: BLOCK].astype(np.float64)
        order = np.argsort((x.astype(np.float64) @ pivots.T).argmax(1), kind="stable") if x.shape[1] else np.arange(len(x))
        self.ids, self.x = ids[order], x[order]
        self.starts = np.arange(0, len(x), BLOCK)
        self.most = int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0
        self.high = np.maximum.reduceat(self.x, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.x, self.starts, axis=0)
        self.cast: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def as_numbers(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = most < 2**53
        if key not in self.cast:
            self.cast[key] = tuple(_exact(a, most) for a in (self.x, self.high, self.low))
        return self.cast[key]


def _merge(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each `who`, in order; ties go to the smaller id."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, int)
    rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
    return order[rank < k]


def _probed(q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray, score: np.ndarray, order: np.ndarray, count: np.ndarray, reach: np.ndarray, least: np.ndarray):
    """Pairs (r, c) that still compete after all their non-essential terms, with whole scores."""
    for end in range(int(count.max(initial=0)), 0, -PROBED):
        begin = max(0, end - PROBED)
        terms = order[r, begin:end]
        used = np.arange(begin, end) < count[r, None]
        score = score + (q[r[:, None], terms] * x[c[:, None], terms] * used).sum(1)
        left = np.minimum(count[r], begin)
        keep = score + reach[r, left] >= least[r]
        r, c, score = r[keep], c[keep], score[keep]
    return r, c, score


def search(shard: Shard, own: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best rows of the shard for each query that reach `least`, the
    query's own id apart. Scores end at the ends of long's range."""
    most = max(1, queries.shape[1] * shard.most * int(max(abs(int(queries.min())), abs(int(queries.max())))) if queries.size else 1)
    x, high, low = shard.as_numbers(most)
    q = _exact(queries, most)
    zero = q.dtype.type(0) if q.dtype != object else 0
    least = least.astype(np.float64) if q.dtype != object else np.array([v if np.isinf(v) else int(v) for v in least], object)
    bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
    who, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)
    for b in np.argsort(-bound.max(0), kind="stable"):
        active = np.flatnonzero(bound[:, b] >= least)
        if not len(active):
            continue
        rows = slice(shard.starts[b], shard.starts[b] + BLOCK)
        a, xb, need = q[active], x[rows], least[active]
        one, two = a * high[b], a * low[b]
        up, down = np.maximum(one, two), np.minimum(one, two)
        width = up - down
        order = np.argsort(width, axis=1, kind="stable")
        free = np.cumsum(np.take_along_axis(width, order, 1), axis=1) < (need - down.sum(1))[:, None]
        count = free.sum(1).astype(np.int64)
        essential = np.ones(a.shape, bool)
        np.put_along_axis(essential, order, ~free, 1)
        reach = np.concatenate((np.zeros((len(a), 1), q.dtype), np.cumsum(np.take_along_axis(up, order, 1), axis=1)), axis=1)
        part = (a * essential) @ xb.T
        alive = (part + np.take_along_axis(reach, count[:, None], 1) >= need[:, None]) & (shard.ids[rows] != own[active, None])
        r, c = np.nonzero(alive)
        if len(r) <= FEW * alive.size:
            r, c, found = _probed(a, xb, r, c, part[r, c], order, count, reach, need)
        else:
            whole = part + (a * ~essential) @ xb.T
            r, c = np.nonzero(alive & (whole >= need[:, None]))
            found = whole[r, c]
        if not len(r):
            continue
        if q.dtype == object:
            found = np.array([max(-LARGEST - 1, min(LARGEST, int(v))) for v in found], object)
        who, ids, score = np.concatenate((who, active[r])), np.concatenate((ids, shard.ids[rows][c])), np.concatenate((score, found))
        best = _merge(who, score, ids, k)
        who, ids, score = who[best], ids[best], score[best]
        n = np.bincount(who, minlength=len(q))
        full = np.flatnonzero(n >= k)
        kth = score[np.cumsum(n)[full] - 1]
        least[full] = np.maximum(least[full], kth)
    return who, ids, score.astype(np.int64) if score.dtype != object else np.array([int(v) for v in score], np.int64)


def _matrix(entries: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(entries, kind).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 0), np.int64)


def _searched(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Every block of queries in every shard of the same dimension."""
    q = queries.select(F.col("part").alias("q_part"), F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("entries").alias("q_entries"), "least")
    met = shards.crossJoin(q).where(F.col("dim") == F.col("q_dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names if n not in ("ids", "entries", "kind")}
                if row["part"] != last:
                    shard = Shard(np.frombuffer(b.column("ids")[i].as_py(), "<i8"), _matrix(b.column("entries")[i].as_py(), b.column("kind")[i].as_py(), row["n"]))
                    last = row["part"]
                own = np.frombuffer(row["q_ids"], "<i8")
                who, ids, score = search(shard, own, _matrix(row["q_entries"], row["q_kind"], row["q_n"]), np.array([-np.inf if v is None else v for v in row["least"]], object), k)
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(who), row["q_part"]), pa.int64()), "at": pa.array(who, pa.int32()), "query_id": pa.array(own[who]), "vec_id": pa.array(ids), "score": pa.array(score)})

    return map_batches(met, run, "part bigint, at int, query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, id: str, vector: str, is_query: Column, k: int = 10) -> DataFrame:
    """The `k` best rows by inner product of floor(1024 * entry) for every row where `is_query` holds:
    query_id, rank (from 1), vec_id, score.

    Candidates are all rows but those with the query's own id, with vectors of the query's length; ties
    go to the smaller id, a null id last. Fewer candidates than `k` are all returned. Vectors that are
    null or hold null or non-finite entries take no part; vectors without entries score 0. Repeated query
    rows are answered one by one; repeated candidates count as often as they are there. Entries and
    scores beyond the range of long end at its ends. An empty table gives no rows. Other columns are not
    looked at.
    """
    spark = df.sparkSession
    flag, = fresh(df, "is_query")
    rows = df.select(F.col(id).cast("bigint").alias(id), vector, is_query.alias(flag))
    shards = stored(map_batches(rows.select(id, vector), _pack(SHARD), _PACKED), "shards")
    chosen = rows.where(F.col(flag)).select(id, vector)
    parts = max(1, -(-chosen.count() // QUERIES))
    blocks = stored(map_batches(chosen.repartition(parts), _pack(QUERIES), _PACKED), "queries")
    best = Window.partitionBy("part", "at").orderBy(F.desc("score"), F.asc("vec_id"))

    # the k-th best among the query rows is a first threshold
    unknown = blocks.withColumn("least", F.array_repeat(F.lit(None).cast("bigint"), F.col("n")))
    first = _searched(blocks, unknown, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    least = first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("m"))
    ready = stored(blocks.join(least, "part", "left").withColumn("least", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at(F.col("m"), i))).drop("m"), "thresholds")

    found = materialize(_searched(shards, ready, k))
    for used in (shards, blocks, ready):
        discard(used)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
