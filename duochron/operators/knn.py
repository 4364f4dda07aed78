"""Exact nearest neighbours and what is read off the neighbour graph.

Vectors are collapsed to distinct ones, assigned to pivot cells, and cells are compared only
where the triangle inequality cannot rule a neighbour out (Lu, Shen, Chen, Ooi 2012, exact kNN
join). Neighbouring cells share blocks, and a cell larger than a block has several. A unit of work
therefore holds two bounded blocks, keeps k rows per query, and never emits all pairs; a vector is
sent to as many units as the other side has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash60
from ..functions.vectors import distance, doubles, mean_vector
from ..session import materialize, shipped
from .ordered import neighbors, rank_rows
from .stats import MAX_LEVELS, quantiles

ROWS_PER_CHUNK = 8_192
MAX_PIVOTS = 512
CHUNKS_A_BLOCK = 16  # chunks of rows that a unit of work may take from one side
UNITS = 128  # units of a search whose blocks are not full, shared out by the squares of the groups' rows
WIDER = 1.7  # blocks of queries a block of candidates: a list of neighbours takes more bytes than a vector
QUERIES_AT_ONCE, CANDIDATES_AT_ONCE = 512, 8_192


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    sq = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
    return np.maximum(sq, 0.0)


def _nearest(q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate id, distance) of the k nearest candidates of each query, by (distance, id).

    Candidates come in blocks. A matrix product shortlists those that may lie within the k-th distance so far,
    a margin covers its rounding, and the shortlist is measured by direct differences."""
    row, dst, dist = [], [], []
    square = (c * c).sum(1)
    scale = np.fmax.reduce(square, initial=0.0)
    for lo in range(0, len(q), QUERIES_AT_ONCE):
        block = q[lo : lo + QUERIES_AT_ONCE]
        own = (block * block).sum(1)
        margin = 1e-9 * (own + scale + 1.0)
        bound = np.full(len(block), np.inf)
        held = np.zeros(0, np.int64), np.zeros(0, c_id.dtype), np.zeros(0)
        for at in range(0, len(c), CANDIDATES_AT_ONCE):
            part = c[at : at + CANDIDATES_AT_ONCE]
            sq = block @ part.T
            sq *= -2.0
            sq += own[:, None]
            sq += square[None, at : at + len(part)]
            if not at and len(part) > k:
                kth = np.partition(sq, k - 1, axis=1)[:, k - 1]
                bound = np.where(np.isnan(kth), np.inf, np.maximum(kth, 0.0))
            r, j = np.nonzero(sq <= (bound + margin)[:, None])
            diff = part[j] - block[r]
            found = r, c_id[at + j], np.sqrt((diff * diff).sum(1))
            r, i, d = (np.concatenate(x) for x in zip(held, found))
            order = np.lexsort((i, d, r))
            r, i, d = r[order], i[order], d[order]
            first = np.searchsorted(r, np.arange(len(block)))
            keep = np.arange(len(r)) - first[r] < k
            held = r, i, d = r[keep], i[keep], d[keep]
            size = np.bincount(r, minlength=len(block))
            full = np.flatnonzero(size >= k)
            bound[full] = d[np.cumsum(size)[full] - 1] ** 2
        row.append(held[0] + lo), dst.append(held[1]), dist.append(held[2])
    return tuple(np.concatenate(x) for x in (row, dst, dist))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; a missing entry is NaN."""
    v = column.combine_chunks()
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    if v.null_count or len(np.unique(sizes)) > 1:
        raise ValueError("vectors must be there and of one length")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _unit(queries: pa.Table, candidates: pa.Table, meet: np.ndarray | None, k: int) -> pa.Table:
    """The k nearest of a block of candidates to each of a block of queries, a list a query. `meet` says by
    cell which queries and candidates may be neighbours; None: all."""
    queries = queries.sort_by("cell")
    near = []
    if queries.num_rows and candidates.num_rows:
        q, c, c_id = _matrix(queries["v"]), _matrix(candidates["cv"]), candidates["cid"].to_numpy()
        if meet is None:
            near.append(_nearest(q, c_id, c, k))
        else:
            q_cell, c_cell = queries["cell"].to_numpy(), candidates["ccell"].to_numpy()
            edges = [*np.flatnonzero(np.diff(q_cell, prepend=-1)), len(q_cell)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                ok = meet[q_cell[lo]][c_cell]
                row, dst, dist = _nearest(q[lo:hi], c_id, c, k) if ok.all() else _nearest(q[lo:hi], c_id[ok], c[ok], k)
                near.append((row + lo, dst, dist))
    row, dst, dist = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, np.int64),) * 3
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=queries.num_rows))))
    items = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(dst, pa.int64())], ["dist", "dst"])
    return pa.table({"src": queries["did"], "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)})


def _assign_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            d = np.sqrt(_distances(np.stack(pdf["v"].to_numpy()), shared.value))
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(pdf)), cell])

    return shipped(points).mapInPandas(assign, "did bigint, g string, v array<double>, cell int, r double")


def _meeting(stats: pd.DataFrame, near: pd.DataFrame, pivots: np.ndarray, k: int) -> np.ndarray:
    """Of one group, by cell: whether a query cell's rows may have a neighbour in a candidate cell."""
    ids, radius = stats["cell"].to_numpy(), stats["r_max"].to_numpy()
    gap = np.sqrt(_distances(pivots, pivots))
    slack = 1e-6 * (1.0 + gap.max())
    out = np.zeros((len(pivots), len(pivots)), bool)
    close, r = near["cell"].to_numpy(), near["r"].to_numpy()
    for i, ri in zip(ids, radius):
        bound = np.partition(gap[i, close] + r, k - 1)[k - 1] + ri if len(close) >= k else np.inf
        out[i, ids] = gap[i, ids] - ri - radius <= bound + slack
    return out


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Place of each pivot in a walk from each to the nearest one not visited yet."""
    gap = _distances(pivots, pivots)
    place, at, left = np.zeros(len(pivots), np.int64), 0, np.ones(len(pivots), bool)
    for step in range(len(pivots)):
        place[at], left[at] = step, False
        at = int(np.where(left, gap[at], np.inf).argmin())
    return place


def _blocks(cells: pd.DataFrame, most: int) -> list[tuple[int, int, int]]:
    """(cell, first block, number of blocks) for cells in their order: short ones share a block of at most
    `most` rows, a longer one has several of its own."""
    out, block, held = [], -1, most
    for cell, n in zip(cells["cell"], cells["n"]):
        parts = -(-int(n) // most)
        if parts > 1:
            out.append((int(cell), block + 1, parts))
            block, held = block + parts, most
        else:
            if held + n > most:
                block, held = block + 1, 0
            out.append((int(cell), block, 1))
            held += n
    return out


def knn(
    df: DataFrame, id: str, vec: str, k: int, by: str | None = None, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Directed edges (src, dst, rank 1..k, dist): Euclidean, self left out by id, ties by id.

    With `by`, neighbours are searched inside each group only. `id` must be a unique bigint.
    """
    group = F.col(by).cast("string") if by else F.lit("")
    pts = df.select(F.col(id).cast("bigint").alias("src"), group.alias("g"), doubles(F.col(vec)).alias("v"))
    # copies of a vector: any query needs at most its k + 1 smallest ids
    copies = pts.withColumn("_n", F.row_number().over(Window.partitionBy("g", "v").orderBy("src"))).where(F.col("_n") <= k + 1)
    distinct = materialize(copies.groupBy("g", "v").agg(F.array_sort(F.collect_list("src")).alias("ids")).select(F.col("ids")[0].alias("did"), "g", "v", "ids"))
    vectors = distinct.select("did", "g", "v")
    n = vectors.count()
    if not n:
        return df.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, dist double")
    kk = k + 1
    cells = min(MAX_PIVOTS, -(-n // rows_per_chunk))
    if cells <= 1:
        pivots = np.zeros((1, len(vectors.first()["v"])))
        placed = vectors.withColumn("cell", F.lit(0)).withColumn("r", F.lit(0.0))
    else:
        sample = vectors.orderBy(F.xxhash64("did"), "did").limit(cells).select("v").toPandas()
        pivots = np.unique(np.stack(sample["v"].to_numpy()), axis=0)
        placed = materialize(_assign_cells(vectors, pivots))
    stats = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r_max")).toPandas()
    first = Window.partitionBy("g", "cell").orderBy("r", "did")
    near = placed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= kk).select("g", "cell", "r").toPandas() if cells > 1 else pd.DataFrame({"g": [], "cell": [], "r": []})
    spark = df.sparkSession
    order = _chain(pivots)
    work = stats.groupby("g")["n"].sum().astype(float) ** 2
    units = min(UNITS, max(1.0, work.sum() / (2.0 * rows_per_chunk**2)))
    places, pairs, meets = [], [], {}
    for g, mine in stats.groupby("g"):
        mine = mine.iloc[np.argsort(order[mine["cell"].to_numpy()])]
        rows, share = int(mine["n"].sum()), max(1.0, units * work[g] / work.sum())
        most = max(rows_per_chunk, 1) * CHUNKS_A_BLOCK
        many, few = (min(most, -(-rows // max(1, round(x)))) for x in (share**0.5 * WIDER, share**0.5 / WIDER))
        q_block, c_block = _blocks(mine, many), _blocks(mine, few)
        places += [(g, cell, qb, qn, cb, cn) for (cell, qb, qn), (_, cb, cn) in zip(q_block, c_block)]
        meet = _meeting(mine, near[near["g"] == g], pivots, kk) if len(mine) > 1 else None
        met = {(i, j) for cell, qb, qn in q_block for other, cb, cn in c_block if meet is None or meet[cell, other] for i in range(qb, qb + qn) for j in range(cb, cb + cn)}
        pairs += [(g, i, j) for i, j in met]
        if meet is not None and not meet[np.ix_(mine["cell"], mine["cell"])].all():
            meets[g] = meet
    place = F.broadcast(spark.createDataFrame(places, "g string, cell int, qb int, qn int, cb int, cn int"))
    pair = F.broadcast(spark.createDataFrame(pairs, "g string, qb int, cb int"))
    # a query goes to every block of candidates that may hold its neighbours, and the other way round
    part = lambda first, parts: (F.col(first) + F.pmod(F.xxhash64("did"), F.col(parts))).cast("int")
    dealt = placed.join(place, ["g", "cell"]).select("did", "v", "g", "cell", part("qb", "qn").alias("qb"), part("cb", "cn").alias("cb"))
    q = dealt.drop("cb").join(pair, ["g", "qb"])
    c = dealt.drop("qb").join(pair, ["g", "cb"]).select(F.col("did").alias("cid"), F.col("v").alias("cv"), F.col("cell").alias("ccell"), F.col("g").alias("cg"), F.col("qb").alias("cqb"), F.col("cb").alias("ccb"))
    shared = spark.sparkContext.broadcast(meets)
    found = shipped(q).groupBy("g", "qb", "cb").cogroup(c.groupBy("cg", "cqb", "ccb")).applyInArrow(
        lambda key, a, b: _unit(a, b, shared.value.get(key[0].as_py()), kk), "src bigint, near array<struct<dist:double,dst:bigint>>"
    )
    best = found.groupBy("src").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, kk).alias("near"))
    # back from distinct vectors to entities
    ids = distinct.select(F.col("did").alias("dst"), "ids")
    one = best.select("src", F.explode("near").alias("e")).select("src", "e.dst", "e.dist")
    spread = one.join(ids, "dst").select("src", F.explode("ids").alias("dst"), "dist")
    listed = spread.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "dst"))), 1, kk).alias("near"))
    owners = distinct.select("g", "v", F.col("did").alias("did"))
    entity = pts.join(owners, ["g", "v"]).select("src", "did").join(listed.withColumnRenamed("src", "did"), "did")
    others = F.slice(F.filter("near", lambda e: e["dst"] != F.col("src")), 1, k)
    return entity.select("src", F.posexplode(others).alias("_p", "e")).select(
        "src", F.col("e.dst").alias("dst"), (F.col("_p") + 1).alias("rank"), F.col("e.dist").alias("dist")
    )


# ---------------------------------------------------------------- label mixing
def label_edges(edges: DataFrame, labels: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    """Edges with src_<c> and dst_<c> of each endpoint."""
    s = labels.select(F.col(id).alias("src"), *[F.col(c).alias(f"src_{c}") for c in cols])
    d = labels.select(F.col(id).alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in cols])
    return edges.join(s, "src").join(d, "dst")


def batch_mixing(df: DataFrame, id: str, vec: str, label: str, batch: str, k: int, min_rows: int = 10) -> DataFrame:
    """Share of same-label neighbours from another batch, over the share chance would give.

    Labels with under `min_rows` entities or one batch are left out; k shrinks to n - 1.
    """
    sizes = df.groupBy(label, batch).agg(F.count(F.lit(1)).alias("c"))
    labels = sizes.groupBy(label).agg(
        F.sum("c").alias("n_entities"), F.count(F.lit(1)).alias("n_batches"), (1 - F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("expected_fraction")
    ).where((F.col("n_entities") >= min_rows) & (F.col("n_batches") >= 2))
    edges = label_edges(knn(df.join(labels.select(label), label, "left_semi"), id, vec, k, label), df, id, [label, batch])
    seen = edges.groupBy(F.col(f"src_{label}").alias(label)).agg(F.avg((F.col(f"src_{batch}") != F.col(f"dst_{batch}")).cast("int")).alias("observed_fraction"))
    return labels.join(seen, label).select(
        label, "n_entities", "n_batches", "observed_fraction", "expected_fraction",
        F.when(F.col("expected_fraction") > 0, F.col("observed_fraction") / F.col("expected_fraction")).alias("normalized_mixing"),
    )


def connectivity(edges: DataFrame, labels: DataFrame, id: str, label: str) -> DataFrame:
    """Per (source, target) label: neighbour slots, their share, share over abundance."""
    total = labels.agg(F.count(F.lit(1)).alias("_n"))
    share = labels.groupBy(F.col(label).alias("target")).agg(F.count(F.lit(1)).alias("_t")).crossJoin(F.broadcast(total)).select("target", (F.col("_t") / F.col("_n")).alias("_share"))
    counts = label_edges(edges, labels, id, [label]).groupBy(F.col(f"src_{label}").alias("source"), F.col(f"dst_{label}").alias("target")).agg(F.count(F.lit(1)).alias("n_edges"))
    w = Window.partitionBy("source")  # one row per target label
    return counts.withColumn("fraction", F.col("n_edges") / F.sum("n_edges").over(w)).join(share, "target").select(
        "source", "target", "n_edges", "fraction", (F.col("fraction") / F.col("_share")).alias("enrichment")
    )


def continuity_decision(conn: DataFrame, first: str, middle: str, last: str, min_off: float = 0.20, max_self: float = 0.60) -> DataFrame:
    """Is the middle label mixed with both flanks and not dominated by itself?"""
    at = lambda t: F.coalesce(F.max(F.when((F.col("source") == middle) & (F.col("target") == t), F.col("fraction"))), F.lit(0.0))
    return conn.agg(at(first).alias("to_first"), at(middle).alias("to_self"), at(last).alias("to_last")).withColumn(
        "continuous", (F.col("to_first") >= min_off) & (F.col("to_last") >= min_off) & (F.col("to_self") <= max_self)
    )


def branch_metrics(edges: DataFrame, labels: DataFrame, id: str, label: str, vec: str, dims: int, states: Sequence[str]) -> DataFrame:
    """Continuity of a three-label branch: cross, adjacent and bypass shares, bridges, centroids."""
    a, b, c = states
    e = label_edges(edges, labels, id, [label])
    s, t = F.col(f"src_{label}"), F.col(f"dst_{label}")
    n = lambda x, y: F.count_if((s == x) & (t == y)).cast("double")
    row = lambda x: F.count_if(s == x)
    cross = F.count_if(s != t)
    adj = n(a, b) + n(b, a) + n(b, c) + n(c, b)
    byp = n(a, c) + n(c, a)
    shares = e.agg(
        (cross / F.count(F.lit(1))).alias("cross_fraction"),
        F.when(cross > 0, adj / cross).alias("adjacent_of_cross"),
        F.when(cross > 0, byp / cross).alias("bypass_of_cross"),
        F.try_divide(n(a, b), row(a)).alias("first_to_middle"),
        F.try_divide(n(b, c), row(b)).alias("middle_to_last"),
        F.try_divide(n(c, b), row(c)).alias("last_to_middle"),
    ).withColumn("min_bridge", F.least("first_to_middle", "middle_to_last", "last_to_middle"))
    cent = labels.groupBy(label).agg(mean_vector(doubles(F.col(vec)), dims).alias("m"))
    pick = lambda x: F.max(F.when(F.col(label) == x, F.col("m")))
    d = cent.agg(pick(a).alias("ca"), pick(b).alias("cb"), pick(c).alias("cc")).select(
        distance(F.col("ca"), F.col("cb")).alias("d_first_middle"), distance(F.col("cb"), F.col("cc")).alias("d_middle_last"), distance(F.col("ca"), F.col("cc")).alias("d_first_last")
    )
    both = shares.crossJoin(d)  # one row each
    reach = F.col("d_first_middle") + F.col("d_middle_last")
    return both.withColumn("endpoint_largest", (F.col("d_first_last") >= F.col("d_first_middle")) & (F.col("d_first_last") >= F.col("d_middle_last"))).withColumn(
        "chain_ratio", F.when(reach > 0, F.col("d_first_last") / reach)
    )


# ------------------------------------------------------------------- components
def components(edges: DataFrame, vertices: DataFrame, id: str) -> DataFrame:
    """(id, component): smallest id of each connected component, by alternating star joins
    (Kiveris et al. 2014). Each half round is a minimum per vertex and one join, so a vertex of
    any degree is pre-aggregated, never listed; rounds grow with the logarithm of the size."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("w")).where("u <> w")
    cur = materialize(both.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct())
    while True:
        sym = cur.unionByName(cur.select(F.col("w").alias("u"), F.col("u").alias("w")))
        low = sym.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = sym.join(low, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        down = large.groupBy("u").agg(F.min("w").alias("m"))
        linked = large.join(down, "u")
        small = linked.select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").unionByName(down.select("u", F.col("m").alias("w"))).distinct()
        new = materialize(small.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).where("u <> w").distinct())
        same = new.count() == cur.count() and new.join(cur, ["u", "w"], "left_anti").limit(1).count() == 0
        cur = new
        if same:
            break
    return vertices.select(F.col(id)).join(cur.withColumnsRenamed({"u": id, "w": "component"}), id, "left").withColumn("component", F.coalesce("component", F.col(id)))


# -------------------------------------------------------------------- coherence
def random_pairs(entities: DataFrame, id: str, n: int, pairs: int, seed: int, rk: str = "rk") -> DataFrame:
    """(pair, a, b): ids at hash-drawn ranks, repeats allowed. `entities` carries dense ranks."""
    spark = entities.sparkSession
    draw = spark.range(pairs).select(
        F.col("id").alias("pair"), F.pmod(hash60(seed, F.lit("a"), F.col("id")), F.lit(n)).alias("_a"), F.pmod(hash60(seed, F.lit("b"), F.col("id")), F.lit(n)).alias("_b")
    )
    at = entities.select(F.col(rk), F.col(id))
    return draw.join(at.withColumnsRenamed({rk: "_a", id: "a"}), "_a").join(at.withColumnsRenamed({rk: "_b", id: "b"}), "_b").select("pair", "a", "b")


def edge_smoothness(edges: DataFrame, entities: DataFrame, id: str, clock: str, pairs: DataFrame) -> DataFrame:
    """Median clock difference over edges against over random pairs."""
    t = lambda e, s, d, name: e.join(entities.select(F.col(id).alias(s), F.col(clock).alias("_s")), s).join(entities.select(F.col(id).alias(d), F.col(clock).alias("_d")), d).select(F.lit(name).alias("kind"), F.abs(F.col("_s") - F.col("_d")).alias("gap"))
    both = t(edges, "src", "dst", "edge").unionByName(t(pairs, "a", "b", "random"))
    q = quantiles(both, ["kind"], "gap", {"m": 0.5})
    pick = lambda n: F.max(F.when(F.col("kind") == n, F.col("m")))
    return q.agg(pick("edge").alias("edge_median"), pick("random").alias("random_median")).withColumn(
        "ratio", F.when(F.col("random_median") > 0, F.col("edge_median") / F.col("random_median"))
    )


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def clock_permutations(entities: DataFrame, id: str, clock: str, n: int, permutations: int, seed: int) -> DataFrame:
    """(id, clocks): the clock dealt anew to the entities, each value used once, as an array by permutation."""
    by_rank = rank_rows(entities.select(id, clock), [id], (), "_r")
    order = by_rank.select(F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"), id, clock)
    order = rank_rows(order.withColumn("_h", hash60(seed, F.col("perm"), F.col(id))), ["_h", id], ["perm"], "_r")
    dealt = order.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("perm", F.col(clock).alias("c")))).alias("_d"))  # one value a permutation
    return dealt.join(by_rank.select("_r", id), "_r").select(id, F.transform("_d", lambda d: d["c"]).alias("clocks"))


def neighbor_coherence(edges: DataFrame, entities: DataFrame, id: str, clock: str, permuted: DataFrame, permutations: int) -> DataFrame:
    """Mean clock difference of neighbours over the mean after permuting the clock: an edge meets the arrays of
    `clock_permutations` of its ends once, whatever the number of permutations."""
    def ends(values: DataFrame, col: str) -> DataFrame:
        s, d = (values.select(F.col(id).alias(side), F.col(col).alias(f"_{side}")) for side in ("src", "dst"))
        return edges.select("src", "dst").join(s, "src").join(d, "dst")

    obs = ends(entities, clock).agg(F.avg(F.abs(F.col("_src") - F.col("_dst"))).alias("observed_mean"))
    gaps = F.array(*[F.avg(F.abs(F.col("_src")[i] - F.col("_dst")[i])) for i in range(permutations)])
    rnd = ends(permuted, "clocks").agg(gaps.alias("_g")).select(F.explode("_g").alias("gap")).agg(F.avg("gap").alias("random_mean"))
    return obs.crossJoin(rnd).withColumn("ratio", F.when(F.col("random_mean") > 0, F.col("observed_mean") / F.col("random_mean")))


def order_coherence(entities: DataFrame, id: str, clock: str, vec: str, n: int, permutations: int, seed: int) -> DataFrame:
    """Median distance between consecutive entities along the clock over the median of the same
    along random orders, with the 2.5 and 97.5 % points of the random medians."""
    base = entities.select(id, clock, doubles(F.col(vec)).alias("_v"))
    row = rank_rows(base, [clock, id], (), "_row")  # orders are made of row numbers; vectors meet pairs of them
    observed = row.select(F.lit(-1).alias("perm"), F.col("_row").alias("_k"), "_row")
    rnd = row.select(F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"), id, "_row")
    rnd = rank_rows(rnd.withColumn("_h", hash60(seed, F.col("perm"), F.col(id))), ["_h", id, "_row"], ["perm"], "_k")
    near = neighbors(observed.unionByName(rnd.select("perm", "_k", "_row")), ["perm"], "_k", ["_row"]).where(F.col("prev__row").isNotNull())
    at = lambda name, vector: row.select(F.col("_row").alias(name), F.col("_v").alias(vector))
    steps = near.select("perm", "_row", "prev__row").join(at("_row", "_v"), "_row").join(at("prev__row", "prev__v"), "prev__row")
    med = quantiles(steps.select("perm", distance(F.col("_v"), F.col("prev__v")).alias("d")), ["perm"], "d", {"m": 0.5})
    obs = med.where("perm = -1").select(F.col("m").alias("observed_median"))
    q = quantiles(med.where("perm >= 0"), [], "m", {"random_median": 0.5, "random_low": 0.025, "random_high": 0.975})
    return obs.crossJoin(q).withColumn("ratio", F.when(F.col("random_median") > 0, F.col("observed_median") / F.col("random_median")))


# ------------------------------------------------------------------- silhouette
MAX_LABELS = 10_000  # labels whose sums are compared with every entity


def silhouette(df: DataFrame, id: str, vec: str, label: str) -> DataFrame:
    """Mean silhouette over all entities, with squared Euclidean distances.

    The mean squared distance from x to a label is |x|^2 - 2 x . S / n + Q / n with the label's count n,
    vector sum S and sum of squares Q, so one small row per label replaces the pairs. Labels with a single
    entity are left out; the number of labels is checked before their sums are sent to the tasks.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), doubles(F.col(vec)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dims = rows.select(F.size("v").alias("d")).first()
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("q"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dims["d"] if dims else 1)]).alias("s")).where("n >= 2")
    sums = materialize(sums)
    n_labels = sums.count()
    if n_labels > MAX_LABELS:
        raise ValueError("too many labels for a silhouette")
    if n_labels < 2:
        return rows.join(sums.select("label"), "label", "left_semi").agg(F.count(F.lit(1)).alias("n_scored"), F.lit(n_labels).cast("bigint").alias("n_labels"), F.lit(None).cast("double").alias("silhouette"))
    one = F.broadcast(sums.agg(F.collect_list(F.struct("label", "n", "q", "s")).alias("all")))  # one bounded row
    dot = lambda s: F.aggregate(F.zip_with("v", s, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    far = lambda g: g["n"] * square - 2 * dot(g["s"]) + g["q"]
    own = F.filter("all", lambda g: g["label"] == F.col("label"))[0]
    near = F.array_min(F.transform(F.filter("all", lambda g: g["label"] != F.col("label")), lambda g: far(g) / g["n"]))
    held = rows.join(sums.select("label"), "label", "left_semi").crossJoin(one)
    scored = held.select((far(own) / (own["n"] - 1)).alias("a"), near.alias("b"))
    top = F.greatest("a", "b")
    return scored.agg(F.count(F.lit(1)).alias("n_scored"), F.lit(n_labels).cast("bigint").alias("n_labels"), F.avg(F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)).alias("silhouette"))


def _distance_sums(q: np.ndarray, c: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Per query and column of the 0/1 matrix `member` (one row a candidate): the summed distances to its members.
    Pairs so close that the matrix product cancels are measured by direct differences."""
    out = np.zeros((len(q), member.shape[1]))
    square = (c * c).sum(1)
    for lo in range(0, len(q), QUERIES_AT_ONCE):
        block = q[lo : lo + QUERIES_AT_ONCE]
        own = (block * block).sum(1)
        for at in range(0, len(c), CANDIDATES_AT_ONCE):
            part = c[at : at + CANDIDATES_AT_ONCE]
            sq = block @ part.T
            sq *= -2.0
            sq += own[:, None]
            sq += square[None, at : at + len(part)]
            r, j = np.nonzero(sq <= 1e-6 * (own[:, None] + 1.0))
            for few in range(0, len(r), CANDIDATES_AT_ONCE):
                a, b = r[few : few + CANDIDATES_AT_ONCE], j[few : few + CANDIDATES_AT_ONCE]
                sq[a, b] = ((part[b] - block[a]) ** 2).sum(1)
            out[lo : lo + len(block)] += np.sqrt(sq, out=sq) @ member[at : at + len(part)]
    return out


def plain_silhouettes(df: DataFrame, vec: str, labels: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> dict[str, float | None]:
    """Mean silhouette over all entities by each label column, with plain Euclidean distances.

    Every pair is measured, once for all label columns: two bounded blocks of rows meet in a unit of work, which
    returns a row's summed distances to each label. Rows without a label or with a missing coordinate and labels
    of a single row are left out; NULL under two labels. The number of labels is checked before their sums are made.
    """
    whole = F.col(vec).isNotNull() & ~F.exists(doubles(F.col(vec)), lambda c: c.isNull() | F.isnan(c))
    rows = materialize(df.where(whole).select(F.monotonically_increasing_id().alias("row"), doubles(F.col(vec)).alias("v"), *[F.col(l).cast("string").alias(f"l{i}") for i, l in enumerate(labels)]))
    n = rows.count()
    sizes: list[dict[str, int]] = []
    for i in range(len(labels)):
        held = rows.groupBy(f"l{i}").count().where(F.col(f"l{i}").isNotNull() & (F.col("count") >= 2)).limit(MAX_LEVELS + 1).collect()
        if len(held) > MAX_LEVELS:
            raise ValueError("too many labels for a silhouette")
        sizes.append({r[0]: r["count"] for r in held} if len(held) > 1 else {})
    columns = {(i, l): at for at, (i, l) in enumerate((i, l) for i, of in enumerate(sizes) for l in sorted(of))}
    if not columns:
        return dict.fromkeys(labels)
    units = min(UNITS, max(1.0, n**2 / (2.0 * rows_per_chunk**2)))
    blocks = max(round(units**0.5), -(-n // (rows_per_chunk * CHUNKS_A_BLOCK)))
    own, every = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    marks = [f"l{i}" for i in range(len(labels))]
    q = rows.select("row", "v", own.alias("qb"), every.alias("cb"))
    c = rows.select(F.col("v").alias("cv"), *marks, own.alias("ccb"), every.alias("cqb"))

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        got = np.zeros((a.num_rows, len(columns)))
        if a.num_rows and b.num_rows:
            member = np.zeros((b.num_rows, len(columns)))
            for i, l in enumerate(marks):
                code = np.array([columns.get((i, x), -1) for x in b[l].to_pylist()])
                member[np.flatnonzero(code >= 0), code[code >= 0]] = 1.0
            got = _distance_sums(_matrix(a["v"]), _matrix(b["cv"]), member)
        ends = np.arange(a.num_rows + 1, dtype=np.int32) * len(columns)
        return pa.table({"row": a["row"], "s": pa.ListArray.from_arrays(pa.array(ends), pa.array(got.ravel()))})

    found = shipped(q).groupBy("qb", "cb").cogroup(c.groupBy("cqb", "ccb")).applyInArrow(unit, "row bigint, s array<double>")
    sums = found.groupBy("row").agg(*[F.sum(F.col("s")[at]).alias(f"s{at}") for at in range(len(columns))]).join(rows.drop("v"), "row")
    means = []
    for i, of in enumerate(sizes):
        at = {l: F.col(f"s{columns[i, l]}") for l in of}
        inside = F.coalesce(*[F.when(F.col(f"l{i}") == l, at[l] / (of[l] - 1)) for l in of]) if of else F.lit(None).cast("double")
        outside = F.least(*[F.when(F.col(f"l{i}") != l, at[l] / of[l]) for l in of]) if of else F.lit(None).cast("double")
        top = F.greatest(inside, outside)
        means.append(F.avg(F.when(inside.isNotNull(), F.when(top > 0, (outside - inside) / top).otherwise(0.0))).alias(f"m{i}"))
    got = sums.agg(*means).first()
    return {l: got[f"m{i}"] for i, l in enumerate(labels)}
