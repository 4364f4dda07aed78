"""Order keys: diffusion distance from a root over the neighbour graph, and audits of the order.

The graph lives in an edge table and the vectors in an entity table. Eigenvectors come from a
thick-restart block Lanczos iteration over blocks of rows in the shared folder (`blocks`); the driver
sees nothing larger than the Gram matrix of the iteration's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import hash60
from ..session import materialize, shipped
from .blocks import Blocks
from .knn import components, knn

# Eigenvalue above which a direction counts as stationary, components kept.
STATIONARY = 0.9994
COMPONENTS = 15
CLOCK_COMPONENTS = 10
BLOCK_VECTORS = 6
KRYLOV_STEPS = 9
RESIDUAL = 1e-6
MAX_CYCLES = 40
# Fixed values of the fuzzy kernel: halvings of the bandwidth's bracket, its least share of the mean distance.
HALVINGS = 60
LEAST_WIDTH = 1e-3


def gauss_graph(edges: DataFrame) -> DataFrame:
    """Symmetric weights (src, dst, w) with a local width of half the distance to the last
    neighbour; an edge found from one side only is mirrored."""
    width = edges.groupBy("src").agg((F.max("dist") * F.max("dist") / 4).alias("s2"))
    e = edges.join(width, "src").join(width.select(F.col("src").alias("dst"), F.col("s2").alias("t2")), "dst")
    den = F.col("s2") + F.col("t2")
    w = F.when(den > 0, F.sqrt(2 * F.sqrt(F.col("s2") * F.col("t2")) / den) * F.exp(-F.col("dist") * F.col("dist") / den)).otherwise(1.0)
    one = e.select("src", "dst", w.alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def _bandwidths(dist: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(offset, width) of rows of ascending distances to the k - 1 other neighbours: memberships
    exp(-(d - offset) / width) of a row add up to log2(k), by bisection.

    The offset is the least positive distance. The bracket's upper end is the width at which even the
    farthest neighbour alone, counted k - 1 times, would reach the sum."""
    m = dist.shape[1]
    target = np.log2(m + 1)
    offset = np.where(dist > 0, dist, np.inf).min(1)
    offset[~np.isfinite(offset)] = 0.0
    over = np.maximum(dist - offset[:, None], 0.0)
    width, step = np.zeros(len(dist)), over.max(1) / np.log(m / target) if m > target else np.zeros(len(dist))
    for _ in range(HALVINGS):
        step = step / 2
        wider = width + step
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(over > 0, np.exp(-over / wider[:, None]), 1.0).sum(1)
        width = np.where((total < target) & (step > 0), wider, width)
    least = LEAST_WIDTH * np.where(offset > 0, dist.sum(1) / (m + 1), mean)
    return offset, np.maximum(width, least)


def memberships(edges: DataFrame) -> DataFrame:
    """Directed fuzzy memberships (src, dst, w) of neighbour lists (McInnes, Healy, Melville 2018).

    Each source's bandwidth is found from its own list, whose length is bounded by k; lists of one
    length are searched together. Where every neighbour lies at distance zero all memberships are one."""
    mean = edges.agg((F.sum("dist") / (F.count(F.lit(1)) + F.countDistinct("src"))).alias("m")).first()["m"] or 0.0
    lists = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))

    def widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.array([e["dist"] for e in near]) for near in pdf["near"]]
            sizes = np.array([len(r) for r in rows])
            offset, width = np.zeros(len(pdf)), np.zeros(len(pdf))
            for m in np.unique(sizes):
                at = np.flatnonzero(sizes == m)
                offset[at], width[at] = _bandwidths(np.stack([rows[i] for i in at]), mean)
            yield pdf.assign(offset=offset, width=width)

    kind = edges.schema
    near = f"array<struct<dist:double,dst:{kind['dst'].dataType.simpleString()}>>"
    found = shipped(lists).mapInPandas(widths, f"src {kind['src'].dataType.simpleString()}, near {near}, offset double, width double")
    over = F.col("e.dist") - F.col("offset")
    return found.select("src", "offset", "width", F.explode("near").alias("e")).select(
        "src", F.col("e.dst").alias("dst"), F.when((over <= 0) | (F.col("width") <= 0), 1.0).otherwise(F.exp(-over / F.col("width"))).alias("w")
    )


def fuzzy_graph(edges: DataFrame) -> DataFrame:
    """Symmetric weights (src, dst, w): the probabilistic union a + b - ab of both directions."""
    one = memberships(edges)
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # of two directions the product is left out once; of one direction it is zero
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


KERNELS = {"gauss": gauss_graph, "fuzzy": fuzzy_graph}


def transitions(graph: DataFrame) -> DataFrame:
    """Density-normalised symmetric transition matrix as edges (src, dst, t)."""
    q = graph.groupBy(F.col("dst").alias("v")).agg(F.sum("w").alias("q"))
    k = graph.join(q.withColumnsRenamed({"v": "src", "q": "qs"}), "src").join(q.withColumnsRenamed({"v": "dst", "q": "qd"}), "dst")
    k = k.select("src", "dst", (F.col("w") / (F.col("qs") * F.col("qd"))).alias("k"))
    z = k.groupBy(F.col("dst").alias("v")).agg(F.sqrt(F.sum("k")).alias("z"))
    t = k.join(z.withColumnsRenamed({"v": "src", "z": "zs"}), "src").join(z.withColumnsRenamed({"v": "dst", "z": "zd"}), "dst")
    return t.select("src", "dst", (F.col("k") / (F.col("zs") * F.col("zd"))).alias("t"))


def _ritz(gram: np.ndarray, proj: np.ndarray, images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, mixes as columns, residual norms), largest value first, of a basis with Gram matrix
    `gram`, its products with its images, and the images' own Gram matrix."""
    s, u = np.linalg.eigh((gram + gram.T) / 2)
    good = s > 1e-12 * s.max()
    white = u[:, good] / np.sqrt(s[good])
    values, w = np.linalg.eigh(white.T @ ((proj + proj.T) / 2) @ white)
    order = np.argsort(-values)
    values, mix = values[order], white @ w[:, order]
    square = np.einsum("ij,ij->j", mix, images @ mix) - 2 * values * np.einsum("ij,ij->j", mix, proj @ mix) + values**2 * np.einsum("ij,ij->j", mix, gram @ mix)
    return values, mix, np.sqrt(np.maximum(square, 0.0))


def leading_vectors(
    t: DataFrame, k: int, seed: int, block: int = BLOCK_VECTORS, steps: int = KRYLOV_STEPS, residual: float = RESIDUAL, cycles: int = MAX_CYCLES
) -> tuple[np.ndarray, DataFrame]:
    """Largest eigenvalues and unit eigenvectors (v, psi) of the symmetric edge matrix.

    Thick-restart block Lanczos: every vector of the basis keeps its image under the matrix, so a step
    multiplies one block only. After `steps` blocks the best Ritz vectors, their images and the next
    block go on; those that have converged stay in the basis and are never multiplied again. It ends
    when each of the `k` has |T psi - lambda psi| <= `residual`, or the space is exhausted; otherwise
    after `cycles` restarts it raises."""
    b = max(1, min(block, k))
    rows = Blocks(t, lambda v: F.array(*[F.lit(2.0) * hash60(seed, v, i) / F.lit(2.0**60) - 1.0 for i in range(b)]))
    try:
        values, psi, left = rows.iterate(lambda rows: _lanczos(rows, k, b, block, steps, residual, cycles))
        if psi is None:
            raise RuntimeError(f"eigenvectors have residuals up to {left:.3g} after {cycles} cycles, more than {residual:g}")
        return values, rows.frame(psi, "psi")
    finally:
        rows.close()


def _lanczos(rows: Blocks, k: int, width: int, block: int, steps: int, residual: float, cycles: int) -> tuple[np.ndarray, list[str] | None, float]:
    """(values, vectors as a column of `rows`, largest residual) from the `width` columns it starts with; no vectors
    where `cycles` did not suffice."""
    basis, image, last, total = [], [], rows.start, 0
    for _ in range(cycles):
        live = True
        for _ in range(steps):
            y, g = rows.multiply(basis, last, width)
            basis, image, total = [*basis, last], [*image, y], total + width
            # the next block: the newest images orthogonalised against everything so far, then inside
            gb, gy, gyy = g[:total, :total], g[:total, total:], g[total:, total:]
            proj = np.linalg.pinv(gb, rcond=1e-14, hermitian=True) @ gy
            rest = gyy - gy.T @ proj
            val, vec = np.linalg.eigh((rest + rest.T) / 2)
            keep = val > 1e-13 * max(1e-300, np.trace(gyy))
            if not keep.any():
                live = False
                break
            mix = vec[:, keep] / np.sqrt(val[keep])
            width = mix.shape[1]
            [last] = rows.combine([*basis, y], np.vstack([-proj @ mix, mix]))
        g = rows.gram([*basis, *image])
        values, mix, left = _ritz(g[:total, :total], g[:total, total:], g[total:, total:])
        wanted = min(k, len(values))
        if not live or (len(values) >= k and left[:wanted].max() <= residual):
            return values[:wanted], rows.combine(basis, mix[:, :wanted])[0], left[:wanted].max()
        held = min(len(values), k + block)
        cut, none = mix[:, :held], np.zeros((total, held))
        kept = rows.combine([*basis, *image], np.vstack([cut, none]), np.vstack([none, cut]))
        rows.drop([*basis, *image])
        basis, image, total = [kept[0]], [kept[1]], held
    return values[:wanted], None, left[:wanted].max()


def diffusion_clock(
    df: DataFrame, id: str, vec: str, root: int, k: int, n_components: int = COMPONENTS, n_clock: int = CLOCK_COMPONENTS, seed: int = 785, kernel: str = "gauss", residual: float = RESIDUAL,
    edges: DataFrame | None = None, parts: DataFrame | None = None,
) -> DataFrame:
    """(id, component, clock): diffusion distance to the root, scaled to at most 1 (Coifman &
    Lafon 2006; Haghverdi et al. 2016). Entities in another component than the root get NULL.

    `k` counts the entity itself, as the graph builders of the field do. `kernel` weighs the graph: a
    Gaussian of local width, or fuzzy memberships. Several clocks may share `edges`, the stored lists of
    at least k - 1 neighbours: longer lists begin with the shorter ones; clocks of one `k` also `parts`, the stored
    (id, component) of those lists, which no kernel changes.
    """
    near = materialize(knn(df, id, vec, k - 1)) if edges is None else edges.where(F.col("rank") < k)
    graph = materialize(KERNELS[kernel](near))
    comp = materialize(components(near, df, id)) if parts is None else parts
    home = comp.where(F.col(id) == root).select("component").first()["component"]
    inside = comp.where(F.col("component") == home).select(F.col(id).alias("src"))
    t = materialize(transitions(graph.join(inside, "src", "left_semi")))
    values, psi = leading_vectors(t, n_components, seed, residual=residual)
    lam = values[:n_clock]
    scale = np.where(lam < STATIONARY, lam / (1 - np.minimum(lam, STATIONARY)), 1.0)
    at_root = np.array(psi.where(F.col("v") == root).first()["psi"])[: len(lam)]
    gap = sum(((F.col("psi")[i] - float(at_root[i])) * float(scale[i])) ** 2 for i in range(len(lam)))
    dist = psi.select(F.col("v").alias(id), F.sqrt(gap).alias("_d"))
    top = dist.agg(F.max("_d").alias("_top"))
    return comp.join(dist.crossJoin(F.broadcast(top)).select(id, F.when(F.col("_top") > 0, F.col("_d") / F.col("_top")).otherwise(0.0).alias("clock")), id, "left")


# ----------------------------------------------------------------- order audits
def connected_fraction(clocked: DataFrame, clock: str = "clock") -> DataFrame:
    return clocked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(clock).isNotNull().cast("int")).alias("connected_fraction"))


def order_audit(medians: DataFrame, label: str, median: str, order: Sequence[str]) -> DataFrame:
    """How many consecutive labels of the prescribed order have increasing medians."""
    place = F.array_position(F.array(*[F.lit(l) for l in order]), F.col(label).cast("string"))
    w = Window.partitionBy(F.lit(0)).orderBy("place")  # one row per label
    steps = medians.select(place.alias("place"), F.col(median).alias("m")).where("place > 0").withColumn("next", F.lead("m").over(w)).where(F.col("next").isNotNull())
    return steps.agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("next") > F.col("m")).alias("n_increasing"))


def ordering_table(probabilities: DataFrame, adjacent: float = 0.60, endpoint: float = 0.80) -> DataFrame:
    """Dominance probabilities with the limit that applies to adjacent and to outer pairs."""
    limit = F.when(F.col("steps") == 1, F.lit(adjacent)).otherwise(F.lit(endpoint))
    return probabilities.select(
        "a", "b", F.when(F.col("steps") == 1, "adjacent").otherwise("endpoint").alias("kind"), "probability", limit.alias("threshold"),
        (F.col("probability") >= limit).alias("passes"),
    )
