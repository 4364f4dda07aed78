"""Queries on vectors of both modalities: neighbours, graph order, clocks, change along a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..functions.vectors import doubles
from ..operators import clock as ck, energy, knn, representation as rep, report, stats, windows as win
from ..operators.ordered import rank_rows
from ..session import materialize
from . import tables as T
from .catalog import query

K = 30
PERMS = 100
SMALL = win.Design("50/10", 50, 10)  # the vector table has a few hundred rows


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


_PAIRS = "pr AS (SELECT x.id AS src, y.id AS dst, sqrt(list_sum(list_transform(range(1, 33), lambda i: (x.{v}[i] - y.{v}[i]) * (x.{v}[i] - y.{v}[i])))) AS dist FROM vectors x JOIN vectors y ON x.id <> y.id {on})"
_EDGES = f"{T.VECTORS}, {_PAIRS.format(v='va', on='')}, edges AS (SELECT src, dst, rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pr) WHERE rank <= {K})"


def _edges(spark: SparkSession, sf: str, vec: str = "va") -> DataFrame:
    return materialize(knn.knn(T.vectors(spark, sf), "id", vec, K))


@query("knn_edges", f"WITH {_EDGES} SELECT src, dst, rank, round(dist, 6) AS dist FROM edges")
def knn_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _round(knn.knn(T.vectors(spark, sf), "id", "va", K), "dist")


@query("knn_mixing", f"""WITH {T.VECTORS}, {_PAIRS.format(v='va', on='AND x.label = y.label')}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pr) WHERE rank <= {K}),
o AS (SELECT a.label, avg(CASE WHEN a.batch <> b.batch THEN 1 ELSE 0 END) AS obs FROM e JOIN vectors a ON a.id = src JOIN vectors b ON b.id = dst GROUP BY 1),
s AS (SELECT label, batch, count(*) AS c FROM vectors GROUP BY ALL), x AS (SELECT label, sum(c) AS n, count(*) AS nb, 1 - sum(c * c) / (sum(c) * sum(c)) AS ex FROM s GROUP BY label)
SELECT label, n AS n_entities, nb AS n_batches, round(obs, 6) AS observed_fraction, round(ex, 6) AS expected_fraction, round(obs / ex, 6) AS normalized_mixing FROM o JOIN x USING (label) WHERE n >= 10 AND nb >= 2""")
def knn_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return _round(knn.batch_mixing(T.vectors(spark, sf), "id", "va", "label", "batch", K), "observed_fraction", "expected_fraction", "normalized_mixing")


_CONN = f"{_EDGES}, l AS (SELECT a.label AS s, b.label AS t FROM edges JOIN vectors a ON a.id = src JOIN vectors b ON b.id = dst), conn AS (SELECT s AS source, t AS target, count(*) AS n_edges, count(*) / sum(count(*)) OVER (PARTITION BY s) AS fraction FROM l GROUP BY s, t)"


@query("knn_connectivity", f"WITH {_CONN}, sh AS (SELECT label, count(*) / (SELECT count(*) FROM vectors) AS g FROM vectors GROUP BY label) SELECT source, target, n_edges, round(fraction, 6) AS fraction, round(fraction / g, 6) AS enrichment FROM conn JOIN sh ON label = target")
def knn_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return _round(knn.connectivity(_edges(spark, sf), T.vectors(spark, sf).select("id", "label"), "id", "label"), "fraction", "enrichment")


@query("continuity_decision", f"WITH {_CONN}, f AS (SELECT coalesce(max(fraction) FILTER (source = '2' AND target = '1'), 0) AS a, coalesce(max(fraction) FILTER (source = '2' AND target = '2'), 0) AS b, coalesce(max(fraction) FILTER (source = '2' AND target = '3'), 0) AS c FROM conn) SELECT round(a, 6) AS to_first, round(b, 6) AS to_self, round(c, 6) AS to_last, a >= 0.2 AND c >= 0.2 AND b <= 0.6 AS continuous FROM f")
def continuity_decision(spark: SparkSession, sf: str) -> DataFrame:
    c = knn.connectivity(_edges(spark, sf), T.vectors(spark, sf).select("id", "label"), "id", "label")
    return _round(knn.continuity_decision(c, "1", "2", "3"), "to_first", "to_self", "to_last")


_BRANCHES = {"left": ["1", "2", "3"], "right": ["1", "2", "4"]}


def _branch_sql(name: str, s: list[str], k: int) -> str:
    a, b, c = s
    inlist = ", ".join(f"'{x}'" for x in s)
    n = lambda x, y: f"count(*) FILTER (s = '{x}' AND t = '{y}')"
    return f"""(WITH sub AS (SELECT * FROM vectors WHERE label IN ({inlist})),
p AS (SELECT x.id AS src, y.id AS dst, x.label AS s, y.label AS t, sqrt(list_sum(list_transform(range(1, 33), lambda i: (x.va[i] - y.va[i]) * (x.va[i] - y.va[i])))) AS d FROM sub x JOIN sub y ON x.id <> y.id),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM p) WHERE r <= {k}),
m AS (SELECT count(*) FILTER (s <> t) / count(*) AS cross_fraction, ({n(a, b)} + {n(b, a)} + {n(b, c)} + {n(c, b)}) / count(*) FILTER (s <> t) AS adjacent_of_cross, ({n(a, c)} + {n(c, a)}) / count(*) FILTER (s <> t) AS bypass_of_cross,
  {n(a, b)} / count(*) FILTER (s = '{a}') AS f1, {n(b, c)} / count(*) FILTER (s = '{b}') AS f2, {n(c, b)} / count(*) FILTER (s = '{c}') AS f3 FROM e),
ce AS (SELECT label, dimension, avg(xa) AS m FROM dims WHERE label IN ({inlist}) GROUP BY ALL), ds AS (SELECT x.label AS p, y.label AS q, sqrt(sum((x.m - y.m) ** 2)) AS d FROM ce x JOIN ce y USING (dimension) GROUP BY ALL),
g AS (SELECT max(d) FILTER (p = '{a}' AND q = '{b}') AS d1, max(d) FILTER (p = '{b}' AND q = '{c}') AS d2, max(d) FILTER (p = '{a}' AND q = '{c}') AS d3 FROM ds)
SELECT '{name}' AS branch, {k} AS neighbours, round(1 - cross_fraction, 6) AS self_fraction, round(cross_fraction, 6) AS cross_fraction, round(adjacent_of_cross, 6) AS adjacent_of_cross, round(bypass_of_cross, 6) AS bypass_of_cross, round(least(f1, f2, f3), 6) AS min_bridge, round(d3 / (d1 + d2), 6) AS chain_ratio, d3 >= d1 AND d3 >= d2 AS endpoint_largest FROM m, g)"""


_NEIGHBOURS = (20, 30, 50)
_ALL_BRANCHES = " UNION ALL ".join(f"SELECT * FROM {_branch_sql(n, s, k)}" for n, s in _BRANCHES.items() for k in _NEIGHBOURS)


def _branches(spark: SparkSession, sf: str) -> DataFrame:
    """Both branches at every neighbour count; the lists of the largest hold the others."""
    out = None
    for name, states in _BRANCHES.items():
        v = materialize(T.vectors(spark, sf).where(F.col("label").isin(states)))
        e = materialize(knn.knn(v, "id", "va", max(_NEIGHBOURS)))
        for k in _NEIGHBOURS:
            m = knn.branch_metrics(e.where(F.col("rank") <= k), v, "id", "label", "va", T.DIMS, states)
            one = m.select(F.lit(name).alias("branch"), F.lit(k).alias("neighbours"), (1 - F.col("cross_fraction")).alias("self_fraction"), "*")
            out = one if out is None else out.unionByName(one)
    return out


@query("branch_continuity", f"WITH {T.VECTORS} {_ALL_BRANCHES}")
def branch_continuity(spark: SparkSession, sf: str) -> DataFrame:
    m = _branches(spark, sf)
    cols = ["self_fraction", "cross_fraction", "adjacent_of_cross", "bypass_of_cross", "min_bridge", "chain_ratio"]
    return _round(m.select("branch", "neighbours", *cols, "endpoint_largest"), *cols)


@query("branch_selection", f"WITH {T.VECTORS}, a AS ({_ALL_BRANCHES}) SELECT branch, count(*) AS n_settings, min(cross_fraction) AS min_cross_fraction, min(adjacent_of_cross) AS min_adjacent, max(bypass_of_cross) AS max_bypass, min(min_bridge) AS min_bridge, min(chain_ratio) AS min_chain_ratio, bool_and(endpoint_largest) AS endpoint_always_largest FROM a GROUP BY branch")
def branch_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = _branches(spark, sf)
    return _round(report.branch_selection(m, "branch"), "min_cross_fraction", "min_adjacent", "max_bypass", "min_bridge", "min_chain_ratio")


@query("connected_components", f"""WITH RECURSIVE {_EDGES.lstrip()}, near AS (SELECT src AS u, dst AS w FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT id AS u, id AS w FROM vectors UNION SELECT r.u, n.w FROM reach r JOIN near n ON n.u = r.w)
SELECT u AS id, min(w) AS component FROM reach GROUP BY u""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return knn.components(_edges(spark, sf), T.vectors(spark, sf), "id")


# --------------------------------------------------------------------- coherence
_CLK = "clk AS (SELECT id, va[1] AS clock, row_number() OVER (ORDER BY va[1], id) - 1 AS rk, count(*) OVER () AS n FROM vectors)"


def _clocked(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    v = T.vectors(spark, sf).withColumn("clock", doubles(F.col("va"))[0])
    n = v.count()
    return materialize(rank_rows(v, ["clock", "id"])), n


def _h(*p: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 15))::BIGINT"


@query("graph_smoothness", f"""WITH {_EDGES}, {_CLK}, und AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM edges), eg AS (SELECT abs(a.clock - b.clock) AS g FROM und JOIN clk a ON a.id = s JOIN clk b ON b.id = d),
rp AS (SELECT abs(a.clock - b.clock) AS g FROM (SELECT {_h("'785'", "'a'", 'i')} % (SELECT count(*) FROM vectors) AS x, {_h("'785'", "'b'", 'i')} % (SELECT count(*) FROM vectors) AS y FROM (SELECT unnest(range(0, 10000)) AS i)) JOIN clk a ON a.rk = x JOIN clk b ON b.rk = y)
SELECT round((SELECT median(g) FROM eg), 6) AS edge_median, round((SELECT median(g) FROM rp), 6) AS random_median, round((SELECT median(g) FROM eg) / (SELECT median(g) FROM rp), 6) AS ratio""")
def graph_smoothness(spark: SparkSession, sf: str) -> DataFrame:
    v, n = _clocked(spark, sf)
    e = knn.undirected(_edges(spark, sf))
    return _round(knn.edge_smoothness(e, v, "id", "clock", knn.random_pairs(v, "id", n, 10_000, 785)), "edge_median", "random_median", "ratio")


@query("neighbor_coherence", f"""WITH {_EDGES}, {_CLK}, ids AS (SELECT id, clock, row_number() OVER (ORDER BY id) - 1 AS r FROM clk),
pm AS (SELECT p, clock, row_number() OVER (PARTITION BY p ORDER BY {_h("'20260920'", 'p', 'id')}, id) - 1 AS r FROM clk, (SELECT unnest(range(0, {PERMS})) AS p)), dealt AS (SELECT p, i.id, pm.clock FROM pm JOIN ids i USING (r)),
rg AS (SELECT a.p, avg(abs(a.clock - b.clock)) AS g FROM edges JOIN dealt a ON a.id = src JOIN dealt b ON b.id = dst AND b.p = a.p GROUP BY a.p), o AS (SELECT avg(abs(a.clock - b.clock)) AS g FROM edges JOIN clk a ON a.id = src JOIN clk b ON b.id = dst)
SELECT round(o.g, 6) AS observed_mean, round((SELECT avg(g) FROM rg), 6) AS random_mean, round(o.g / (SELECT avg(g) FROM rg), 6) AS ratio FROM o""")
def neighbor_coherence(spark: SparkSession, sf: str) -> DataFrame:
    v, n = _clocked(spark, sf)
    perm = knn.clock_permutations(v, "id", "clock", n, PERMS, 20260920)
    return _round(knn.neighbor_coherence(_edges(spark, sf), v, "id", "clock", perm, PERMS), "observed_mean", "random_mean", "ratio")


@query("adjacent_distance_ratio", f"""WITH {T.VECTORS}, o AS (SELECT -1 AS p, id, vb, row_number() OVER (ORDER BY va[1], id) AS r FROM vectors UNION ALL SELECT p, id, vb, row_number() OVER (PARTITION BY p ORDER BY {_h("'785'", 'p', 'id')}, id) FROM vectors, (SELECT unnest(range(0, {PERMS})) AS p)),
d AS (SELECT x.p, sqrt(list_sum(list_transform(range(1, 33), lambda i: (x.vb[i] - y.vb[i]) * (x.vb[i] - y.vb[i])))) AS d FROM o x JOIN o y ON y.p = x.p AND y.r = x.r + 1), m AS (SELECT p, median(d) AS m FROM d GROUP BY p)
SELECT round(max(m) FILTER (p = -1), 6) AS observed_median, round(median(m) FILTER (p >= 0), 6) AS random_median, round(quantile_cont(m, 0.025) FILTER (p >= 0), 6) AS random_low, round(quantile_cont(m, 0.975) FILTER (p >= 0), 6) AS random_high, round(max(m) FILTER (p = -1) / median(m) FILTER (p >= 0), 6) AS ratio FROM m""")
def adjacent_distance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    v, n = _clocked(spark, sf)
    return _round(knn.order_coherence(v, "id", "clock", "vb", n, PERMS, 785), "observed_median", "random_median", "random_low", "random_high", "ratio")


_MEANS = f"""{T.VECTORS}, one AS (SELECT id, label, list_sum(list_transform({{v}}, lambda x: x * x)) AS q FROM vectors), tot AS (SELECT label, count(*) AS n, sum(q) AS q FROM one GROUP BY 1), su AS (SELECT label, dimension, sum({{x}}) AS s FROM dims GROUP BY ALL),
ds AS (SELECT d.id, d.label AS own, su.label AS l, sum(d.{{x}} * su.s) AS p FROM dims d JOIN su USING (dimension) GROUP BY ALL),
far AS (SELECT ds.id, own, l, (t.n * o.q - 2 * p + t.q) AS f, t.n FROM ds JOIN tot t ON t.label = l JOIN one o ON o.id = ds.id WHERE t.n >= 2),
sil AS (SELECT id, own, max(f / (n - 1)) FILTER (l = own) AS a, min(f / n) FILTER (l <> own) AS b FROM far GROUP BY ALL)"""


@query("silhouette", f"""WITH {_MEANS.format(v='va', x='xa')} SELECT count(*) AS n_scored, (SELECT count(*) FROM tot WHERE n >= 2) AS n_labels, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM sil""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return _round(knn.silhouette(T.vectors(spark, sf), "id", "va", "label"), "silhouette")


# ---------------------------------------------------------------- change scores
@query("transition_energy", f"""WITH {T.VECTORS}, {_CLK}, w AS (SELECT unnest(range(0, ((SELECT count(*) FROM vectors) - 50) // 10 + 1)) AS w), h AS (SELECT w, d.dimension, d.xa FROM w JOIN clk ON clk.rk >= w * 10 AND clk.rk < w * 10 + 50 JOIN dims d ON d.id = clk.id),
c AS (SELECT w, dimension, avg(xa) AS m, var_pop(xa) AS v FROM h GROUP BY ALL), s AS (SELECT w, sum(v) AS s2 FROM c GROUP BY w),
e AS (SELECT a.w + 1 AS w, sum((a.m - b.m) ** 2) AS d2 FROM c a JOIN c b ON b.w = a.w + 2 AND b.dimension = a.dimension GROUP BY a.w)
SELECT w.w AS window_index, round(coalesce(d2 / ((p.s2 + n.s2) / 2), 0), 6) AS transition_energy FROM w LEFT JOIN e USING (w) LEFT JOIN s p ON p.w = w.w - 1 LEFT JOIN s n ON n.w = w.w + 1""")
def transition_energy(spark: SparkSession, sf: str) -> DataFrame:
    v, n = _clocked(spark, sf)
    return _round(energy.transition_energy(v, "va", T.DIMS, SMALL, n), "transition_energy")


# ----------------------------------------------------------------------- clocks
_NEAR = f"ds AS (SELECT src, list(dist ORDER BY dist) AS d, count(*) AS m, list_min(list(dist) FILTER (dist > 0)) AS rho FROM edges WHERE rank < {K} GROUP BY src)"
_WIDTH = """wd AS (SELECT src, coalesce(rho, 0) AS rho, greatest(list_reduce(list_prepend(0.0::DOUBLE, [mx / ln(m / log2(m + 1)) / pow(2.0, i) for i in range(1, 61)]),
  lambda s, x: CASE WHEN list_sum([CASE WHEN o > 0 THEN exp(-o / (s + x)) ELSE 1.0 END for o in ov]) < log2(m + 1) THEN s + x ELSE s END), 0.001 * list_sum(d) / (m + 1)) AS sigma
  FROM (SELECT *, list_max(ov) AS mx FROM (SELECT *, [greatest(x - coalesce(rho, 0), 0) for x in d] AS ov FROM ds)))"""


@query("fuzzy_graph", f"""WITH {_EDGES}, {_NEAR}, {_WIDTH}, one AS (SELECT e.src, e.dst, CASE WHEN e.dist <= w.rho THEN 1.0 ELSE exp(-(e.dist - w.rho) / w.sigma) END AS w FROM edges e JOIN wd w USING (src) WHERE e.rank < {K}),
sides AS (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one) SELECT src, dst, round(sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END, 6) AS w FROM sides GROUP BY src, dst""")
def fuzzy_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy-set weights of the neighbour graph, each vector counted among its own neighbours."""
    return _round(ck.fuzzy_graph(materialize(knn.knn(T.vectors(spark, sf), "id", "va", K - 1))), "w")


@query("clock_invariants", f"""WITH RECURSIVE {_EDGES.lstrip()}, near AS (SELECT src AS u, dst AS w FROM edges WHERE rank < {K} UNION SELECT dst, src FROM edges WHERE rank < {K}),
reach AS (SELECT id AS u, id AS w FROM vectors UNION SELECT r.u, n.w FROM reach r JOIN near n ON n.u = r.w), co AS (SELECT u AS id, min(w) AS c FROM reach GROUP BY u),
rt AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM vectors) WHERE r = 1), k AS (SELECT unnest(['fuzzy', 'gauss']) AS kernel)
SELECT kernel, (SELECT count(*) FROM co WHERE c = (SELECT c FROM co JOIN rt USING (id))) AS n_connected, (SELECT count(*) FROM co WHERE c <> (SELECT c FROM co JOIN rt USING (id))) AS n_null, 0.0::DOUBLE AS at_root, 1.0::DOUBLE AS largest, true AS none_below_root FROM k""")
def clock_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What every clock must be, for both kernels: zero at the root, one at its end, NULL off the root's component."""
    v = materialize(T.vectors(spark, sf))
    root = v.agg(F.min("id")).first()[0]
    near = materialize(knn.knn(v, "id", "va", K - 1))
    parts = materialize(knn.components(near, v, "id"))
    out = None
    for kernel in ("fuzzy", "gauss"):
        c = materialize(ck.diffusion_clock(v, "id", "va", root, K, kernel=kernel, edges=near, parts=parts))
        one = c.agg(F.count("clock").alias("n_connected"), F.count_if(F.col("clock").isNull()).alias("n_null"), r6(F.max(F.when(F.col("id") == root, F.col("clock")))).alias("at_root"), r6(F.max("clock")).alias("largest"), (F.min("clock") >= 0).alias("none_below_root"))
        one = one.select(F.lit(kernel).alias("kernel"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("diffusion_clock")
def diffusion_clock(spark: SparkSession, sf: str) -> DataFrame:
    v = T.vectors(spark, sf)
    root = rep.root_medoid(v, "id", "va", T.DIMS, F.col("label") == "3").first()["root_id"]
    return _round(ck.diffusion_clock(v, "id", "va", root, 30), "clock")


@query("clock_sensitivity")
def clock_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of clocks with 20 and 50 neighbours with the clock of 30."""
    v = T.vectors(spark, sf)
    root = rep.root_medoid(v, "id", "va", T.DIMS, F.col("label") == "3").first()["root_id"]
    near = materialize(knn.knn(v, "id", "va", 50 - 1))  # lists of the largest hold the others
    base = materialize(ck.diffusion_clock(v, "id", "va", root, 30, edges=near).select("id", F.col("clock").alias("base")))
    others = None
    for k in (20, 50):
        one = materialize(ck.diffusion_clock(v, "id", "va", root, k, edges=near).select(F.lit(f"30 vs {k}").alias("neighbours"), "id", F.round("clock", 9).alias("other")))
        others = one if others is None else others.unionByName(one)
    j = materialize(base.join(others, "id").select("neighbours", F.round("base", 9).alias("base"), "other"))
    rho = stats.spearman(j, "base", "other", ["neighbours"], "rho")
    return j.groupBy("neighbours").agg(F.count("base").alias("n_connected")).join(rho, "neighbours").select("neighbours", "n_connected", r6(F.col("rho")).alias("rho"))


@query("representation_grid")
def representation_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of both modalities at several widths: variance shares and their ratio, silhouettes by label and by
    batch, mixing, label and class."""
    v = materialize(T.vectors(spark, sf))
    rows = None
    for m, vec in (("A", "va"), ("B", "vb")):
        for d in (16, 32):
            x = materialize(rep.zscore_vector(v.withColumn(vec, F.slice(vec, 1, d)), vec, d))
            r = stats.partial_r2(rep.dims_as_columns(x, vec, 1, d), [f"d{i}" for i in range(1, d + 1)], ["label"], ["batch"])
            sil = knn.plain_silhouettes(x, vec, ["label", "batch"])
            mix = knn.batch_mixing(x, "id", vec, "label", "batch", K).agg(stats.weighted_mean(F.col("normalized_mixing"), F.col("n_entities")).alias("mixing"))
            tech, bio = F.lit(r["technical_partial_r2"]), F.lit(r["biology_partial_r2"])
            ratio = rep.biology_ratio(tech, bio)
            one = mix.select(
                F.lit(m).alias("modality"), F.lit(d).alias("dimensions"), r6(bio).alias("biology_partial_r2"), r6(tech).alias("technical_partial_r2"), r6(ratio).alias("biology_to_technical_ratio"),
                *[r6(F.lit(sil[l]).cast("double")).alias(f"{l}_silhouette") for l in ("label", "batch")], r6(F.col("mixing")).alias("mixing"),
                rep.qc_label(tech, bio, F.col("mixing")).alias("qc"), rep.qc_class(tech, ratio, F.col("mixing")).alias("qc_class"),
            )
            rows = one if rows is None else rows.unionByName(one)
    return rows
