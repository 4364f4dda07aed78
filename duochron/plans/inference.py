"""Queries that resample: bootstraps of the lag, timing and stability, and alignment nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import audit, peaks as pk, profiles as pf, report, resample as rs, stats, windows as win
from ..session import materialize
from . import tables as T
from .catalog import query

REPLICATES = 500
STABILITY_REPLICATES = 200
ENTITY_REPLICATES = 500
PROFILE_PERMUTATIONS = 5_000
REGION = (8.0, 22.0)
CENTERS = {"A": 15.0, "B": 14.0}
TOLERANCE = 3.0


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _hash(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"


# ------------------------------------------------------------------- bootstrap
def _boot_sql(seed: int, first: str, size: str, replicates: int = REPLICATES) -> str:
    """Drawn rows (replicate, pos, clock, a, b) for strata with the given first rank and size."""
    return f"""
nn AS (SELECT count(*) AS n FROM ranked),
strat AS (SELECT rk, {first} AS f, {size} AS z FROM ranked, nn),
draws AS (SELECT r AS replicate, f + {_hash(str(seed), 'r', '0', 'rk')} % z AS rk FROM strat, (SELECT unnest(range(0, {replicates})) AS r)),
booted AS (SELECT d.replicate, row_number() OVER (PARTITION BY d.replicate ORDER BY d.rk) - 1 AS pos, k.clock, k.a, k.b FROM draws d JOIN ranked k USING (rk)),
bwin AS (SELECT b.replicate, w AS idx, b.clock, b.a, b.b FROM booted b, LATERAL (SELECT unnest(range(greatest(0, floor((b.pos - 400) / 100)::BIGINT + 1), least(b.pos // 100, ((SELECT n FROM nn) - 400) // 100)::BIGINT + 1)) AS w)),
bw AS (SELECT replicate, idx, median(clock) AS x, round(sum(a) / 400, 9) AS ya, round(sum(b) / 400, 9) AS yb FROM bwin GROUP BY ALL),
profile AS (SELECT 'A|400/100|' || replicate AS series, replicate, 'A' AS modality, '400/100' AS window_config, idx, x, ya AS y FROM bw UNION ALL SELECT 'B|400/100|' || replicate, replicate, 'B', '400/100', idx, x, yb FROM bw)"""


_CHUNKS = _boot_sql(rs.DISCOVERY_SEED, "rk // 100 * 100", "least(100, n - rk // 100 * 100)")
_FEWER_CHUNKS = _boot_sql(rs.DISCOVERY_SEED, "rk // 100 * 100", "least(100, n - rk // 100 * 100)", STABILITY_REPLICATES)
_PARTS_ID = "CASE WHEN rk < (n % 20) * (n // 20 + 1) THEN rk // (n // 20 + 1) ELSE n % 20 + (rk - (n % 20) * (n // 20 + 1)) // (n // 20) END"
_PARTS = _boot_sql(rs.VALIDATION_SEED, f"({_PARTS_ID}) * (n // 20) + least(({_PARTS_ID}), n % 20)", f"n // 20 + CASE WHEN ({_PARTS_ID}) < n % 20 THEN 1 ELSE 0 END")


def ordered(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The entities along the clock, written once for all who read them."""
    r, n = T.ranked(spark, sf)
    return materialize(r.select("rk", "clock", "a", "b")), n


def _booted(spark: SparkSession, sf: str, validation: bool, replicates: int = REPLICATES, order: tuple[DataFrame, int] | None = None) -> DataFrame:
    r, n = order or ordered(spark, sf)
    if validation:
        s = rs.strata(r, n, parts=rs.N_STRATA)
        return rs.bootstrap_profiles(s, "clock", {"A": "a", "B": "b"}, win.PRIMARY, n, replicates, rs.VALIDATION_SEED)
    s = rs.strata(r, n, size=rs.STRATUM_SIZE)
    return rs.replicate_profiles(rs.replicate_windows(s, "clock", {"A": "a", "B": "b"}, win.PRIMARY, n, replicates, rs.DISCOVERY_SEED), ["A", "B"], win.PRIMARY)


@query("bootstrap_draws", f"WITH {T.RANKED}, {_CHUNKS} SELECT replicate, count(*) AS n, count(DISTINCT clock) AS n_distinct, round(sum(a), 4) AS sum_a, round(sum(b * pos) / sum(pos), 6) AS weighted_b FROM booted GROUP BY replicate")
def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    t = rs.draw_totals(rs.strata(r, n, size=rs.STRATUM_SIZE), "clock", "a", "b", REPLICATES, rs.DISCOVERY_SEED)
    return t.withColumns({"sum_a": F.round("sum_a", 4), "weighted_b": r6(F.col("weighted_b"))})


@query("bootstrap_profiles", f"WITH {T.RANKED}, {_PARTS} SELECT replicate, modality, idx, round(x, 6) AS x, round(y, 6) AS y FROM profile")
def bootstrap_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_booted(spark, sf, True).select("replicate", "modality", "idx", "x", "y"), "x", "y")


def _track_sql(boot: str, gate: str) -> str:
    from .curves import EXT, RUNS, prominence_sql

    return f"""WITH {T.RANKED}, {boot}, {EXT}, {RUNS}, {prominence_sql('maxima')},
cand AS (SELECT p.series, e.modality, c.replicate, p.idx, c.x, p.prominence, e.y1 - e.y0 AS rng, e.n, e.x0, e.x1, s.sp, CASE e.modality WHEN 'A' THEN 15.0 ELSE 14.0 END AS ctr
  FROM prom p JOIN ext e USING (series) JOIN space s USING (series) JOIN profile c ON c.series = p.series AND c.idx = p.idx),
ok AS (SELECT *, abs(x - ctr) AS d FROM cand WHERE {gate} AND abs(x - ctr) <= 3.0),
best AS (SELECT series, arg_min(x, {{'d': d, 'p': -prominence, 'x': x}}) AS px FROM ok GROUP BY series),
lag AS (SELECT c.replicate, count(b.px) = 2 AS paired, max(b.px) FILTER (c.modality = 'A') AS ax, max(b.px) FILTER (c.modality = 'B') AS bx
  FROM (SELECT DISTINCT series, replicate, modality FROM profile) c LEFT JOIN best b USING (series) GROUP BY c.replicate)"""


_VGATE = "prominence >= greatest(0.005, 0.05 * rng) AND NOT (idx < 3 OR idx >= n - 3) AND least(x - x0, x1 - x) > 2 * sp"


def _with_keys(peaks: DataFrame) -> DataFrame:
    t = F.split("series", r"\|")
    return peaks.select("*", t[0].alias("modality"), t[2].cast("int").alias("replicate"))


def _all_tracked(p: DataFrame, tracked: DataFrame) -> DataFrame:
    """Series without any peak at all still count as not detected."""
    base = p.select("series", "modality", "replicate").distinct()
    return base.join(tracked.drop("modality"), "series", "left").withColumn("detected", F.coalesce("detected", F.lit(False)))


def _validation_lags(p: DataFrame) -> DataFrame:
    v = _with_keys(pk.validation_peaks(p, stored=False))  # read once
    t = pk.track(v, CENTERS, TOLERANCE, F.col("material") & ~F.col("edge"))
    return rs.lags(_all_tracked(p, t), "A", "B")


@query("bootstrap_lag", _track_sql(_PARTS, _VGATE) + " SELECT replicate, paired, round(ax, 6) AS a_x, round(bx, 6) AS b_x, round(ax - bx, 6) AS lag, ax > bx AS b_first, ax < bx AS a_first, ax = bx AS synchronous FROM lag")
def bootstrap_lag(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_validation_lags(_booted(spark, sf, True)), "a_x", "b_x", "lag")


@query("bootstrap_lag_summary", _track_sql(_PARTS, _VGATE) + """, v AS (SELECT ax - bx AS l FROM lag WHERE paired)
SELECT count(l) AS n, round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS sd, round(avg(CASE WHEN l > 0 THEN 1 ELSE 0 END), 6) AS p_positive, round(median(l), 6) AS median,
  round(quantile_cont(l, 0.025), 6) AS ci_low, round(quantile_cont(l, 0.975), 6) AS ci_high, round((SELECT avg(CASE WHEN paired THEN 1 ELSE 0 END) FROM lag), 6) AS detection_rate FROM v""")
def bootstrap_lag_summary(spark: SparkSession, sf: str, order: tuple[DataFrame, int] | None = None) -> DataFrame:
    l = materialize(_validation_lags(_booted(spark, sf, True, order=order)))
    s = stats.bootstrap_summary(l.where("paired"), "lag").crossJoin(l.agg(stats.rate(F.col("paired")).alias("detection_rate")))  # one row each
    return _round(s, "mean", "sd", "p_positive", "median", "ci_low", "ci_high", "detection_rate")


@query("bootstrap_gates", _track_sql(_PARTS, _VGATE) + """, f AS (SELECT avg(CASE WHEN paired THEN 1 ELSE 0 END) AS rate, quantile_cont(ax - bx, 0.025) FILTER (paired) AS lo, avg(CASE WHEN ax > bx THEN 1.0 ELSE 0 END) FILTER (paired) AS pos FROM lag)
SELECT 1 AS step, 'paired detection rate >= 0.80' AS criterion, rate >= 0.8 AS passed, CASE WHEN rate >= 0.8 THEN 'PASS' ELSE 'REVIEW' END AS status FROM f
UNION ALL SELECT 2, '95% interval above zero', coalesce(lo > 0, false), CASE WHEN lo > 0 THEN 'PASS' ELSE 'REVIEW' END FROM f
UNION ALL SELECT 3, 'P(lag > 0) >= 0.95', coalesce(pos >= 0.95, false), CASE WHEN pos >= 0.95 THEN 'PASS' ELSE 'REVIEW' END FROM f""")
def bootstrap_gates(spark: SparkSession, sf: str) -> DataFrame:
    l = materialize(_validation_lags(_booted(spark, sf, True)))
    s = stats.bootstrap_summary(l.where("paired"), "lag").crossJoin(l.agg(stats.rate(F.col("paired")).alias("rate")))
    return audit.checks(s, [
        ("paired detection rate >= 0.80", F.col("rate") >= 0.80), ("95% interval above zero", F.col("ci_low") > 0), ("P(lag > 0) >= 0.95", F.col("p_positive") >= 0.95),
    ])


@query("region_timing_bootstrap", f"""WITH {T.RANKED}, {_CHUNKS},
reg AS (SELECT series, modality, replicate, greatest(8.0, min(x)) AS lo, least(22.0, max(x)) AS hi, max(x) AS x1, arg_max(y, idx) AS yl FROM profile GROUP BY ALL),
grid AS (SELECT series, modality, replicate, g, lo + (hi - lo) * g / 499 AS gx, x1, yl FROM reg, (SELECT unnest(range(0, 500)) AS g)),
seg AS (SELECT *, lead(x) OVER s AS ex, lead(y) OVER s AS ey FROM profile WINDOW s AS (PARTITION BY series ORDER BY idx)),
rd AS (SELECT g.series, g.modality, g.replicate, g.g, g.gx, coalesce(s.y + (g.gx - s.x) / (s.ex - s.x) * (s.ey - s.y), g.yl) AS gy FROM grid g ASOF LEFT JOIN seg s ON g.series = s.series AND g.gx >= s.x),
b AS (SELECT series, min(gy) AS b FROM rd GROUP BY series), e AS (SELECT rd.*, gy - b AS e FROM rd JOIN b USING (series)),
tr AS (SELECT series, modality, replicate, g, gx, coalesce((gx - lag(gx) OVER s) * (e + lag(e) OVER s) / 2, 0) AS t FROM e WINDOW s AS (PARTITION BY series ORDER BY g)),
cu AS (SELECT *, sum(t) OVER (PARTITION BY series ORDER BY g) AS c FROM tr), tt AS (SELECT series, max(c) AS area FROM cu GROUP BY series),
sh AS (SELECT series, modality, replicate, g, gx, c / area AS c FROM cu JOIN tt USING (series)),
lo AS (SELECT series, arg_max(gx, g) AS x, arg_max(c, g) AS c FROM sh WHERE c <= 0.5 GROUP BY series), hi AS (SELECT series, modality, replicate, arg_min(gx, g) AS x, arg_min(c, g) AS c FROM sh WHERE c > 0.5 GROUP BY ALL),
q AS (SELECT modality, replicate, lo.x + (0.5 - lo.c) / (hi.c - lo.c) * (hi.x - lo.x) AS q50 FROM hi JOIN lo USING (series))
SELECT replicate, round(max(q50) FILTER (modality = 'A'), 5) AS q50_a, round(max(q50) FILTER (modality = 'B'), 5) AS q50_b, round(max(q50) FILTER (modality = 'A') - max(q50) FILTER (modality = 'B'), 5) AS signed_gap FROM q GROUP BY replicate""")
def region_timing_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    g = rs.grid_alignment(_booted(spark, sf, False), "replicate", "A", "B", *REGION)
    return g.select("replicate", *[F.round(c, 5).alias(c) for c in ("q50_a", "q50_b", "signed_gap")])


def _stability_sql() -> str:
    from .curves import disc_sql

    return disc_sql(f"{T.RANKED}, {_FEWER_CHUNKS}") + """, ctr AS (SELECT series, modality, CASE modality WHEN 'A' THEN 15.0 ELSE 14.0 END AS c FROM ext),
near AS (SELECT p.series, p.x, p.y, abs(p.y - lag(p.y) OVER (PARTITION BY p.series ORDER BY p.idx)) AS dy FROM profile p JOIN ctr USING (series) WHERE abs(p.x - c) <= 3),
loc AS (SELECT series, max(y) - min(y) AS rng, avg(dy) AS rough, max(y) AS top FROM near GROUP BY series HAVING count(*) >= 2), pla AS (SELECT series, max(x) - min(x) AS w FROM near JOIN loc USING (series) WHERE y >= 0.9 * top GROUP BY series),
el AS (SELECT series, count(*) FILTER (abs(x - c) <= 3) AS ne, count(*) AS np FROM disc JOIN ctr USING (series) GROUP BY series)
SELECT modality, count(*) AS n_replicates, round(avg(CASE WHEN coalesce(ne, 0) > 0 THEN 1 ELSE 0 END), 6) AS detection_rate, round(avg(coalesce(np, 0)), 6) AS mean_peaks, round(avg(rough), 4) AS mean_roughness, round(avg(w), 4) AS mean_plateau_width, round(avg(rng), 4) AS mean_local_range
FROM ctr LEFT JOIN el USING (series) LEFT JOIN loc USING (series) LEFT JOIN pla USING (series) GROUP BY modality"""


@query("peak_stability_bootstrap", _stability_sql())
def peak_stability_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    p = _booted(spark, sf, False, STABILITY_REPLICATES)
    s = pk.stability(p, _with_keys(pk.discovery_peaks(p)), CENTERS, TOLERANCE)
    return s.groupBy("modality").agg(
        F.count(F.lit(1)).alias("n_replicates"), r6(stats.rate(F.col("detected"))).alias("detection_rate"), r6(F.avg("n_peaks")).alias("mean_peaks"),
        F.round(F.avg("roughness"), 4).alias("mean_roughness"), F.round(F.avg("plateau_width"), 4).alias("mean_plateau_width"), F.round(F.avg("local_range"), 4).alias("mean_local_range"),
    )


# ----------------------------------------------------------------------- nulls
_PAIR = f"""{T.PROFILES}, pair AS (SELECT idx, any_value(x) AS x, max(y) FILTER (modality = 'A') AS a, max(y) FILTER (modality = 'B') AS b FROM profile WHERE window_config = '400/100' GROUP BY idx),
np AS (SELECT count(*) AS n FROM pair)"""


def _metrics_sql(src: str, key: str) -> str:
    """Alignment metrics per key from rows (key, idx, x, a, b) in `src`."""
    def center(c: str) -> str:
        return f"""
t{c} AS (SELECT {key}, idx, x, greatest({c}, 0) AS m, sum(greatest({c}, 0)) OVER (PARTITION BY {key}) AS t FROM {src}),
c{c} AS (SELECT {key}, idx, x, sum(m) OVER (PARTITION BY {key} ORDER BY idx) / t AS c FROM t{c}),
l{c} AS (SELECT {key}, arg_max(x, idx) AS x, arg_max(c, idx) AS c FROM c{c} WHERE c <= 0.5 GROUP BY {key}), h{c} AS (SELECT {key}, arg_min(x, idx) AS x, arg_min(c, idx) AS c FROM c{c} WHERE c > 0.5 GROUP BY {key}),
q{c} AS (SELECT {key}, CASE WHEN l.x IS NULL THEN h.x ELSE l.x + (0.5 - l.c) / (h.c - l.c) * (h.x - l.x) END AS q FROM h{c} h LEFT JOIN l{c} l USING ({key}))"""

    return center("a") + "," + center("b") + f""",
rkk AS (SELECT {key}, rank() OVER (PARTITION BY {key} ORDER BY a) + (count(*) OVER (PARTITION BY {key}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {key} ORDER BY b) + (count(*) OVER (PARTITION BY {key}, b) - 1) / 2.0 AS rb FROM {src}),
rho AS (SELECT {key}, corr(ra, rb) AS rho FROM rkk GROUP BY {key}),
pq AS (SELECT {key}, greatest(a, 0) / sum(greatest(a, 0)) OVER (PARTITION BY {key}) AS p, greatest(b, 0) / sum(greatest(b, 0)) OVER (PARTITION BY {key}) AS q FROM {src}),
jsd AS (SELECT {key}, greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0) AS js FROM pq GROUP BY {key}),
metrics AS (SELECT {key}, qa.q AS q50_a, qb.q AS q50_b, qa.q - qb.q AS signed_gap, abs(qa.q - qb.q) AS absolute_gap, rho AS spearman_rho, js AS js_divergence FROM qa JOIN qb USING ({key}) JOIN rho USING ({key}) JOIN jsd USING ({key}))"""


_SHOW = "round(q50_a, 6) AS q50_a, round(q50_b, 6) AS q50_b, round(signed_gap, 6) AS signed_gap, round(absolute_gap, 6) AS absolute_gap, round(spearman_rho, 6) AS spearman_rho, round(js_divergence, 6) AS js_divergence"
_COLS = ("q50_a", "q50_b", "signed_gap", "absolute_gap", "spearman_rho", "js_divergence")
_SHIFTS = f"""{_PAIR}, rolled AS (SELECT o AS k, (idx + o) % n AS idx, b FROM pair, np, (SELECT unnest(range(4, (SELECT n FROM np) - 3)) AS o)),
src AS (SELECT r.k, p.idx, p.x, p.a, r.b FROM pair p JOIN rolled r USING (idx) WHERE p.x BETWEEN 8.0 AND 22.0 UNION ALL SELECT 0, idx, x, a, b FROM pair WHERE x BETWEEN 8.0 AND 22.0)"""


def _pair(spark: SparkSession, sf: str, curves: DataFrame | None = None) -> tuple[DataFrame, int]:
    p = T.profiles(spark, sf, [win.PRIMARY]) if curves is None else curves.where(F.col("window_config") == win.PRIMARY.name)
    side = lambda m: F.max(F.when(F.col("modality") == m, F.col("y")))
    wide = materialize(p.groupBy("idx").agg(F.max("x").alias("x"), side("A").alias("a"), side("B").alias("b")))
    return wide, wide.count()


def _shift_metrics(spark: SparkSession, sf: str, curves: DataFrame | None = None) -> DataFrame:
    """Key 0 is the observed alignment, every other key an admissible shift."""
    pair, n = _pair(spark, sf, curves)
    lo, hi = rs.admissible_offsets(n, 4)
    return materialize(rs.moved_alignment(pair, "k", [0, *range(lo, hi + 1)], rs.shift_sources(n), *REGION))


@query("circular_shift_null", f"WITH {_SHIFTS}, {_metrics_sql('src', 'k')} SELECT k, {_SHOW} FROM metrics")
def circular_shift_null(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_shift_metrics(spark, sf), *_COLS)


_SIDES = {"absolute_gap": "low", "spearman_rho": "high", "js_divergence": "low"}


def _null_sql(metric: str, side: str) -> str:
    op = "<=" if side == "low" else ">="
    return f"""SELECT '{metric}' AS metric, '{side}' AS side, o.{metric} AS observed, m.{metric} AS v, m.{metric} {op} o.{metric} AS ext FROM metrics m, (SELECT * FROM metrics WHERE k = 0) o WHERE m.k <> 0"""


_NULLS = " UNION ALL ".join(_null_sql(m, s) for m, s in _SIDES.items())


@query("null_summary", f"""WITH {_SHIFTS}, {_metrics_sql('src', 'k')}, nul AS ({_NULLS})
SELECT metric, side, round(observed, 6) AS observed, count(v) AS n_null, round(avg(v), 6) AS null_mean, round(median(v), 6) AS null_median, round(quantile_cont(v, 0.025), 6) AS null_low, round(quantile_cont(v, 0.975), 6) AS null_high,
  round((1 + count(*) FILTER (ext)) / (1 + count(v)), 6) AS p, (1 + count(*) FILTER (ext)) / (1 + count(v)) <= 0.05 AS significant FROM nul GROUP BY metric, side, observed""")
def null_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = _shift_metrics(spark, sf)
    return _round(report.null_summary(m.where("k = 0"), m.where("k <> 0"), _SIDES), "observed", "null_mean", "null_median", "null_low", "null_high", "p")


@query("alignment_evidence", f"""WITH {_SHIFTS}, {_metrics_sql('src', 'k')}, nul AS ({_NULLS}),
s AS (SELECT metric, (1 + count(*) FILTER (ext)) / (1 + count(v)) <= 0.05 AS sig FROM nul GROUP BY metric)
SELECT count(*) FILTER (sig) AS n_significant, CASE count(*) FILTER (sig) WHEN 3 THEN 'STRONG' WHEN 2 THEN 'PARTIAL' ELSE 'LIMITED_OR_NONE' END AS evidence FROM s""")
def alignment_evidence(spark: SparkSession, sf: str, curves: DataFrame | None = None) -> DataFrame:
    m = _shift_metrics(spark, sf, curves)
    t = report.null_summary(m.where("k = 0"), m.where("k <> 0"), _SIDES)
    return t.agg(F.count_if(F.col("significant")).alias("n_significant")).withColumn("evidence", stats.evidence_class(F.col("n_significant")))


_BLOCKS = f"""{_PAIR}, blk AS (SELECT r, k AS block, least(4, n - k * 4) AS z, {_hash('785', 'r', 'k')} AS h FROM np, (SELECT unnest(range(0, {PROFILE_PERMUTATIONS})) AS r), LATERAL (SELECT unnest(range(0, (n + 3) // 4)) AS k)),
st AS (SELECT r, block, sum(z) OVER (PARTITION BY r ORDER BY h, block) - z AS s FROM blk),
perm AS (SELECT st.r AS k, st.s + p.idx - st.block * 4 AS idx, p.b FROM st JOIN pair p ON p.idx // 4 = st.block),
src AS (SELECT r.k, p.idx, p.x, p.a, r.b FROM pair p JOIN perm r USING (idx) WHERE p.x BETWEEN 8.0 AND 22.0)"""


@query("block_perm_null", f"WITH {_BLOCKS}, {_metrics_sql('src', 'k')} SELECT k, {_SHOW} FROM metrics")
def block_perm_null(spark: SparkSession, sf: str) -> DataFrame:
    pair, n = _pair(spark, sf)
    return _round(rs.moved_alignment(pair, "k", range(PROFILE_PERMUTATIONS), rs.block_sources(n, 4, rs.VALIDATION_SEED), *REGION), *_COLS)


def _grid_sql(source: str, key: str) -> str:
    """Tables q, rho and js by k: both curves of `source` (series, key, modality, idx, x, y) on one grid."""
    return f"""reg AS (SELECT {key}, greatest(8.0, max(x0)) AS lo, least(22.0, min(x1)) AS hi FROM (SELECT {key}, modality, min(x) AS x0, max(x) AS x1 FROM {source} GROUP BY ALL) GROUP BY 1),
grid AS (SELECT r.{key}, m.modality, g, lo + (hi - lo) * g / 499 AS gx FROM reg r, (SELECT unnest(range(0, 500)) AS g), (SELECT unnest(['A', 'B']) AS modality) m),
seg AS (SELECT *, lead(x) OVER s AS ex, lead(y) OVER s AS ey FROM {source} WINDOW s AS (PARTITION BY series ORDER BY idx)),
rd AS (SELECT g.{key} AS k, g.modality, g.g AS idx, g.gx AS x, coalesce(s.y + (g.gx - s.x) / (s.ex - s.x) * (s.ey - s.y), s.y) AS y FROM grid g ASOF JOIN seg s ON g.{key} = s.{key} AND g.modality = s.modality AND g.gx >= s.x),
e AS (SELECT *, y - min(y) OVER (PARTITION BY k, modality) AS e FROM rd),
tr AS (SELECT k, modality, idx, x, e, coalesce((x - lag(x) OVER s) * (e + lag(e) OVER s) / 2, 0) AS t FROM e WINDOW s AS (PARTITION BY k, modality ORDER BY idx)),
cu AS (SELECT k, modality, idx, x, sum(t) OVER (PARTITION BY k, modality ORDER BY idx) / sum(t) OVER (PARTITION BY k, modality) AS c FROM tr),
lo AS (SELECT k, modality, arg_max(x, idx) AS x, arg_max(c, idx) AS c FROM cu WHERE c <= 0.5 GROUP BY ALL), hi AS (SELECT k, modality, arg_min(x, idx) AS x, arg_min(c, idx) AS c FROM cu WHERE c > 0.5 GROUP BY ALL),
q AS (SELECT k, modality, lo.x + (0.5 - lo.c) / (hi.c - lo.c) * (hi.x - lo.x) AS q FROM lo JOIN hi USING (k, modality)),
w AS (SELECT k, idx, round(max(y) FILTER (modality = 'A'), 9) AS ya, round(max(y) FILTER (modality = 'B'), 9) AS yb, max(e) FILTER (modality = 'A') AS ea, max(e) FILTER (modality = 'B') AS eb FROM e GROUP BY ALL),
rk2 AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY ya) + (count(*) OVER (PARTITION BY k, ya) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY k ORDER BY yb) + (count(*) OVER (PARTITION BY k, yb) - 1) / 2.0 AS rb FROM w),
rho AS (SELECT k, corr(ra, rb) AS rho FROM rk2 GROUP BY k), pq AS (SELECT k, ea / sum(ea) OVER (PARTITION BY k) AS p, eb / sum(eb) OVER (PARTITION BY k) AS q FROM w),
js AS (SELECT k, sqrt((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2) AS js FROM pq GROUP BY k)"""


_MOVED = f"""total AS (SELECT count(*) AS n FROM ranked),
blk AS (SELECT r, k AS block, least(100, n - k * 100) AS z, {_hash('20260920', 'r', 'k')} AS h FROM total, (SELECT unnest(range(0, {ENTITY_REPLICATES})) AS r), LATERAL (SELECT unnest(range(0, (n + 99) // 100)) AS k)),
st AS (SELECT r, block, sum(z) OVER (PARTITION BY r ORDER BY h, block) - z AS s FROM blk),
perm AS (SELECT st.r AS replicate, (st.s + p.rk - st.block * 100)::BIGINT AS pos, p.b FROM st JOIN ranked p ON p.rk // 100 = st.block),
bwin AS (SELECT b.replicate, w AS idx, b.b FROM perm b, LATERAL (SELECT unnest(range(greatest(0, floor((b.pos - 400) / 100)::BIGINT + 1), least(b.pos // 100, ((SELECT n FROM total) - 400) // 100)::BIGINT + 1)) AS w)),
moved AS (SELECT replicate, idx, sum(b) / 400 AS y FROM bwin GROUP BY ALL)"""


def _entity_pieces(spark: SparkSession, sf: str) -> tuple:
    """What moves the entities of the second modality in blocks: `moved_windows` up to its seed."""
    r, n = T.ranked(spark, sf)
    pieces = materialize(rs.block_pieces(r.select("rk", "b"), "rk", "b", n, rs.NULL_BLOCK, win.PRIMARY))
    return pieces, "rk", "b", n, rs.NULL_BLOCK, win.PRIMARY, ENTITY_REPLICATES, rs.DISCOVERY_SEED


@query("entity_block_null", f"WITH {T.RANKED}, {_MOVED} SELECT replicate, idx, round(y, 6) AS y FROM moved")
def entity_block_null(spark: SparkSession, sf: str) -> DataFrame:
    return _round(rs.moved_windows(*_entity_pieces(spark, sf)), "y")


_GRID_SIDES = {"absolute_gap": "low", "spearman_rho": "high", "js_distance": "low"}


@query("entity_block_null_summary", f"""WITH {T.PROFILES}, {_MOVED},
one AS (SELECT modality, idx, x, y FROM profile WHERE window_config = '400/100'),
np AS (SELECT modality || '|-1' AS series, -1 AS rep, modality, idx, x, y FROM one UNION ALL SELECT 'A|' || r, r, 'A', idx, x, y FROM one, (SELECT unnest(range(0, {ENTITY_REPLICATES})) AS r) WHERE modality = 'A'
  UNION ALL SELECT 'B|' || m.replicate, m.replicate, 'B', m.idx, o.x, m.y FROM moved m JOIN one o ON o.idx = m.idx AND o.modality = 'A'),
{_grid_sql('np', 'rep')},
gm AS (SELECT k, abs(max(q) FILTER (modality = 'A') - max(q) FILTER (modality = 'B')) AS absolute_gap, any_value(rho) AS spearman_rho, any_value(js) AS js_distance FROM q JOIN rho USING (k) JOIN js USING (k) GROUP BY k),
nul AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, '{s}' AS side, o.{m} AS observed, g.{m} AS v, g.{m} {'<=' if s == 'low' else '>='} o.{m} AS ext FROM gm g, (SELECT * FROM gm WHERE k = -1) o WHERE g.k >= 0" for m, s in _GRID_SIDES.items())})
SELECT metric, side, round(observed, 5) AS observed, count(v) AS n_null, round(avg(v), 5) AS null_mean, round(median(v), 5) AS null_median, round((1 + count(*) FILTER (ext)) / (1 + count(v)), 6) AS p FROM nul GROUP BY metric, side, observed""")
def entity_block_null_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The discovery metrics of the observed curves against those of every permutation, and empirical p."""
    one = materialize(T.profiles(spark, sf, [win.PRIMARY]).select("modality", "idx", "x", "y"))
    m = materialize(rs.moved_grid_alignment(one, *_entity_pieces(spark, sf), "A", "B", *REGION))
    out = report.null_summary(m.where("replicate = -1"), m.where("replicate >= 0"), _GRID_SIDES)
    five = {c: F.round(c, 5) for c in ("observed", "null_mean", "null_median")}
    return out.withColumns(five).select("metric", "side", "observed", "n_null", "null_mean", "null_median", r6(F.col("p")).alias("p"))


@query("discovery_alignment", f"""WITH {T.PROFILES},
{_grid_sql('profile', 'window_config')}
SELECT k AS window_config, round(max(q) FILTER (modality = 'A'), 5) AS q50_a, round(max(q) FILTER (modality = 'B'), 5) AS q50_b, round(any_value(rho), 5) AS spearman_rho, round(any_value(js), 5) AS js_distance FROM q JOIN rho USING (k) JOIN js USING (k) GROUP BY k""")
def discovery_alignment(spark: SparkSession, sf: str) -> DataFrame:
    g = rs.grid_alignment(materialize(T.profiles(spark, sf)), "window_config", "A", "B", *REGION)
    return g.select("window_config", *[F.round(c, 5).alias(c) for c in ("q50_a", "q50_b", "spearman_rho", "js_distance")])
