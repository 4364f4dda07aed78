"""Queries on score curves: shape, peaks, families, event pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import peaks as pk, profiles as pf, report, stats, windows as win
from ..session import materialize
from . import tables as T
from .catalog import query

TOLERANCE_DAYS = 1.5  # the clock of these tables runs over 30 days, not over [0, 1]


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Curves are read several times by the peak steps: computed once."""
    return materialize(T.profiles(spark, sf))


# ----------------------------------------------------------------- SQL building
RUNS = """
chg AS (SELECT *, CASE WHEN y <> lag(y) OVER s THEN 1 ELSE 0 END AS c FROM profile WINDOW s AS (PARTITION BY series ORDER BY idx)),
num AS (SELECT *, sum(c) OVER (PARTITION BY series ORDER BY idx) AS run FROM chg),
runs AS (SELECT series, run, any_value(y) AS y, min(idx) AS f, max(idx) AS l FROM num GROUP BY series, run),
nb AS (SELECT *, lag(y) OVER s AS py, lead(y) OVER s AS ny FROM runs WINDOW s AS (PARTITION BY series ORDER BY run)),
maxima AS (SELECT series, (f + l) // 2 AS idx, y FROM nb WHERE y > py AND y > ny)"""


def prominence_sql(source: str) -> str:
    """Prominence of the peaks in `source` (series, idx, y) over `profile`."""
    return f"""
lims AS (SELECT p.series, p.idx, p.y,
           coalesce((SELECT max(q.idx) FROM profile q WHERE q.series = p.series AND q.idx < p.idx AND q.y > p.y), -1) AS li,
           coalesce((SELECT min(q.idx) FROM profile q WHERE q.series = p.series AND q.idx > p.idx AND q.y > p.y), 1000000000) AS ri FROM {source} p),
lows AS (SELECT p.series, p.idx, p.y,
           (SELECT min(q.y) FROM profile q WHERE q.series = p.series AND q.idx > p.li AND q.idx <= p.idx) AS ll,
           (SELECT min(q.y) FROM profile q WHERE q.series = p.series AND q.idx < p.ri AND q.idx >= p.idx) AS rl, li, ri FROM lims p),
prom AS (SELECT series, idx, y, y - greatest(ll, rl) AS prominence, ll, rl, li, ri FROM lows)"""


EXT = """
ext AS (SELECT series, any_value(modality) AS modality, any_value(window_config) AS window_config, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
          arg_max(idx, y) AS any_top FROM profile GROUP BY series),
tops AS (SELECT p.series, min(p.idx) AS top_idx, min(p.x) AS top_x FROM profile p JOIN ext e ON p.series = e.series AND p.y = e.y1 GROUP BY p.series),
gaps AS (SELECT series, x - lag(x) OVER (PARTITION BY series ORDER BY idx) AS dx FROM profile),
space AS (SELECT series, median(dx) AS sp FROM gaps GROUP BY series)"""

BASE = f"WITH {T.PROFILES}"
VALID = f"""{BASE}, {EXT}, {RUNS}, {prominence_sql('maxima')},
valid AS (SELECT p.series, e.modality, e.window_config, p.idx, c.x, p.y, p.prominence, p.li, p.ri, CASE WHEN y1 > y0 THEN p.prominence / (y1 - y0) END AS prominence_share,
   p.prominence >= greatest(0.005, 0.05 * (y1 - y0)) AS material, (p.idx < 3 OR p.idx >= e.n - 3) AS point_edge,
   least(c.x - e.x0, e.x1 - c.x) <= 2 * s.sp AS position_edge, p.idx = t.top_idx AS is_global_max
 FROM prom p JOIN ext e USING (series) JOIN space s USING (series) JOIN tops t USING (series) JOIN profile c ON c.series = p.series AND c.idx = p.idx)"""


def disc_sql(base: str = T.PROFILES) -> str:
    """Discovery peaks: greedy distance pruning written as the order-by-height recursion."""
    return f"""WITH RECURSIVE {base.lstrip()}, {EXT}, {RUNS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY y DESC, idx DESC) AS o, count(*) OVER (PARTITION BY series) AS m FROM maxima),
pick AS (
  SELECT series, 0::BIGINT AS o, []::BIGINT[] AS kept FROM ordered GROUP BY series
  UNION ALL
  SELECT p.series, p.o + 1, CASE WHEN list_contains(p.kept, d.idx - 2) OR list_contains(p.kept, d.idx + 2) OR list_contains(p.kept, d.idx - 1) OR list_contains(p.kept, d.idx + 1) THEN p.kept ELSE list_append(p.kept, d.idx) END
  FROM pick p JOIN ordered d ON d.series = p.series AND d.o = p.o + 1),
last AS (SELECT series, arg_max(kept, o) AS kept FROM pick GROUP BY series),
spaced AS (SELECT m.* FROM maxima m JOIN last USING (series) WHERE list_contains(kept, m.idx)),
{prominence_sql('spaced').lstrip()},
disc AS (SELECT p.series, e.modality, e.window_config, p.idx, c.x, p.y, p.prominence, p.prominence / (y1 - y0) AS relative_prominence
 FROM prom p JOIN ext e USING (series) JOIN profile c ON c.series = p.series AND c.idx = p.idx WHERE y1 > y0 AND p.prominence >= 0.05 * (y1 - y0))"""


# --------------------------------------------------------------------- queries
@query("top_peak_lag", BASE + f""", {EXT}, {RUNS}, pos AS (SELECT m.series, m.idx, m.y, c.x, c.modality, c.window_config FROM maxima m JOIN profile c ON c.series = m.series AND c.idx = m.idx),
best AS (SELECT modality, window_config, x, row_number() OVER (PARTITION BY series ORDER BY y DESC, idx) AS r FROM pos)
SELECT window_config, round(max(x) FILTER (modality = 'A'), 6) AS a_position, round(max(x) FILTER (modality = 'B'), 6) AS b_position,
  round(max(x) FILTER (modality = 'A') - max(x) FILTER (modality = 'B'), 6) AS lag FROM best WHERE r = 1 GROUP BY window_config""")
def top_peak_lag(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    tall = pk.local_maxima(p).join(p.drop("y"), ["series", "idx"])
    top = tall.groupBy("modality", "window_config").agg(F.max_by("x", F.struct("y", -F.col("idx"))).alias("x"))
    side = lambda m: F.max(F.when(F.col("modality") == m, F.col("x")))
    out = top.groupBy("window_config").agg(side("A").alias("a_position"), side("B").alias("b_position"))
    return _round(out.withColumn("lag", F.col("a_position") - F.col("b_position")), "a_position", "b_position", "lag")


@query("profile_summary", BASE + f""", {EXT}, md AS (SELECT series, median(y) AS m, avg(y) AS a FROM profile GROUP BY series),
rk AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM profile),
rho AS (SELECT series, corr(rx, ry) AS rho FROM rk GROUP BY series)
SELECT series, n AS n_points, round(x0, 6) AS x_min, round(x1, 6) AS x_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max, round(a, 6) AS y_mean, top_idx, round(top_x, 6) AS top_x,
  round(m, 6) AS y_median, round(rho, 6) AS rho_position FROM ext JOIN md USING (series) JOIN rho USING (series) JOIN tops USING (series)""")
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pf.summarize(curves(spark, sf)), "x_min", "x_max", "y_min", "y_max", "y_mean", "top_x", "y_median", "rho_position")


@query("median_spacing", BASE + f""", {EXT} SELECT series, round(sp, 6) AS median_spacing, round(greatest(0.02, 3 * sp), 6) AS tolerance FROM space""")
def median_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pf.family_tolerance(curves(spark, sf)), "median_spacing", "tolerance")


@query("slopes_shape", BASE + """, d AS (SELECT series, (y - lag(y) OVER s) / (x - lag(x) OVER s) AS sl, abs(y - lag(y) OVER s) AS dy FROM profile WINDOW s AS (PARTITION BY series ORDER BY idx)),
e AS (SELECT series, median(abs(sl)) AS m FROM d GROUP BY series), ends AS (SELECT series, arg_max(y, idx) - arg_min(y, idx) AS net FROM profile GROUP BY series)
SELECT series, round(avg(CASE WHEN sl > greatest(1e-12, 0.01 * m) THEN 1 ELSE 0 END), 6) AS fraction_positive, round(avg(CASE WHEN sl < -greatest(1e-12, 0.01 * m) THEN 1 ELSE 0 END), 6) AS fraction_negative,
  round(avg(CASE WHEN abs(sl) <= greatest(1e-12, 0.01 * m) THEN 1 ELSE 0 END), 6) AS fraction_flat, round(sum(dy), 6) AS total_variation, round(any_value(m), 6) AS median_abs_slope, round(max(abs(sl)), 6) AS max_abs_slope,
  round(any_value(net), 6) AS net_change, round(CASE WHEN abs(any_value(net)) > 1e-12 THEN sum(dy) / abs(any_value(net)) END, 5) AS variation_to_net
FROM d JOIN e USING (series) JOIN ends USING (series) WHERE sl IS NOT NULL GROUP BY series""")
def slopes_shape(spark: SparkSession, sf: str) -> DataFrame:
    s = pf.shape(curves(spark, sf)).withColumn("variation_to_net", F.round("variation_to_net", 5))
    return _round(s, "fraction_positive", "fraction_negative", "fraction_flat", "total_variation", "median_abs_slope", "max_abs_slope", "net_change")


@query("near_max_envelope", BASE + f""", {EXT}, lv AS (SELECT unnest([0.9, 0.95, 0.99]) AS level),
t AS (SELECT e.series, level, y0 + level * (y1 - y0) AS thr, top_idx, top_x, n FROM ext e JOIN tops USING (series), lv),
g AS (SELECT t.series, t.level, any_value(thr) AS threshold, any_value(top_x) AS top_x, any_value(n) AS n,
  coalesce(max(idx) FILTER (y < thr AND idx < top_idx) + 1, 0) AS start_idx, coalesce(min(idx) FILTER (y < thr AND idx > top_idx) - 1, any_value(n) - 1) AS end_idx FROM t JOIN profile USING (series) GROUP BY ALL)
SELECT g.series, level, round(threshold, 6) AS threshold, round(top_x, 6) AS top_x, start_idx, end_idx, round(a.x, 6) AS start_x, round(b.x, 6) AS end_x, round(b.x - a.x, 6) AS width,
  end_idx - start_idx + 1 AS n_inside, round((end_idx - start_idx + 1) / n, 6) AS fraction_points
FROM g JOIN profile a ON a.series = g.series AND a.idx = start_idx JOIN profile b ON b.series = g.series AND b.idx = end_idx""")
def near_max_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pf.envelopes(curves(spark, sf), [0.9, 0.95, 0.99]), "threshold", "top_x", "start_x", "end_x", "width", "fraction_points")


@query("contiguous_component", BASE + f""", {EXT}, m AS (SELECT series, median(y) AS m FROM profile GROUP BY series)
SELECT p.series, any_value(top_idx) AS target, coalesce(max(idx) FILTER (y < m AND idx < top_idx) + 1, 0) AS start_idx, coalesce(min(idx) FILTER (y < m AND idx > top_idx) - 1, max(idx)) AS end_idx
FROM profile p JOIN tops USING (series) JOIN m USING (series) GROUP BY p.series""")
def contiguous_component(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    j = p.join(pf.extent(p).select("series", "top_idx"), "series").join(stats.quantiles(p, ["series"], "y", {"m": 0.5}), "series")
    return pf.contiguous_component(j, F.col("y") >= F.col("m"), F.col("top_idx"))


_INTERP = """
g AS (SELECT r.modality, r.x AS gx, r.y AS ry FROM profile r WHERE r.window_config = '400/100'),
alt AS (SELECT *, lead(x) OVER s AS ex, lead(y) OVER s AS ey FROM profile WHERE window_config <> '400/100' WINDOW s AS (PARTITION BY series ORDER BY idx)),
gl AS (SELECT modality, min(gx) AS g0, max(gx) AS g1 FROM g GROUP BY modality),
al AS (SELECT series, modality, min(x) AS x0, max(x) AS x1, arg_max(y, idx) AS yl FROM alt GROUP BY series, modality),
ends AS (SELECT series, modality, greatest(x0, g0) AS lo, least(x1, g1) AS hi, x1, yl FROM al JOIN gl USING (modality)),
rd AS (SELECT e.series, g.gx, g.ry, coalesce((SELECT a.y + (g.gx - a.x) / (a.ex - a.x) * (a.ey - a.y) FROM alt a WHERE a.series = e.series AND a.x <= g.gx AND g.gx < a.ex), e.yl) AS gy
  FROM ends e JOIN g ON g.modality = e.modality AND g.gx BETWEEN e.lo AND e.hi)"""


@query("interp_on_grid", BASE + f", {_INTERP} SELECT series, round(gx, 6) AS gx, round(gy, 6) AS gy FROM rd")
def interp_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    ref = p.where("window_config = '400/100'")
    alt = p.where("window_config <> '400/100'")
    lim = lambda d, k: d.groupBy(*k).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    a = lim(alt, ["series", "modality"]).join(lim(ref, ["modality"]).withColumnsRenamed({"lo": "rlo", "hi": "rhi"}), "modality")
    pts = ref.select("modality", F.col("x").alias("gx")).join(a, "modality").where((F.col("gx") >= F.greatest("lo", "rlo")) & (F.col("gx") <= F.least("hi", "rhi"))).select("series", "gx")
    return _round(pf.interpolate(pts, alt.select("series", "idx", "x", "y"), ["series"]), "gx", "gy")


@query("profile_comparison", BASE + f""", {EXT}, {_INTERP}, rr AS (SELECT series, round(ry, 9) AS ry, round(gy, 9) AS gy FROM rd),
k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY ry) + (count(*) OVER (PARTITION BY series, ry) - 1) / 2.0 AS a, rank() OVER (PARTITION BY series ORDER BY gy) + (count(*) OVER (PARTITION BY series, gy) - 1) / 2.0 AS b FROM rr),
rho AS (SELECT series, corr(a, b) AS spearman FROM k GROUP BY series), s AS (SELECT series, count(*) AS n, corr(ry, gy) AS pearson, avg(abs(ry - gy)) AS mae FROM rd GROUP BY series)
SELECT s.series, round(lo, 6) AS shared_min, round(hi, 6) AS shared_max, n AS n_compared, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mae, 6) AS mae,
  round(rt.top_x, 6) AS reference_top_x, round(tp.top_x, 6) AS alternative_top_x, round(abs(tp.top_x - rt.top_x), 6) AS top_shift
FROM s JOIN rho USING (series) JOIN ends USING (series) JOIN tops tp USING (series) JOIN tops rt ON rt.series = ends.modality || '|400/100'""")
def profile_comparison(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    c = pf.compare(p.where("window_config = '400/100'"), p.where("window_config <> '400/100'"), ["modality"])
    return _round(c, "shared_min", "shared_max", "pearson", "spearman", "mae", "reference_top_x", "alternative_top_x", "top_shift")


@query("q50_mass", BASE + """, t AS (SELECT series, sum(greatest(y, 0)) AS t FROM profile GROUP BY series),
c AS (SELECT series, idx, x, sum(greatest(y, 0)) OVER (PARTITION BY series ORDER BY idx) / t AS c FROM profile JOIN t USING (series)),
lo AS (SELECT series, arg_max(x, idx) AS x, arg_max(c, idx) AS c FROM c WHERE c <= 0.5 GROUP BY series), hi AS (SELECT series, arg_min(x, idx) AS x, arg_min(c, idx) AS c FROM c WHERE c > 0.5 GROUP BY series)
SELECT hi.series, round(CASE WHEN lo.x IS NULL THEN hi.x ELSE lo.x + (0.5 - lo.c) / (hi.c - lo.c) * (hi.x - lo.x) END, 6) AS location FROM hi LEFT JOIN lo USING (series)""")
def q50_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pf.mass_location(curves(spark, sf)), "location")


_TRAP = """
b AS (SELECT series, min(y) AS b FROM profile GROUP BY series), e AS (SELECT series, idx, x, y - b AS e, b FROM profile JOIN b USING (series)),
tr AS (SELECT series, idx, x, b, coalesce((x - lag(x) OVER s) * (e + lag(e) OVER s) / 2, 0) AS t FROM e WINDOW s AS (PARTITION BY series ORDER BY idx)),
cu AS (SELECT series, idx, x, b, sum(t) OVER (PARTITION BY series ORDER BY idx) AS c FROM tr), tt AS (SELECT series, max(c) AS area, any_value(b) AS baseline FROM cu GROUP BY series),
sh AS (SELECT series, idx, x, c / area AS c FROM cu JOIN tt USING (series)), qs AS (SELECT unnest([0.25, 0.5, 0.75]) AS q),
lo AS (SELECT series, q, arg_max(x, idx) AS x, arg_max(c, idx) AS c FROM sh, qs WHERE c <= q GROUP BY ALL), hi AS (SELECT series, q, arg_min(x, idx) AS x, arg_min(c, idx) AS c FROM sh, qs WHERE c > q GROUP BY ALL),
cross_at AS (SELECT series, q, lo.x + (q - lo.c) / (hi.c - lo.c) * (hi.x - lo.x) AS x FROM lo JOIN hi USING (series, q))"""


@query("q50_trapezoid", BASE + f""", {_TRAP}
SELECT tt.series, round(area, 6) AS area, round(baseline, 6) AS baseline, round(max(x) FILTER (q = 0.25), 6) AS q25, round(max(x) FILTER (q = 0.5), 6) AS q50, round(max(x) FILTER (q = 0.75), 6) AS q75
FROM tt JOIN cross_at USING (series) GROUP BY tt.series, area, baseline""")
def q50_trapezoid(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pf.area_quantiles(curves(spark, sf), {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "area", "baseline", "q25", "q50", "q75")


@query("js_divergence", BASE + """, w AS (SELECT window_config, idx, max(y) FILTER (modality = 'A') AS a, max(y) FILTER (modality = 'B') AS b FROM profile GROUP BY ALL),
t AS (SELECT window_config, sum(a) AS sa, sum(b) AS sb FROM w GROUP BY 1), p AS (SELECT window_config, a / sa AS p, b / sb AS q FROM w JOIN t USING (window_config)),
d AS (SELECT window_config, (sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2 AS js FROM p GROUP BY 1)
SELECT window_config, round(js, 6) AS js_divergence, round(sqrt(js), 6) AS js_distance FROM d""")
def js_divergence(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    w = p.groupBy("window_config", "idx").agg(*[F.max(F.when(F.col("modality") == m, F.col("y"))).alias(m.lower()) for m in "AB"])
    return _round(pf.js_divergence(w, ["window_config"], "a", "b"), "js_divergence", "js_distance")


# ----------------------------------------------------------------------- peaks
@query("local_peaks", BASE + f", {RUNS} SELECT series, idx, round(y, 6) AS y FROM maxima")
def local_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pk.local_maxima(curves(spark, sf)), "y")


@query("prominence", BASE + f""", {RUNS}, {prominence_sql('maxima')},
bases AS (SELECT series, idx, (SELECT max(q.idx) FROM profile q WHERE q.series = p.series AND q.idx > p.li AND q.idx <= p.idx AND q.y = p.ll) AS left_base,
  (SELECT min(q.idx) FROM profile q WHERE q.series = p.series AND q.idx < p.ri AND q.idx >= p.idx AND q.y = p.rl) AS right_base FROM prom p)
SELECT series, idx, round(y, 6) AS y, round(ll, 6) AS left_low, round(rl, 6) AS right_low, round(prominence, 6) AS prominence, left_base, right_base FROM prom JOIN bases USING (series, idx)""")
def prominence(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pk.prominences(curves(spark, sf)), "y", "left_low", "right_low", "prominence")


@query("validation_peaks", VALID + """
SELECT series, idx, round(x, 6) AS x, round(y, 6) AS y, round(prominence, 6) AS prominence, round(prominence_share, 6) AS prominence_share, material, point_edge, position_edge, point_edge OR position_edge AS edge, is_global_max FROM valid""")
def validation_peaks(spark: SparkSession, sf: str) -> DataFrame:
    v = pk.validation_peaks(curves(spark, sf)).drop("left_base", "right_base")
    return _round(v, "x", "y", "prominence", "prominence_share")


@query("half_height_width", VALID + """, h AS (SELECT series, idx, y - prominence / 2 AS level FROM valid),
c AS (SELECT h.*, (SELECT max(q.idx) FROM profile q WHERE q.series = h.series AND q.idx < h.idx AND q.y < level) AS li, (SELECT min(q.idx) FROM profile q WHERE q.series = h.series AND q.idx > h.idx AND q.y < level) AS ri FROM h),
w AS (SELECT c.series, c.idx, l.x + (level - l.y) / (l2.y - l.y) * (l2.x - l.x) AS lx, r.x + (level - r.y) / (r2.y - r.y) * (r2.x - r.x) AS rx FROM c
 JOIN profile l ON l.series = c.series AND l.idx = li JOIN profile l2 ON l2.series = c.series AND l2.idx = li + 1 JOIN profile r ON r.series = c.series AND r.idx = ri JOIN profile r2 ON r2.series = c.series AND r2.idx = ri - 1)
SELECT series, idx, round(lx, 6) AS left_x, round(rx, 6) AS right_x, round(rx - lx, 6) AS half_width FROM w""")
def half_height_width(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    return _round(pk.half_height(p, pk.prominences(p)), "left_x", "right_x", "half_width")


@query("discovery_peaks", disc_sql() + " SELECT series, idx, round(x, 6) AS x, round(y, 6) AS y, round(prominence, 6) AS prominence, round(relative_prominence, 6) AS relative_prominence FROM disc")
def discovery_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pk.discovery_peaks(curves(spark, sf)), "x", "y", "prominence", "relative_prominence")


def _named(df: DataFrame) -> DataFrame:
    part = F.split("series", r"\|")
    return df.select("*", part[0].alias("modality"), part[1].alias("window_config"))


def discovery_members(p: DataFrame) -> DataFrame:
    return pk.greedy_families(_named(pk.discovery_peaks(p)), TOLERANCE_DAYS)


_GREEDY = f"""
seq AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY x, series || '|' || idx) - 1 AS k FROM disc),
walk AS (
  SELECT modality, k, x, 0 AS family_id, [x] AS members FROM seq WHERE k = 0
  UNION ALL
  SELECT s.modality, s.k, s.x, CASE WHEN s.x - list_aggregate(w.members, 'median') > {TOLERANCE_DAYS} THEN w.family_id + 1 ELSE w.family_id END,
         CASE WHEN s.x - list_aggregate(w.members, 'median') > {TOLERANCE_DAYS} THEN [s.x] ELSE list_append(w.members, s.x) END
  FROM walk w JOIN seq s ON s.modality = w.modality AND s.k = w.k + 1),
members AS (SELECT s.*, w.family_id FROM seq s JOIN walk w USING (modality, k)),
fam AS (SELECT modality, family_id, count(DISTINCT window_config) AS n_designs, max(x) - min(x) AS spread, median(x) AS center, median(relative_prominence) AS mp FROM members GROUP BY ALL)"""


@query("greedy_families", disc_sql() + f""", {_GREEDY}
SELECT modality, window_config, idx, round(x, 6) AS x, family_id FROM members""")
def greedy_families(spark: SparkSession, sf: str) -> DataFrame:
    return _round(discovery_members(curves(spark, sf)).select("modality", "window_config", "idx", "x", "family_id"), "x")


@query("discovery_families", disc_sql() + f""", {_GREEDY}
SELECT modality, family_id, n_designs, round(spread, 6) AS spread, round(center, 6) AS center, round(mp, 6) AS median_prominence, (n_designs = 3 AND spread <= 1.875 AND mp >= 0.05) AS robust FROM fam""")
def discovery_families(spark: SparkSession, sf: str) -> DataFrame:
    return _round(pk.discovery_family_table(discovery_members(curves(spark, sf)), max_spread=1.875), "spread", "center", "median_prominence")


def validation_members(p: DataFrame) -> DataFrame:
    v = _named(pk.validation_peaks(p)).where("material")
    tol = pf.family_tolerance(p.where("series = 'A|400/100'")).select("tolerance")  # one row: the primary design's resolution
    return pk.complete_linkage(v.crossJoin(F.broadcast(tol)), F.col("tolerance")).drop("tolerance")


_LINKAGE = """
tol AS (SELECT greatest(0.02, 3 * sp) AS tol FROM space WHERE series = 'A|400/100'),
pts AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY x, series || '|' || idx) - 1 AS k FROM valid WHERE material),
start AS (SELECT modality, list({'lo': x, 'hi': x, 'k': k} ORDER BY k) AS cl FROM pts GROUP BY modality),
merge AS (
  SELECT modality, cl, true AS go FROM start
  UNION ALL
  SELECT modality, CASE WHEN w <= (SELECT tol FROM tol) THEN list_concat(list_append(cl[1:j - 1], {'lo': cl[j].lo, 'hi': cl[j + 1].hi, 'k': cl[j].k}), cl[j + 2:]) ELSE cl END, w <= (SELECT tol FROM tol) AND len(cl) > 2
  FROM (SELECT modality, cl, list_min(list_transform(range(1, len(cl)), lambda i: cl[i + 1].hi - cl[i].lo)) AS w,
          list_position(list_transform(range(1, len(cl)), lambda i: cl[i + 1].hi - cl[i].lo), list_min(list_transform(range(1, len(cl)), lambda i: cl[i + 1].hi - cl[i].lo))) AS j FROM merge WHERE go AND len(cl) > 1)),
done AS (SELECT modality, arg_min(cl, len(cl)) AS cl FROM merge GROUP BY modality),
heads AS (SELECT modality, unnest(list_transform(cl, lambda c: c.k)) AS k FROM done),
members AS (SELECT p.*, (SELECT count(*) FROM heads h WHERE h.modality = p.modality AND h.k <= p.k) AS family_id FROM pts p),
fam AS (SELECT modality, family_id, count(*) AS n_peaks, min(x) AS x_min, max(x) AS x_max, count(DISTINCT window_config) AS n_designs, string_agg(DISTINCT window_config, ',' ORDER BY window_config) AS window_configs,
  bool_or(window_config = '400/100') AS has_primary, count(DISTINCT window_config) FILTER (NOT (point_edge OR position_edge)) AS n_interior_designs, max(prominence) AS max_prominence,
  avg(CASE WHEN point_edge OR position_edge THEN 1 ELSE 0 END) AS edge_fraction, median(x) AS center, median(prominence) AS median_prominence, median(y) AS median_height, median(prominence_share) AS median_prominence_share FROM members GROUP BY ALL)"""

VALID_R = VALID.replace("WITH ", "WITH RECURSIVE ", 1)


@query("linkage_families", VALID_R + f", {_LINKAGE} SELECT modality, window_config, idx, round(x, 6) AS x, family_id FROM members")
def linkage_families(spark: SparkSession, sf: str) -> DataFrame:
    return _round(validation_members(curves(spark, sf)).select("modality", "window_config", "idx", "x", "family_id"), "x")


REGION = (8.0, 15.0, 24.0)  # q25, median, q75 of the landmark label on this clock

_VFAM = """
SELECT modality, family_id, n_peaks, x_min, x_max, x_max - x_min AS span, n_designs, window_configs, has_primary, n_interior_designs, max_prominence, edge_fraction, center, median_prominence, median_height, median_prominence_share,
  n_designs >= 2 AND has_primary AS robust, n_designs >= 2 AND has_primary AND n_interior_designs >= 2 AS robust_interior, n_designs = 3 AS all_designs, center BETWEEN 8.0 AND 24.0 AS inside_region, center - 15.0 AS distance_to_landmark FROM fam"""


@query("validation_families", VALID_R + f""", {_LINKAGE}, f AS ({_VFAM})
SELECT * REPLACE (round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(span, 6) AS span, round(max_prominence, 6) AS max_prominence, round(edge_fraction, 6) AS edge_fraction, round(center, 6) AS center,
 round(median_prominence, 6) AS median_prominence, round(median_height, 6) AS median_height, round(median_prominence_share, 6) AS median_prominence_share, round(distance_to_landmark, 6) AS distance_to_landmark) FROM f""")
def validation_families(spark: SparkSession, sf: str) -> DataFrame:
    f = pk.validation_family_table(validation_members(curves(spark, sf)), "400/100", region=REGION)
    return _round(f, "x_min", "x_max", "span", "max_prominence", "edge_fraction", "center", "median_prominence", "median_height", "median_prominence_share", "distance_to_landmark")


_SELECT = f"""f AS ({_VFAM}), sel AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY all_designs DESC, abs(distance_to_landmark), n_designs DESC, median_prominence DESC, center) AS r FROM f WHERE robust_interior AND inside_region)"""


@query("family_selection", VALID_R + f""", {_LINKAGE}, {_SELECT}
SELECT list_position(['A', 'B'], f.modality) AS modality_order, f.modality, f.family_id, round(f.center, 6) AS center, f.n_designs, f.n_interior_designs, round(f.median_prominence, 6) AS median_prominence,
  round(f.distance_to_landmark, 6) AS distance_to_landmark, f.all_designs AS in_all_designs, f.robust_interior, f.inside_region, coalesce(s.r = 1, false) AS selected FROM f LEFT JOIN sel s ON s.modality = f.modality AND s.family_id = f.family_id""")
def family_selection(spark: SparkSession, sf: str) -> DataFrame:
    f = materialize(pk.validation_family_table(validation_members(curves(spark, sf)), "400/100", region=REGION))
    return _round(report.family_selection(f, pk.select_family(f), ["A", "B"]), "center", "median_prominence", "distance_to_landmark")


@query("frozen_pair_windows", VALID_R + f""", {_LINKAGE}, {_SELECT}, pr AS (SELECT max(family_id) FILTER (modality = 'A') AS a, max(family_id) FILTER (modality = 'B') AS b FROM sel WHERE r = 1)
SELECT pr.a AS a_family_id, pr.b AS b_family_id, x.window_config, round(x.x, 6) AS a_x, round(y.x, 6) AS b_x, round(x.x - y.x, 6) AS lag, y.x < x.x AS b_first
FROM pr JOIN members x ON x.modality = 'A' AND x.family_id = pr.a JOIN members y ON y.modality = 'B' AND y.family_id = pr.b AND y.window_config = x.window_config""")
def frozen_pair_windows(spark: SparkSession, sf: str, stored: DataFrame | None = None) -> DataFrame:
    m = materialize(validation_members(curves(spark, sf) if stored is None else stored))
    chosen = pk.select_family(pk.validation_family_table(m, "400/100", region=REGION))
    side = lambda x: F.max(F.when(F.col("modality") == x, F.col("family_id")))
    pair = chosen.agg(side("A").alias("a_family_id"), side("B").alias("b_family_id"))
    return _round(pk.design_pairs(pair, m, "A", "B"), "a_x", "b_x", "lag")


_TRANS = "trans AS (SELECT * FROM (VALUES ('one -> two', 0.0, 4.0, 11.0), ('two -> three', 4.0, 11.0, 19.0), ('three -> four', 11.0, 19.0, 27.0)) t(transition, upstream_limit, lower, upper))"


def _transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("one -> two", 0.0, 4.0, 11.0), ("two -> three", 4.0, 11.0, 19.0), ("three -> four", 11.0, 19.0, 27.0)], "transition string, upstream_limit double, lower double, upper double")


@query("transition_pairs", disc_sql() + f""", {_GREEDY}, {_TRANS}, f AS (SELECT *, n_designs = 3 AND spread <= 1.875 AND mp >= 0.05 AS robust FROM fam),
asg AS (SELECT f.*, t.*, count(*) OVER (PARTITION BY modality, family_id) AS c FROM f JOIN trans t ON f.center BETWEEN t.lower AND t.upper),
cand AS (SELECT a.family_id AS a_family_id, a.center AS a_center, a.transition, b.family_id AS bf, b.center AS bc FROM asg a JOIN f b ON b.modality = 'B' AND b.robust AND b.center >= a.upstream_limit AND b.center < a.center WHERE a.c = 1 AND a.modality = 'A' AND a.robust)
SELECT a_family_id, round(a_center, 6) AS a_center, transition, arg_max(bf, bc) AS b_family_id, round(max(bc), 6) AS b_center, count(*) AS n_candidates FROM cand GROUP BY a_family_id, a_center, transition""")
def transition_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = materialize(pk.discovery_family_table(discovery_members(curves(spark, sf)), max_spread=1.875))
    a = pk.assign_transition(f.where("modality = 'A'"), _transitions(spark))
    return _round(pk.upstream_family(a, f.where("modality = 'B'")), "a_center", "b_center")


@query("directional_consistency", disc_sql() + f""", {_GREEDY}, j AS (SELECT a.family_id AS fa, b.family_id AS fb, a.x - b.x AS lag FROM members a JOIN members b ON a.window_config = b.window_config AND a.modality = 'A' AND b.modality = 'B' AND a.family_id = b.family_id)
SELECT fa AS a_family_id, fb AS b_family_id, count(*) AS n_pairs, round(min(lag), 6) AS lag_min, round(max(lag), 6) AS lag_max, bool_and(lag > 0) AND count(*) = 3 AS consistent FROM j GROUP BY fa, fb""")
def directional_consistency(spark: SparkSession, sf: str) -> DataFrame:
    m = materialize(discovery_members(curves(spark, sf)))
    shared = m.groupBy("family_id").agg(F.count_distinct("modality").alias("k")).where("k = 2").select(F.col("family_id").alias("a_family_id"), F.col("family_id").alias("b_family_id"))
    return _round(pk.directional_consistency(pk.design_pairs(shared, m, "A", "B")), "lag_min", "lag_max")


@query("tracked_peaks", VALID + """, c AS (SELECT *, abs(x - CASE modality WHEN 'A' THEN 12.0 ELSE 11.0 END) AS d, material AND NOT (point_edge OR position_edge) AND abs(x - CASE modality WHEN 'A' THEN 12.0 ELSE 11.0 END) <= 2 AS ok FROM valid),
b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ok DESC, d, prominence DESC, x) AS r, count(*) FILTER (ok) OVER (PARTITION BY series) AS n FROM c)
SELECT series, modality, n AS n_eligible, n > 0 AS detected, round(CASE WHEN ok THEN x END, 6) AS peak_x, round(CASE WHEN ok THEN prominence END, 6) AS peak_prominence, round(CASE WHEN ok THEN d END, 6) AS distance_to_center FROM b WHERE r = 1""")
def tracked_peaks(spark: SparkSession, sf: str) -> DataFrame:
    v = _named(pk.validation_peaks(curves(spark, sf)))
    return _round(pk.track(v, {"A": 12.0, "B": 11.0}, 2.0, F.col("material") & ~F.col("edge")), "peak_x", "peak_prominence", "distance_to_center")


@query("peak_stability", disc_sql() + """, ctr AS (SELECT series, modality, CASE modality WHEN 'A' THEN 12.0 ELSE 11.0 END AS c FROM ext),
near AS (SELECT p.series, p.idx, p.x, p.y, abs(p.y - lag(p.y) OVER (PARTITION BY p.series ORDER BY p.idx)) AS dy FROM profile p JOIN ctr USING (series) WHERE abs(p.x - c) <= 2),
loc AS (SELECT series, max(y) - min(y) AS rng, avg(dy) AS rough, max(y) AS top FROM near GROUP BY series HAVING count(*) >= 2),
pla AS (SELECT series, max(x) - min(x) AS w FROM near JOIN loc USING (series) WHERE y >= 0.9 * top GROUP BY series),
el AS (SELECT series, count(*) FILTER (abs(x - c) <= 2) AS ne, count(*) AS np, arg_min(x, abs(x - c)) AS bx, arg_max(x, {'a': y, 'b': -idx}) AS sx FROM disc JOIN ctr USING (series) GROUP BY series)
SELECT ctr.series, ctr.modality, coalesce(ne, 0) > 0 AS detected, coalesce(ne, 0) AS n_eligible, coalesce(np, 0) AS n_peaks, round(CASE WHEN ne > 0 THEN bx END, 6) AS peak_x, round(sx, 6) AS strongest_x, round(abs(sx - c), 6) AS strongest_distance,
  round(rng, 6) AS local_range, round(rough, 6) AS roughness, round(w, 6) AS plateau_width FROM ctr LEFT JOIN el USING (series) LEFT JOIN loc USING (series) LEFT JOIN pla USING (series)""")
def peak_stability(spark: SparkSession, sf: str) -> DataFrame:
    p = curves(spark, sf)
    d = _named(pk.discovery_peaks(p))
    return _round(pk.stability(p, d, {"A": 12.0, "B": 11.0}, 2.0), "peak_x", "strongest_x", "strongest_distance", "local_range", "roughness", "plateau_width")


@query("unique_peaks", VALID + """ SELECT modality, round(x, 3) AS x, min(idx) AS idx FROM valid GROUP BY ALL""")
def unique_peaks(spark: SparkSession, sf: str) -> DataFrame:
    v = _named(pk.validation_peaks(curves(spark, sf))).select("modality", F.round("x", 3).alias("x"), "idx")
    return pk.unique_peaks(v, ["modality", "x"], ["idx"])
