"""Queries on counts and vectors: normalisation, feature choice, contrasts, centring, axes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..functions.vectors import doubles, norm
from ..operators import counts as ct, decompose, representation as rep, stats
from ..session import materialize
from . import tables as T
from .catalog import query


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _n_orders(spark: SparkSession, sf: str) -> int:
    return T.order_counts(spark, sf).select("entity").distinct().count()


# ---------------------------------------------------------------------- counts
@query("library_depth", f"WITH {T.COUNTS} SELECT entity, sum(count) AS total, count(*) AS n_detected FROM counts GROUP BY entity")
def library_depth(spark: SparkSession, sf: str) -> DataFrame:
    return ct.depth(T.order_counts(spark, sf))


_LOG = f"{T.COUNTS}, lg AS (SELECT entity, feature, ln(1 + count / sum(count) OVER (PARTITION BY entity) * 10000) AS value FROM counts), ne AS (SELECT count(DISTINCT entity) AS n FROM counts)"


@query("library_lognorm", f"WITH {_LOG} SELECT entity, feature, round(value, 6) AS value FROM lg")
def library_lognorm(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ct.log_normalized(T.order_counts(spark, sf)), "value")


_MOM = "SELECT feature, count(*) AS n_detected, sum(value) / any_value(n) AS mean, greatest((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - {d}), 0) AS variance FROM lg, ne GROUP BY feature"


@query("hvg_moments", f"WITH {_LOG}, p AS ({_MOM.format(d=0)}), s AS ({_MOM.format(d=1)}) SELECT feature, p.n_detected, round(p.mean, 6) AS mean, round(p.variance, 6) AS variance_population, round(s.variance, 6) AS variance_sample FROM p JOIN s USING (feature)")
def hvg_moments(spark: SparkSession, sf: str) -> DataFrame:
    v, n = ct.log_normalized(T.order_counts(spark, sf)), _n_orders(spark, sf)
    p = ct.feature_moments(v, n, sample=False).withColumnRenamed("variance", "variance_population")
    s = ct.feature_moments(v, n, sample=True).select("feature", F.col("variance").alias("variance_sample"))
    return _round(p.join(s, "feature"), "mean", "variance_population", "variance_sample")


@query("hvg_topk", f"WITH {_LOG}, m AS ({_MOM.format(d=1)}) SELECT feature, round(variance, 6) AS variance FROM (SELECT feature, round(variance, 9) AS variance FROM m) ORDER BY variance DESC, feature LIMIT {ct.TOP_FEATURES_A}")
def hvg_topk(spark: SparkSession, sf: str) -> DataFrame:
    m = ct.feature_moments(ct.log_normalized(T.order_counts(spark, sf)), _n_orders(spark, sf), sample=True)
    top = ct.top_features(m.withColumn("variance", F.round("variance", 9)), ct.TOP_FEATURES_A)
    return _round(top.select("feature", "variance"), "variance")


@query("scaled_clipped", f"WITH {_LOG}, m AS ({_MOM.format(d=1)}) SELECT entity, feature, round(least(10, greatest(-10, (value - mean) / CASE WHEN variance > 0 THEN sqrt(variance) ELSE 1 END)), 6) AS z FROM lg JOIN m USING (feature)")
def scaled_clipped(spark: SparkSession, sf: str) -> DataFrame:
    v = ct.log_normalized(T.order_counts(spark, sf))
    return _round(ct.scaled(v, ct.feature_moments(v, _n_orders(spark, sf), sample=True)).select("entity", "feature", "z"), "z")


@query("document_frequency", f"WITH {T.COUNTS} SELECT feature, count(DISTINCT entity) AS df FROM counts GROUP BY feature")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return T.order_counts(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("df"))  # one row per pair already


@query("tfidf_binary", f"""WITH {T.COUNTS}, r AS (SELECT entity, count(*) AS n FROM counts GROUP BY 1), d AS (SELECT feature, count(*) AS df FROM counts GROUP BY 1), ne AS (SELECT count(DISTINCT entity) AS n FROM counts)
SELECT entity, feature, df, round(1.0::DOUBLE / r.n * ln(1 + ne.n / (1 + df)), 6) AS value FROM counts JOIN r USING (entity) JOIN d USING (feature), ne""")
def tfidf_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(ct.tfidf(T.order_counts(spark, sf), _n_orders(spark, sf)), "value")


@query("support_topk", f"WITH {T.COUNTS} SELECT feature, n_detected FROM (SELECT feature, count(*) AS n_detected FROM counts GROUP BY 1) ORDER BY n_detected DESC, feature LIMIT {ct.TOP_FEATURES_B}")
def support_topk(spark: SparkSession, sf: str) -> DataFrame:
    support = T.order_counts(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("n_detected"))
    return ct.top_features(support, ct.TOP_FEATURES_B, "n_detected")


@query("zero_depth_entities", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def zero_depth_entities(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").select("o_orderkey")
    return ct.require_depth(o, T.order_counts(spark, sf), "o_orderkey")


# ------------------------------------------------------------- group contrasts
GROUPS = ["pre", "event", "late"]


def _grouped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Orders grouped by the suppliers they buy from; feature = supplier."""
    from ..operators.counts import collapse

    li = T.table(spark, sf, "lineitem")
    low = F.min(F.col("l_suppkey") % 50)
    groups = li.groupBy(F.col("l_orderkey").alias("entity")).agg(F.when(low < 5, "late").when(low < 10, "event").otherwise("pre").alias("group"))
    sizes = {r["group"]: r["n"] for r in groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    return collapse(li, "l_orderkey", "l_suppkey", F.col("l_quantity")), groups, {g: sizes.get(g, 0) for g in GROUPS}


_GRP = """
li AS (SELECT l_orderkey AS entity, l_suppkey AS feature, l_quantity FROM lineitem),
grp AS (SELECT entity, CASE WHEN min(feature % 50) < 5 THEN 'late' WHEN min(feature % 50) < 10 THEN 'event' ELSE 'pre' END AS g FROM li GROUP BY entity),
cnt AS (SELECT entity, feature, sum(l_quantity) AS c FROM li GROUP BY ALL), t AS (SELECT * FROM cnt JOIN grp USING (entity)),
z AS (SELECT count(*) FILTER (g = 'pre') AS zp, count(*) FILTER (g = 'event') AS ze, count(*) FILTER (g = 'late') AS zl FROM grp),
lib AS (SELECT sum(c) FILTER (g = 'pre') AS lp, sum(c) FILTER (g = 'event') AS le, sum(c) FILTER (g = 'late') AS ll FROM t),
w AS (SELECT feature, coalesce(sum(c) FILTER (g = 'pre'), 0) AS pre_count, coalesce(sum(c) FILTER (g = 'event'), 0) AS event_count, coalesce(sum(c) FILTER (g = 'late'), 0) AS late_count,
  count(*) FILTER (g = 'pre') AS pre_detected, count(*) FILTER (g = 'event') AS event_detected, count(*) FILTER (g = 'late') AS late_detected FROM t GROUP BY feature),
eff AS (SELECT w.*, pre_count / lp * 1e6 AS pre_cpm, event_count / le * 1e6 AS event_cpm, late_count / ll * 1e6 AS late_cpm, pre_detected / nullif(zp, 0) AS pre_fraction, event_detected / nullif(ze, 0) AS event_fraction, late_detected / nullif(zl, 0) AS late_fraction,
  log2((event_count / le * 1e6 + 0.5) / (pre_count / lp * 1e6 + 0.5)) AS log2fc_event_vs_pre, event_detected / nullif(ze, 0) - pre_detected / nullif(zp, 0) AS delta_event_vs_pre,
  log2((late_count / ll * 1e6 + 0.5) / (event_count / le * 1e6 + 0.5)) AS log2fc_late_vs_event, late_detected / nullif(zl, 0) - event_detected / nullif(ze, 0) AS delta_late_vs_event FROM w, z, lib)"""
_NUM = ["pre_cpm", "event_cpm", "late_cpm", "pre_fraction", "event_fraction", "late_fraction", "log2fc_event_vs_pre", "delta_event_vs_pre", "log2fc_late_vs_event", "delta_late_vs_event"]
_EFF_COLS = "feature, pre_count, event_count, late_count, pre_detected, event_detected, late_detected, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM)


def _effects(spark: SparkSession, sf: str) -> DataFrame:
    c, g, sizes = _grouped(spark, sf)
    return ct.group_effects(c, g, GROUPS, sizes)


@query("group_cpm_log2fc", f"WITH {_GRP} SELECT {_EFF_COLS} FROM eff")
def group_cpm_log2fc(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_effects(spark, sf), *_NUM)


@query("threshold_candidates", f"""WITH {_GRP}
SELECT 'later_increase' AS candidate_class, feature, round(late_cpm, 6) AS cpm FROM eff WHERE late_fraction >= 0.05 AND late_cpm >= 2 AND log2fc_late_vs_event >= 0.5 AND delta_late_vs_event >= 0.02
UNION ALL SELECT 'event_increase', feature, round(event_cpm, 6) FROM eff WHERE event_fraction >= 0.05 AND event_cpm >= 2 AND log2fc_event_vs_pre >= 0.5 AND delta_event_vs_pre >= 0.02""")
def threshold_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = ct.a_candidates(_effects(spark, sf), GROUPS)
    return c.select("candidate_class", "feature", r6(F.when(F.col("candidate_class") == "later_increase", F.col("late_cpm")).otherwise(F.col("event_cpm"))).alias("cpm"))


@query("ranked_top", f"WITH {_GRP} SELECT 'later' AS candidate_class, feature, round(log2fc_late_vs_event, 6) AS log2fc_late_vs_event FROM eff WHERE late_cpm >= 1 ORDER BY round(log2fc_late_vs_event, 9) DESC, late_cpm DESC, feature LIMIT 20")
def ranked_top(spark: SparkSession, sf: str) -> DataFrame:
    e = _effects(spark, sf).where("late_cpm >= 1")
    top = ct.ranked_top(e, "later", [F.round("log2fc_late_vs_event", 9).desc(), F.col("late_cpm").desc(), F.col("feature")], 20)
    return _round(top.select("candidate_class", "feature", "log2fc_late_vs_event"), "log2fc_late_vs_event")


_PRES = f"""{_GRP}, pe AS (SELECT feature, count(*) FILTER (g = 'pre') AS pre_entities, count(*) FILTER (g = 'event') AS event_entities, count(*) FILTER (g = 'late') AS late_entities,
  count(*) FILTER (g = 'pre') / nullif(any_value(zp), 0) AS pre_fraction, count(*) FILTER (g = 'event') / nullif(any_value(ze), 0) AS event_fraction, count(*) FILTER (g = 'late') / nullif(any_value(zl), 0) AS late_fraction,
  coalesce(sum(c) FILTER (g = 'event'), 0) / nullif(any_value(ze), 0) AS event_mean FROM t, z GROUP BY feature)"""


@query("presence_effects", f"""WITH {_PRES} SELECT feature, pre_entities, event_entities, late_entities, round(pre_fraction, 6) AS pre_fraction, round(event_fraction, 6) AS event_fraction, round(late_fraction, 6) AS late_fraction, round(event_mean, 6) AS event_mean,
  round(event_fraction - pre_fraction, 6) AS delta_event_vs_pre, round(log2((event_fraction + 1e-4) / (pre_fraction + 1e-4)), 6) AS log2ratio_event_vs_pre FROM pe""")
def presence_effects(spark: SparkSession, sf: str) -> DataFrame:
    c, g, sizes = _grouped(spark, sf)
    e = ct.presence_effects(c, g, GROUPS, sizes)
    cols = ["pre_fraction", "event_fraction", "late_fraction", "event_mean", "delta_event_vs_pre", "log2ratio_event_vs_pre"]
    return _round(e.select("feature", "pre_entities", "event_entities", "late_entities", *cols), *cols)


@query("opening_candidates", f"WITH {_PRES} SELECT feature, round(event_fraction - pre_fraction, 6) AS gain FROM pe WHERE event_fraction - pre_fraction >= 0.05 AND event_fraction >= 0.05")
def opening_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c, g, sizes = _grouped(spark, sf)
    return ct.b_candidates(ct.presence_effects(c, g, GROUPS, sizes), GROUPS).select("feature", r6(F.col("delta_event_vs_pre")).alias("gain"))


# -------------------------------------------------------------- representation
@query("stage_centering", f"""WITH {T.VECTORS}, s AS (SELECT stage, batch, dimension, avg(xa) AS m FROM dims GROUP BY ALL), g AS (SELECT stage, dimension, avg(xa) AS m FROM dims GROUP BY ALL), k AS (SELECT stage, count(DISTINCT batch) AS k FROM dims GROUP BY stage)
SELECT id, dimension, round(xa - CASE WHEN k > 1 THEN s.m - g.m ELSE 0 END, 6) AS x FROM dims JOIN s USING (stage, batch, dimension) JOIN g USING (stage, dimension) JOIN k USING (stage)""")
def stage_centering(spark: SparkSession, sf: str) -> DataFrame:
    moved, _ = rep.stage_centering(T.vectors(spark, sf), "stage", "batch", "va", T.DIMS)
    return moved.select("id", F.posexplode("va").alias("p", "x")).select("id", (F.col("p") + 1).alias("dimension"), r6(F.col("x")).alias("x"))


@query("centering_shifts", f"""WITH {T.VECTORS}, s AS (SELECT stage, batch, dimension, avg(xa) AS m, count(*) AS n FROM dims GROUP BY ALL), g AS (SELECT stage, dimension, avg(xa) AS m FROM dims GROUP BY ALL)
SELECT stage, batch, any_value(n) AS n, true AS applied, round(sqrt(sum((s.m - g.m) * (s.m - g.m))), 6) AS shift_norm FROM s JOIN g USING (stage, dimension) GROUP BY stage, batch""")
def centering_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return _round(rep.stage_centering(T.vectors(spark, sf), "stage", "batch", "va", T.DIMS)[1], "shift_norm")


_COV = "SELECT id, sqrt(sum(xb * xb)) AS depth, any_value(xa) FILTER (dimension = 3) * 2 + any_value(xb) FILTER (dimension = 1) / 50 AS drift FROM dims GROUP BY id"
_AXES = f"""{T.VECTORS}, cov AS ({_COV}), lng AS (SELECT dimension, xa AS x, 'depth' AS covariate, depth AS y FROM dims JOIN cov USING (id) UNION ALL SELECT dimension, xa, 'drift', drift FROM dims JOIN cov USING (id)),
rk AS (SELECT dimension, covariate, rank() OVER (PARTITION BY dimension, covariate ORDER BY x) AS a, rank() OVER (PARTITION BY dimension, covariate ORDER BY y) AS b FROM lng), axes AS (SELECT dimension, covariate, corr(a, b) AS rho FROM rk GROUP BY ALL)"""


def _axes(spark: SparkSession, sf: str) -> DataFrame:
    v = T.vectors(spark, sf)
    drift = F.col("va")[2] * 2 + F.col("vb")[0] / 50
    return rep.axis_correlations(v.select("va", norm(F.col("vb")).alias("depth"), drift.alias("drift")), "va", ["depth", "drift"])


@query("axis_correlations", f"WITH {_AXES} SELECT dimension, covariate, round(rho, 6) AS rho, round(abs(rho), 6) AS abs_rho FROM axes")
def axis_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_axes(spark, sf), "rho", "abs_rho")


@query("depth_axis_filter", f"WITH {_AXES} SELECT dimension, round(max(abs(rho)), 6) AS max_abs_rho, max(abs(rho)) >= 0.8 AS technical FROM axes GROUP BY dimension")
def depth_axis_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _round(rep.technical_axes(_axes(spark, sf)), "max_abs_rho")


@query("filtered_vectors", f"WITH {_AXES}, bad AS (SELECT dimension FROM axes GROUP BY dimension HAVING max(abs(rho)) >= 0.8) SELECT id, count(*) AS n_axes, round(sum(xa), 6) AS total FROM dims WHERE dimension NOT IN (SELECT dimension FROM bad) GROUP BY id")
def filtered_vectors(spark: SparkSession, sf: str) -> DataFrame:
    bad = [r["dimension"] for r in rep.technical_axes(_axes(spark, sf)).where("technical").select("dimension").collect()]
    kept = rep.drop_axes(T.vectors(spark, sf), "va", bad)
    return kept.select("id", F.size("va").cast("bigint").alias("n_axes"), r6(F.aggregate("va", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_CENT = f"""{T.VECTORS}, c AS (SELECT label, dimension, avg(xa) AS m FROM dims WHERE label IN (SELECT label FROM vectors GROUP BY label HAVING count(*) >= 20) GROUP BY ALL),
cd AS (SELECT x.label AS a, y.label AS b, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM c x JOIN c y ON x.dimension = y.dimension AND x.label < y.label GROUP BY ALL)"""


@query("centroid_distances", f"WITH {_CENT} SELECT a, b, round(d, 6) AS distance FROM cd")
def centroid_distances(spark: SparkSession, sf: str) -> DataFrame:
    return _round(rep.centroid_distances(T.vectors(spark, sf), ["label"], "va", T.DIMS), "distance")


@query("geometry_rho", f"""WITH {_CENT}, s AS (SELECT stage, batch, dimension, avg(xa) AS m FROM dims GROUP BY ALL), g AS (SELECT stage, dimension, avg(xa) AS m FROM dims GROUP BY ALL),
mv AS (SELECT id, label, dimension, xa - (s.m - g.m) AS x FROM dims JOIN s USING (stage, batch, dimension) JOIN g USING (stage, dimension)),
c2 AS (SELECT label, dimension, avg(x) AS m FROM mv WHERE label IN (SELECT label FROM c) GROUP BY ALL),
cd2 AS (SELECT x.label AS a, y.label AS b, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM c2 x JOIN c2 y ON x.dimension = y.dimension AND x.label < y.label GROUP BY ALL),
rk AS (SELECT rank() OVER (ORDER BY round(cd.d, 9)) AS p, rank() OVER (ORDER BY round(cd2.d, 9)) AS q FROM cd JOIN cd2 USING (a, b))
SELECT count(*) AS n_pairs, round(corr(p, q), 6) AS rho FROM rk""")
def geometry_rho(spark: SparkSession, sf: str) -> DataFrame:
    v = T.vectors(spark, sf)
    moved, _ = rep.stage_centering(v, "stage", "batch", "va", T.DIMS)
    return _round(rep.geometry_rho(v, moved, ["label"], "va", T.DIMS), "rho")


@query("root_medoid", f"""WITH {T.VECTORS}, pool AS (SELECT id, dimension, xa FROM dims WHERE label = '3'), c AS (SELECT dimension, avg(xa) AS mean, median(xa) AS med FROM pool GROUP BY 1),
d AS (SELECT id, sqrt(sum((xa - mean) * (xa - mean))) AS dm, sqrt(sum((xa - med) * (xa - med))) AS dd FROM pool JOIN c USING (dimension) GROUP BY id)
SELECT 'mean' AS center, arg_min(id, {{'a': dm, 'b': id}}) AS root_id, round(min(dm), 6) AS root_distance, count(*) AS n_pool FROM d UNION ALL SELECT 'median', arg_min(id, {{'a': dd, 'b': id}}), round(min(dd), 6), count(*) FROM d""")
def root_medoid(spark: SparkSession, sf: str) -> DataFrame:
    v = T.vectors(spark, sf)
    parts = [rep.root_medoid(v, "id", "va", T.DIMS, F.col("label") == "3", c).select(F.lit(c).alias("center"), "*") for c in ("mean", "median")]
    return _round(parts[0].unionByName(parts[1]), "root_distance")


@query("partial_r2_single", f"""WITH {T.VECTORS}, w AS (SELECT label, dimension, avg(xa) AS m FROM dims GROUP BY ALL), a AS (SELECT dimension, avg(xa) AS m FROM dims GROUP BY 1)
SELECT count(DISTINCT id) AS n, round(sum((xa - w.m) ** 2), 6) AS sse, round(sum((xa - a.m) ** 2), 6) AS sst, round(1 - sum((xa - w.m) ** 2) / sum((xa - a.m) ** 2), 6) AS r2 FROM dims JOIN w USING (label, dimension) JOIN a USING (dimension)""")
def partial_r2_single(spark: SparkSession, sf: str) -> DataFrame:
    v = rep.dims_as_columns(T.vectors(spark, sf), "va", 1, T.DIMS)
    return _round(stats.one_label_r2(v, "label", [f"d{i}" for i in range(1, T.DIMS + 1)]), "sse", "sst", "r2")


@query("partial_r2_two_way")
def partial_r2_two_way(spark: SparkSession, sf: str) -> DataFrame:
    v = rep.dims_as_columns(T.vectors(spark, sf), "va", 1, T.DIMS)
    r = stats.partial_r2(v, [f"d{i}" for i in range(1, T.DIMS + 1)], ["label"], ["batch", "stage"])
    return spark.createDataFrame(pd.DataFrame([r])).withColumns({k: r6(F.col(k)) for k in r if k != "n"})


@query("component_r2")
def component_r2(spark: SparkSession, sf: str) -> DataFrame:
    """Per dimension: variance share of label and batch; one pass over the vectors for all dims."""
    v = T.vectors(spark, sf).select("label", "batch", F.posexplode(doubles(F.col("va"))).alias("p", "x"))
    cells = v.groupBy("p", "label", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    tot = cells.groupBy("p").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s").alias("s"))
    fit = lambda k, o: cells.groupBy("p", k).agg((F.sum("s") * F.sum("s") / F.sum("n")).alias("f")).groupBy("p").agg(F.sum("f").alias(o))
    j = tot.join(fit("label", "fl"), "p").join(fit("batch", "fb"), "p")
    mean_sq = F.col("s") * F.col("s") / F.col("n")
    share = lambda c: r6(F.greatest((F.col(c) - mean_sq) / (F.col("q") - mean_sq), F.lit(0.0)))
    out = j.select((F.col("p") + 1).alias("dimension"), share("fl").alias("biology_r2"), share("fb").alias("technical_r2"))
    return out.withColumn("batch_dominant", (F.col("technical_r2") > 0.05) & (F.col("technical_r2") > F.col("biology_r2")))


from .catalog import ORACLE  # noqa: E402

ORACLE["component_r2"] = f"""WITH {T.VECTORS}, t AS (SELECT dimension, avg(xa) AS m FROM dims GROUP BY 1), l AS (SELECT dimension, label, avg(xa) AS m FROM dims GROUP BY ALL), b AS (SELECT dimension, batch, avg(xa) AS m FROM dims GROUP BY ALL),
r AS (SELECT dimension, round(1 - sum((xa - l.m) ** 2) / sum((xa - t.m) ** 2), 6) AS biology_r2, round(1 - sum((xa - b.m) ** 2) / sum((xa - t.m) ** 2), 6) AS technical_r2 FROM dims JOIN t USING (dimension) JOIN l USING (dimension, label) JOIN b USING (dimension, batch) GROUP BY dimension)
SELECT *, technical_r2 > 0.05 AND technical_r2 > biology_r2 AS batch_dominant FROM r"""


# --------------------------------------------------------------- decomposition
AXES = 50


@query("pca_scores")
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components of the scaled, clipped top features of the order counts."""
    v = materialize(ct.log_normalized(T.order_counts(spark, sf)))
    ent = materialize(v.select("entity").distinct())
    m = materialize(ct.top_features(ct.feature_moments(v, ent.count(), sample=True), ct.TOP_FEATURES_A))
    s, _, axes = decompose.factor(ct.scaled(v, m), m.select("feature"), ent, AXES, center=True, value="delta")
    return s.select("entity", *[r6(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(len(axes))])


@query("lsi_scores")
def lsi_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Latent axes of the TF-IDF weights of the best supported features."""
    c = materialize(T.order_counts(spark, sf))
    top = materialize(ct.top_features(c.groupBy("feature").agg(F.count(F.lit(1)).alias("n_detected")), ct.TOP_FEATURES_B, "n_detected"))
    kept = c.join(top.select("feature"), "feature", "left_semi")
    ent = materialize(kept.select("entity").distinct())
    s, _, axes = decompose.factor(ct.tfidf(kept, ent.count()), top.select("feature"), ent, AXES, center=False)
    return s.select("entity", *[r6(F.col("scores")[i]).alias(f"axis{i + 1}") for i in range(len(axes))])
