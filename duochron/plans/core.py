"""Queries on entities, labels, keys and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, clock, representation as rep, stats, windows as win
from ..operators.ordered import adjacent, contiguous_strata, fixed_strata, neighbors, not_increasing
from ..sources import readers
from . import tables as T
from .catalog import query

r6 = S.r6


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


# ------------------------------------------------------------------ aggregates
@query("state_quantiles", f"""
WITH {T.ENTITIES}
SELECT label, round(quantile_cont(clock, 0.05), 6) AS q05, round(quantile_cont(clock, 0.25), 6) AS q25, round(quantile_cont(clock, 0.5), 6) AS q50,
       round(quantile_cont(clock, 0.75), 6) AS q75, round(quantile_cont(clock, 0.95), 6) AS q95
FROM entities GROUP BY label""")
def state_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.quantiles(T.entities(spark, sf), ["label"], "clock", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    return _round(q, "q05", "q25", "q50", "q75", "q95")


@query("group_summary", f"""
WITH {T.ENTITIES}
SELECT label, count(a) AS n, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS sd, round(median(a), 6) AS median,
       round(quantile_cont(a, 0.25), 6) AS q25, round(quantile_cont(a, 0.75), 6) AS q75
FROM entities GROUP BY label""")
def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.group_summary(T.entities(spark, sf), ["label"], "a"), "mean", "sd", "median", "q25", "q75")


@query("crosstab_margins", f"""
WITH {T.ENTITIES}
SELECT CASE WHEN grouping(label) = 1 THEN 'All' ELSE label END AS label,
       CASE WHEN grouping(batch) = 1 THEN 'All' ELSE CAST(batch AS VARCHAR) END AS batch, count(*) AS n
FROM entities GROUP BY CUBE (label, batch)""")
def crosstab_margins(spark: SparkSession, sf: str) -> DataFrame:
    return audit.crosstab_margins(T.entities(spark, sf), "label", "batch")


@query("value_proportions", f"""
WITH {T.ENTITIES}
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM entities GROUP BY label""")
def value_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return _round(audit.value_counts(T.entities(spark, sf), "label"), "fraction")


_SUMMARY = "SELECT '{c}' AS metric, count({c}) AS n, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"


@query("numeric_summary", " UNION ALL ".join(_SUMMARY.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "lineitem")
    return _round(stats.numeric_summary(t, ["l_quantity", "l_extendedprice", "l_discount"]), "q25", "median", "q75")


@query("stage_state_medians", f"""
WITH {T.ENTITIES}
SELECT label, round(median(a) FILTER (batch = 0), 6) AS batch_0, round(median(a) FILTER (batch = 1), 6) AS batch_1, round(median(a) FILTER (batch = 2), 6) AS batch_2
FROM entities GROUP BY label""")
def stage_state_medians(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.quantiles(T.entities(spark, sf), ["label", "batch"], "a", {"m": 0.5})
    wide = m.groupBy("label").agg(*[F.max(F.when(F.col("batch") == b, F.col("m"))).alias(f"batch_{b}") for b in (0, 1, 2)])
    return _round(wide, "batch_0", "batch_1", "batch_2")


@query("weighted_mean_rate_smd", f"""
WITH {T.ENTITIES}
SELECT batch, round(sum(a * b) FILTER (b > 0) / sum(b) FILTER (b > 0), 6) AS weighted_a, round(avg(CASE WHEN a > 50 THEN 1 ELSE 0 END), 6) AS rate_over_50,
       round((avg(a) FILTER (label = 'error') - avg(a) FILTER (label <> 'error'))
             / sqrt((var_samp(a) FILTER (label = 'error') + var_samp(a) FILTER (label <> 'error')) / 2), 6) AS smd_error
FROM entities GROUP BY batch""")
def weighted_mean_rate_smd(spark: SparkSession, sf: str) -> DataFrame:
    e = T.entities(spark, sf)
    return e.groupBy("batch").agg(
        r6(stats.weighted_mean(F.col("a"), F.col("b"))).alias("weighted_a"), r6(stats.rate(F.col("a") > 50)).alias("rate_over_50"),
        r6(stats.smd(F.col("label") == "error", F.col("a"))).alias("smd_error"),
    )


@query("finite_audit", f"""
WITH {T.ENTITIES}
SELECT 'a' AS metric, count(*) AS n, count(*) FILTER (a IS NULL) AS n_not_finite, count(*) FILTER (a < 0) AS n_negative, min(a) AS minimum, max(a) AS maximum FROM entities
UNION ALL SELECT 'b', count(*), count(*) FILTER (b IS NULL), count(*) FILTER (b < 0), min(b), max(b) FROM entities""")
def finite_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.finite_audit(audit.require_columns(T.entities(spark, sf), ["a", "b"], "entities"), ["a", "b"])


@query("zscore_columns", f"""
WITH {T.ENTITIES}
SELECT id, round((a - avg(a) OVER ()) / CASE WHEN stddev_pop(a) OVER () > 0 THEN stddev_pop(a) OVER () ELSE 1 END, 6) AS a,
       round((b - avg(b) OVER ()) / CASE WHEN stddev_pop(b) OVER () > 0 THEN stddev_pop(b) OVER () ELSE 1 END, 6) AS b FROM entities""")
def zscore_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _round(rep.zscore(T.entities(spark, sf).select("id", "a", "b"), ["a", "b"]), "a", "b")


# -------------------------------------------------------------- rank statistics
_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0"


@query("spearman_pair", f"""
WITH {T.ENTITIES}, r AS (SELECT label, a, b, {_RANK.format(p='label', c='a')} AS ra, {_RANK.format(p='label', c='b')} AS rb FROM entities)
SELECT label, round(corr(ra, rb), 6) AS spearman, round(corr(a, b), 6) AS pearson FROM r GROUP BY label""")
def spearman_pair(spark: SparkSession, sf: str) -> DataFrame:
    e = T.entities(spark, sf)
    s = stats.spearman(e, "a", "b", ["label"], "spearman").join(stats.correlation(e, "a", "b", ["label"], "pearson"), "label")
    return _round(s, "spearman", "pearson")


_DOMINANCE = f"""
WITH {T.ENTITIES}, labs AS (SELECT * FROM (VALUES ('view', 0), ('click', 1), ('signup', 2), ('purchase', 3), ('error', 4)) t(label, i)),
c AS (SELECT e.label, i, a, count(*) AS n FROM entities e JOIN labs USING (label) GROUP BY ALL),
cum AS (SELECT x.label AS la, x.i AS ia, v.a, coalesce((SELECT sum(n) FROM c WHERE c.label = x.label AND c.a < v.a), 0) AS below FROM labs x, (SELECT DISTINCT a FROM c) v),
p AS (SELECT cum.la AS a, c.label AS b, c.i - cum.ia AS steps, sum(c.n * cum.below) AS wins FROM cum JOIN c ON c.a = cum.a AND c.i > cum.ia GROUP BY ALL),
tot AS (SELECT label, sum(n) AS n FROM c GROUP BY label)
"""


@query("dominance_prob", _DOMINANCE + "SELECT p.a, p.b, p.steps, round(p.wins / (x.n * y.n)::DOUBLE, 6) AS probability FROM p JOIN tot x ON x.label = p.a JOIN tot y ON y.label = p.b")
def dominance_prob(spark: SparkSession, sf: str) -> DataFrame:
    return _round(stats.dominance(T.entities(spark, sf), "label", "a", T.LABELS), "probability")


@query("pairwise_ordering", _DOMINANCE + """
SELECT p.a, p.b, CASE WHEN steps = 1 THEN 'adjacent' ELSE 'endpoint' END AS kind, round(wins / (x.n * y.n)::DOUBLE, 6) AS probability,
       CASE WHEN steps = 1 THEN 0.6 ELSE 0.8 END AS threshold, wins / (x.n * y.n)::DOUBLE >= CASE WHEN steps = 1 THEN 0.6 ELSE 0.8 END AS passes
FROM p JOIN tot x ON x.label = p.a JOIN tot y ON y.label = p.b""")
def pairwise_ordering(spark: SparkSession, sf: str) -> DataFrame:
    return _round(clock.ordering_table(stats.dominance(T.entities(spark, sf), "label", "a", T.LABELS)), "probability")


@query("median_order_audit", f"""
WITH {T.ENTITIES}, m AS (SELECT label, median(clock) AS m, list_position(['view','click','signup','purchase','error'], label) AS p FROM entities GROUP BY label),
s AS (SELECT m, lead(m) OVER (ORDER BY p) AS nx FROM m)
SELECT count(nx) AS n_steps, count(*) FILTER (nx > m) AS n_increasing FROM s""")
def median_order_audit(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.quantiles(T.entities(spark, sf), ["label"], "clock", {"median": 0.5})
    return clock.order_audit(m, "label", "median", T.LABELS)


@query("interval_overlap", f"""
WITH {T.ENTITIES}, q AS (SELECT label, quantile_cont(a, 0.25) AS lo, quantile_cont(a, 0.75) AS hi, list_position(['view','click','signup','purchase','error'], label) AS p FROM entities GROUP BY label)
SELECT x.label AS a, y.label AS b, round(greatest(0, least(x.hi, y.hi) - greatest(x.lo, y.lo)) / (greatest(x.hi, y.hi) - least(x.lo, y.lo)), 6) AS overlap
FROM q x JOIN q y ON y.p = x.p + 1""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    q = stats.quantiles(T.entities(spark, sf), ["label"], "a", {"lo": 0.25, "hi": 0.75})
    return _round(rep.pairwise_overlap(q, "label", "lo", "hi", T.LABELS), "overlap")


@query("batch_median_shift", f"""
WITH {T.ENTITIES}, m AS (SELECT label, CAST(id % 2 AS VARCHAR) AS batch, median(clock) AS m, count(*) AS n FROM entities GROUP BY ALL)
SELECT label, min(batch) AS group_1, max(batch) AS group_2, arg_min(n, batch) AS n_1, arg_max(n, batch) AS n_2, round(arg_min(m, batch), 6) AS median_1,
       round(arg_max(m, batch), 6) AS median_2, round(abs(arg_min(m, batch) - arg_max(m, batch)), 6) AS absolute_difference
FROM m GROUP BY label HAVING count(*) = 2""")
def batch_median_shift(spark: SparkSession, sf: str) -> DataFrame:
    e = T.entities(spark, sf).withColumn("batch", F.col("id") % 2)  # two batches that hold every row
    return _round(rep.batch_shift(e, "label", "batch", "clock"), "median_1", "median_2", "absolute_difference")


# ------------------------------------------------------------------- key audits
@query("set_metrics", """
WITH r AS (SELECT DISTINCT doc_id FROM documents), o AS (SELECT DISTINCT doc_id FROM labels),
x AS (SELECT count(r.doc_id) AS rn, count(o.doc_id) AS onn, count(*) FILTER (r.doc_id IS NOT NULL AND o.doc_id IS NOT NULL) AS i, count(*) AS u FROM r FULL JOIN o ON r.doc_id = o.doc_id)
SELECT rn AS reference_n, onn AS observed_n, i AS intersection, rn - i AS reference_not_observed, onn - i AS observed_not_reference,
       round(i / rn, 6) AS reference_recall, round(i / onn, 6) AS observed_precision, round(i / u, 6) AS jaccard, (rn = i AND onn = i) AS exact_match FROM x""")
def set_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = audit.set_metrics(T.table(spark, sf, "documents"), T.table(spark, sf, "labels"), "doc_id")
    return _round(m, "reference_recall", "observed_precision", "jaccard")


@query("pairing_audit", """
WITH a AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS c FROM customer GROUP BY 1),
j AS (SELECT coalesce(a.c, 0) AS ca, coalesce(b.c, 0) AS cb FROM a FULL JOIN b ON a.k = b.k)
SELECT count(*) FILTER (ca = 1 AND cb = 1) AS n_paired, count(*) FILTER (ca > 0 AND cb = 0) AS n_only_a, count(*) FILTER (cb > 0 AND ca = 0) AS n_only_b,
       count(*) FILTER (ca > 1 OR cb > 1) AS n_repeated, count(*) FILTER ((ca > 0 AND cb = 0) OR (cb > 0 AND ca = 0) OR ca > 1 OR cb > 1) = 0 AS one_to_one FROM j""")
def pairing_audit(spark: SparkSession, sf: str) -> DataFrame:
    a = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return audit.pairing_audit(a, T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("key_audit", """
WITH k AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1)
SELECT sum(c) AS n_rows, coalesce(sum(c) FILTER (user_id IS NULL), 0) AS n_missing, count(user_id) AS n_distinct,
       count(*) FILTER (user_id IS NOT NULL AND c > 1) AS n_repeated_keys, coalesce(sum(c - 1) FILTER (user_id IS NOT NULL), 0) AS n_extra_rows FROM k""")
def key_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.key_audit(T.table(spark, sf, "events"), "user_id")


@query("paired_join", f"""
WITH {T.VECTORS} SELECT id, label, round(va[1], 6) AS a1, n_chars AS b1 FROM vectors JOIN documents ON doc_id = id""")
def paired_join(spark: SparkSession, sf: str) -> DataFrame:
    """One modality from the vectors, the other from the documents of the same ids."""
    b = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("b1"))
    j = audit.paired_join(T.vectors(spark, sf).select("id", "label", "va"), b, "id")
    return j.select("id", "label", r6(F.col("va")[0]).alias("a1"), "b1")


@query("many_to_one_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def many_to_one_join(spark: SparkSession, sf: str) -> DataFrame:
    l = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    return audit.paired_join(l, o, "k", many_to_one=True).withColumnRenamed("k", "l_orderkey")


@query("common_features", """
WITH p AS (SELECT l_suppkey, l_returnflag, min(l_orderkey) AS p FROM lineitem GROUP BY ALL)
SELECT l_suppkey, min(p) FILTER (l_returnflag = 'A') AS first_position FROM p GROUP BY l_suppkey HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def common_features(spark: SparkSession, sf: str) -> DataFrame:
    return audit.common_features(T.table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_orderkey", "A")


@query("membership_flags", """
SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) AS is_labelled, d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_toxic FROM documents d""")
def membership_flags(spark: SparkSession, sf: str) -> DataFrame:
    d, l = T.table(spark, sf, "documents").select("doc_id"), T.table(spark, sf, "labels")
    one = lambda t, name: t.select("doc_id").distinct().withColumn(name, F.lit(True))
    j = d.join(one(l, "is_labelled"), "doc_id", "left").join(one(l.where("toxic = 1"), "is_toxic"), "doc_id", "left")
    return j.na.fill(False, ["is_labelled", "is_toxic"])


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id").distinct().join(T.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("set_intersection", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"))
    return T.table(spark, sf, "customer").select("c_custkey").intersect(e)


@query("target_scan", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def target_scan(spark: SparkSession, sf: str) -> DataFrame:
    seen = T.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return readers.targets_found(T.table(spark, sf, "part").select("p_partkey"), seen, "p_partkey")


@query("label_filter_reindex", f"""
WITH {T.ENTITIES} SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS row_index FROM entities WHERE label IN ('view', 'signup')""")
def label_filter_reindex(spark: SparkSession, sf: str) -> DataFrame:
    return rep.reindex(T.entities(spark, sf).select("id", "label"), "label", ["view", "signup"], "id")


# --------------------------------------------------------------- text and flags
@query("bool_normalise", """
WITH t AS (SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'f' WHEN 2 THEN 'Passed' WHEN 3 THEN 'no' WHEN 4 THEN 'y' WHEN 5 THEN '1' WHEN 6 THEN 'fail' WHEN 7 THEN role END AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(trim(w)) IN ('true','t','1','yes','pass','passed') THEN true WHEN lower(trim(w)) IN ('false','f','0','no','fail','failed') THEN false END AS tabled,
       coalesce(lower(trim(w)) IN ('true','1','yes','y'), false) AS strict FROM t""")
def bool_normalise(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") * 7 + F.col("turn")) % 9
    w = F.when(k == 0, " TRUE ").when(k == 1, "f").when(k == 2, "Passed").when(k == 3, "no").when(k == 4, "y").when(k == 5, "1").when(k == 6, "fail").when(k == 7, F.col("role"))
    return T.table(spark, sf, "conversations").select("conv_id", "turn", S.flag_from_text(w).alias("tabled"), S.strict_flag(w).alias("strict"))


@query("barcode_normalise", """
WITH b AS (SELECT event_id, format('R{}.0{},R2.0{},R3.{},P1.{}', user_id % 4, user_id % 9, event_id % 8, event_id % 90, user_id % 70) AS raw,
                  format('R{}.01.R2.0{}.R3.{}.P1.{}', user_id % 4, event_id % 8, event_id % 90, user_id % 70) || CASE WHEN event_id % 11 = 0 THEN '.x' ELSE '' END AS dotted FROM events)
SELECT event_id, replace(trim(raw), ',', '.') AS barcode,
       CASE WHEN len(string_split(dotted, '.')) = 8 THEN string_split(dotted, '.')[1] || '.' || string_split(dotted, '.')[2] || ',' || string_split(dotted, '.')[3] || '.' || string_split(dotted, '.')[4]
            || ',' || string_split(dotted, '.')[5] || '.' || string_split(dotted, '.')[6] || ',' || string_split(dotted, '.')[7] || '.' || string_split(dotted, '.')[8] END AS regrouped,
       format('{}::{}', event_id % 3, replace(trim(raw), ',', '.')) AS composite FROM b""")
def barcode_normalise(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    raw = F.format_string("R%d.0%d,R2.0%d,R3.%d,P1.%d", u % 4, u % 9, e % 8, e % 90, u % 70)
    dotted = F.concat(F.format_string("R%d.01.R2.0%d.R3.%d.P1.%d", u % 4, e % 8, e % 90, u % 70), F.when(e % 11 == 0, ".x").otherwise(""))
    bc = S.normalize_barcode(raw)
    return T.table(spark, sf, "events").select("event_id", bc.alias("barcode"), S.regroup_barcode(dotted).alias("regrouped"), S.composite_key(e % 3, bc).alias("composite"))


@query("term_mask", """
SELECT doc_id, (lower(text) LIKE '%tion%' OR lower(text) LIKE '%haha%') AS has_term FROM documents""")
def term_mask(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", S.term_mask(F.col("text"), ["TION", "haha"]).alias("has_term"))


@query("symbol_normalise", "SELECT p_partkey, upper(trim(p_name)) AS symbol, p_name LIKE '%::%' AS is_complex FROM part")
def symbol_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "part").select("p_partkey", S.normalize_symbol(F.col("p_name")).alias("symbol"), F.contains("p_name", F.lit("::")).alias("is_complex"))


@query("qc_strata", """
WITH f AS (SELECT o_orderkey, o_orderstatus = 'F' AS qa, o_totalprice > 100000 AS qb, CASE WHEN o_custkey % 5 > 0 THEN o_orderpriority END AS mapped, CASE WHEN o_custkey % 7 > 0 THEN 'WT' END AS genotype FROM orders)
SELECT s AS stratum, n FROM (SELECT count(*) AS all_rows, count(genotype) AS genotype_known, count(mapped) AS label_mapped, count(*) FILTER (qa) AS pass_a, count(*) FILTER (qb) AS pass_b,
  count(*) FILTER (qa AND qb) AS pass_both, count(*) FILTER (mapped IS NOT NULL AND qa) AS mapped_and_pass_a, count(*) FILTER (mapped IS NOT NULL AND qa AND qb) AS mapped_and_pass_both FROM f)
UNPIVOT (n FOR s IN (all_rows, genotype_known, label_mapped, pass_a, pass_b, pass_both, mapped_and_pass_a, mapped_and_pass_both))""")
def qc_strata(spark: SparkSession, sf: str) -> DataFrame:
    qa, qb = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    mapped, known = F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 7 > 0
    masks = {
        "all_rows": F.lit(True), "genotype_known": known, "label_mapped": mapped, "pass_a": qa, "pass_b": qb, "pass_both": qa & qb,
        "mapped_and_pass_a": mapped & qa, "mapped_and_pass_both": mapped & qa & qb,
    }
    counts = T.table(spark, sf, "orders").agg(*[F.count_if(m).alias(k) for k, m in masks.items()])
    return counts.unpivot([], list(masks), "stratum", "n")


@query("number_format", "SELECT o_orderkey, printf('%.6f', o_totalprice / 7) AS shown FROM orders")
def number_format(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "orders").select("o_orderkey", S.fixed6(F.col("o_totalprice") / 7).alias("shown"))


# ---------------------------------------------------------------------- windows
@query("stable_rank", f"WITH {T.RANKED} SELECT id, round(clock, 6) AS clock, rk FROM ranked")
def stable_rank(spark: SparkSession, sf: str) -> DataFrame:
    return T.ranked(spark, sf)[0].select("id", r6(F.col("clock")).alias("clock"), "rk")


@query("sliding_window_profile", f"""
WITH {T.RANKED}, {T.DESIGNS_SQL}
SELECT window_config, window_size, step_size, window_index, start_rank, stop_rank, round(median(clock), 6) AS parameter, round(min(clock), 6) AS position_min, round(max(clock), 6) AS position_max,
       round(avg(clock), 6) AS mean_position, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b
FROM held GROUP BY window_config, window_size, step_size, window_index, start_rank, stop_rank""")
def sliding_window_profile(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    t = win.window_table(r, win.DESIGNS, n, {"s": F.col("clock"), "sa": F.col("a"), "sb": F.col("b")}, "clock")
    mean = lambda c: r6(F.col(c) / F.col("window_size"))
    out = t.select("*", mean("s").alias("mean_position"), mean("sa").alias("mean_a"), mean("sb").alias("mean_b")).drop("s", "sa", "sb")
    return _round(out, "parameter", "position_min", "position_max")


@query("window_composition", f"""
WITH {T.RANKED}, {T.DESIGNS_SQL}, c AS (
SELECT window_config, window_index, {', '.join(f"count(*) FILTER (label = '{l}') AS n_{l}" for l in T.LABELS)}, any_value(window_size) AS size FROM held GROUP BY ALL)
SELECT window_config, window_index, {', '.join(f'n_{l}' for l in T.LABELS)}, {', '.join(f'round(n_{l} / size, 6) AS fraction_{l}' for l in T.LABELS)},
  CASE greatest({', '.join(f'n_{l}' for l in T.LABELS)}) {' '.join(f"WHEN n_{l} THEN '{l}'" for l in T.LABELS)} END AS dominant_label FROM c""")
def window_composition(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    w = win.common_windows(r, "clock", "label", T.LABELS, win.DESIGNS, n)
    keep = ["window_config", "window_index", *[f"n_{l}" for l in T.LABELS], *[f"fraction_{l}" for l in T.LABELS], "dominant_label"]
    return _round(w.select(*keep), *[f"fraction_{l}" for l in T.LABELS])


@query("window_membership", f"""
WITH {T.RANKED} SELECT rk // 100 - j AS window_index, id, rk FROM ranked, LATERAL (SELECT unnest(range(0, 4)) AS j)
WHERE rk // 100 - j >= 0 AND rk // 100 - j <= ((SELECT count(*) FROM ranked) - 400) // 100""")
def window_membership(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    return win.membership(r.select("id", "rk"), win.PRIMARY, n).select("window_index", "id", "rk")


@query("strictly_increasing", f"""
WITH {T.RANKED}, {T.DESIGNS_SQL}, m AS (SELECT window_config, window_index, median(clock) AS x FROM held GROUP BY ALL),
d AS (SELECT window_config, x - lag(x) OVER (PARTITION BY window_config ORDER BY window_index) AS d FROM m)
SELECT window_config, count(d) AS n_steps, count(*) FILTER (d <= 0) AS n_not_increasing FROM d GROUP BY window_config""")
def strictly_increasing(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    return not_increasing(win.window_positions(r, "clock", win.DESIGNS, n), ["window_config"], "window_index", "parameter")


@query("adjacent_difference", f"""
WITH {T.RANKED} SELECT id, round(clock - lag(clock) OVER (ORDER BY rk), 6) AS d_clock FROM ranked""")
def adjacent_difference(spark: SparkSession, sf: str) -> DataFrame:
    r, _ = T.ranked(spark, sf)
    return adjacent(r.select("id", "rk", "clock"), [], "rk", "clock").select("id", r6(F.col("d_clock")).alias("d_clock"))


@query("contiguous_strata", f"""
WITH {T.RANKED}, n AS (SELECT count(*) AS n FROM ranked)
SELECT id, rk // 100 AS chunk, CASE WHEN rk < (n % 20) * (n // 20 + 1) THEN rk // (n // 20 + 1) ELSE n % 20 + (rk - (n % 20) * (n // 20 + 1)) // (n // 20) END AS stratum FROM ranked, n""")
def strata(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    return r.select("id", fixed_strata(F.col("rk"), 100).alias("chunk"), contiguous_strata(F.col("rk"), n, 20).alias("stratum"))


_LANDMARKS = f"""
{T.ENTITIES}, m AS (SELECT label, median(clock) AS m, list_position(['view','click','signup','purchase','error'], label) AS p FROM entities GROUP BY label),
l AS (SELECT label, p, m, lead(label) OVER (ORDER BY p) AS nl, lead(m) OVER (ORDER BY p) AS nm, lag(m) OVER (ORDER BY p) AS pm FROM m)"""


@query("landmark_midpoints", f"""
WITH {_LANDMARKS}
SELECT label || ' -> ' || nl AS transition, round(pm, 6) AS upstream_limit, round(m, 6) AS lower, round(nm, 6) AS upper, round((m + nm) / 2, 6) AS landmark, nm > m AS increases FROM l WHERE nl IS NOT NULL""")
def landmark_midpoints(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.quantiles(T.entities(spark, sf), ["label"], "clock", {"m": 0.5})
    return _round(win.landmark_midpoints(m, "label", "m", T.LABELS), "upstream_limit", "lower", "upper", "landmark")


@query("nearest_landmark", f"""
WITH {T.ENTITIES}, l AS (SELECT * FROM (VALUES ('early', 5.0), ('middle', 15.0), ('late', 22.5)) t(name, v)),
n AS (SELECT id, name, v, abs(clock - v) AS d, row_number() OVER (PARTITION BY id ORDER BY abs(clock - v), v) AS r FROM entities, l)
SELECT id, name AS landmark, v AS landmark_position, round(d, 6) AS landmark_distance FROM n WHERE r = 1""")
def nearest_landmark(spark: SparkSession, sf: str) -> DataFrame:
    n = win.nearest_landmark(T.entities(spark, sf).select("id", "clock"), "clock", [("early", 5.0), ("middle", 15.0), ("late", 22.5)])
    return _round(n.drop("clock"), "landmark_distance")


@query("locate_window", f"""
WITH {T.RANKED}, {T.DESIGNS_SQL}, m AS (SELECT window_index, median(clock) AS x FROM held WHERE window_config = '400/100' GROUP BY ALL)
SELECT window_index, round(x, 6) AS parameter FROM m WHERE window_index = (SELECT max(window_index) // 2 FROM m)""")
def locate_window(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    pos = win.window_positions(r, "clock", [win.PRIMARY], n).select("window_index", "parameter")
    middle = pos.where(F.col("window_index") == (win.PRIMARY.count(n) - 1) // 2).first()["parameter"]
    return _round(win.locate_window(pos, "parameter", middle), "parameter")


@query("window_nonoverlap_audit", f"""
WITH {T.RANKED}, g AS (SELECT id, rk BETWEEN 0 AND 399 AS pre, rk BETWEEN 300 AND 699 AS event_b, rk BETWEEN 700 AND 1099 AS event_a FROM ranked)
SELECT 'pre' AS group_a, 'event_b' AS group_b, count(*) FILTER (pre AND event_b) AS n_shared FROM g
UNION ALL SELECT 'pre', 'event_a', count(*) FILTER (pre AND event_a) FROM g UNION ALL SELECT 'event_b', 'event_a', count(*) FILTER (event_b AND event_a) FROM g""")
def window_nonoverlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    r, n = T.ranked(spark, sf)
    m = win.membership(r.select("id", "rk"), win.PRIMARY, n)
    groups = F.when(F.col("window_index") == 0, "pre").when(F.col("window_index") == 3, "event_b").when(F.col("window_index") == 7, "event_a")
    return audit.shared_members(m.withColumn("g", groups).where(F.col("g").isNotNull()), "g", "id", ["pre", "event_b", "event_a"])


@query("stage_gates", f"""
WITH {T.RANKED}, f AS (SELECT count(*) AS n, count(DISTINCT id) AS d, count(DISTINCT label) AS k, count(*) FILTER (clock IS NULL) AS miss, min(a) AS lo FROM ranked)
SELECT * FROM (SELECT 1 AS step, 'at least 1000 entities' AS criterion, n >= 1000 AS passed, CASE WHEN n >= 1000 THEN 'PASS' ELSE 'REVIEW' END AS status FROM f
UNION ALL SELECT 2, 'entity ids unique', n = d, CASE WHEN n = d THEN 'PASS' ELSE 'REVIEW' END FROM f
UNION ALL SELECT 3, 'all five labels present', k = 5, CASE WHEN k = 5 THEN 'PASS' ELSE 'REVIEW' END FROM f
UNION ALL SELECT 4, 'clock known for every entity', miss = 0, CASE WHEN miss = 0 THEN 'PASS' ELSE 'REVIEW' END FROM f
UNION ALL SELECT 5, 'modality A above one', lo > 1, CASE WHEN lo > 1 THEN 'PASS' ELSE 'REVIEW' END FROM f)""")
def stage_gates(spark: SparkSession, sf: str) -> DataFrame:
    facts = T.entities(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.count_distinct("label").alias("k"), F.count_if(F.col("clock").isNull()).alias("miss"), F.min("a").alias("lo")
    )
    return audit.checks(facts, [
        ("at least 1000 entities", F.col("n") >= 1000), ("entity ids unique", F.col("n") == F.col("d")), ("all five labels present", F.col("k") == 5),
        ("clock known for every entity", F.col("miss") == 0), ("modality A above one", F.col("lo") > 1),
    ])


@query("gate_verdict", f"""
WITH {T.ENTITIES}, f AS (SELECT count(*) >= 1000 AS a, count(*) = count(DISTINCT id) AS b, min(a) > 1 AS c FROM entities)
SELECT 3 AS n_checks, a::INT + b::INT + c::INT AS n_passed, CASE WHEN a AND b AND c THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM f""")
def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    facts = T.entities(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.min("a").alias("lo"))
    return audit.verdict(audit.checks(facts, [("size", F.col("n") >= 1000), ("unique", F.col("n") == F.col("d")), ("floor", F.col("lo") > 1)]))
