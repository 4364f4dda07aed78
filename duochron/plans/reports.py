"""Queries on text parsing, design matrices and closing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import audit, report, stats
from ..session import materialize
from ..sources import readers
from . import graphs, inference, places
from . import tables as T
from .catalog import ORACLE, query
from .curves import family_selection, frozen_pair_windows


# ---------------------------------------------------------------- text formats
def _fragment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Interval rows as tab-separated text; every 13th lacks a field, every 17th has a bad number."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    end = F.when(k % 17 == 0, F.lit("?")).otherwise(F.col("end").cast("string"))
    tail = F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("\t"), F.col("l_quantity").cast("int").cast("string")))
    text = F.concat(F.when(k % 19 == 0, F.lit("# note=")).otherwise(F.lit("")), F.concat_ws("\t", "chrom", F.col("start").cast("string"), end, F.concat(F.lit("b"), F.col("l_partkey").cast("string"))), tail)
    return T.intervals(spark, sf).select("l_orderkey", text.alias("value"))


_LINES = f"""{T.INTERVALS}, ln AS (SELECT *, (l_orderkey + l_linenumber) % 17 = 0 AS badn, (l_orderkey + l_linenumber) % 13 = 0 AS few, (l_orderkey + l_linenumber) % 19 = 0 AS note FROM intervals)"""


@query("fragment_records", f"""WITH {_LINES} SELECT l_orderkey, CASE WHEN NOT (badn OR few) THEN chrom END AS chrom, CASE WHEN NOT (badn OR few) THEN start END AS start, CASE WHEN NOT (badn OR few) THEN "end" END AS "end",
CASE WHEN NOT (badn OR few) THEN 'b' || l_partkey END AS barcode, CASE WHEN NOT (badn OR few) THEN CAST(l_quantity AS INT) END AS n, badn OR few AS malformed FROM ln WHERE NOT note""")
def fragment_records(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parse_fragments(_fragment_lines(spark, sf))


@query("header_fields", f"""WITH {_LINES} SELECT l_orderkey, 'note' AS key, chrom || chr(9) || start || chr(9) || CASE WHEN badn THEN '?' ELSE CAST("end" AS VARCHAR) END || chr(9) || 'b' || l_partkey || CASE WHEN few THEN '' ELSE chr(9) || CAST(l_quantity AS INT) END AS val FROM ln WHERE note""")
def header_fields(spark: SparkSession, sf: str) -> DataFrame:
    return readers.parse_header_fields(_fragment_lines(spark, sf))


@query("matrix_entries", 'SELECT l_orderkey - 1 AS "row", l_partkey - 1 AS col, l_quantity AS value FROM lineitem')
def matrix_entries(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "lineitem")
    return readers.parse_entries(t.select(F.concat_ws("  ", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("value")))


@query("dense_unfold", """WITH c AS (SELECT l_suppkey AS f, l_linenumber AS k, sum(CASE WHEN l_quantity > 40 THEN l_quantity ELSE 0 END) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(f AS VARCHAR) AS feature, 'e' || k AS entity, c AS count FROM c WHERE c <> 0 AND k <> 4""")
def dense_unfold(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "lineitem")
    heavy = F.when(F.col("l_quantity") > 40, F.col("l_quantity")).otherwise(0.0)
    wide = t.groupBy("l_suppkey").agg(*[F.coalesce(F.sum(F.when(F.col("l_linenumber") == k, heavy)), F.lit(0.0)).alias(f"e{k}") for k in range(1, 8)])
    lines = wide.select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), *[F.col(f"e{k}").cast("string") for k in range(1, 8)]).alias("value"))
    names = spark.createDataFrame([(k - 1, f"e{k}") for k in (1, 2, 3, 5, 6, 7)], "position int, entity string")
    return readers.unfold_dense(lines, names, 7)


@query("member_classes", """WITH n AS (SELECT event_id, format('GSM{}_s{}_{}', event_id, user_id % 11, CASE event_id % 4 WHEN 0 THEN 'GEX_barcodes.tsv.gz' WHEN 1 THEN 'GEX_matrix.mtx.gz' WHEN 2 THEN 'ATAC_fragments.tsv.gz' ELSE 'notes.txt' END) AS name, user_id % 11 AS u FROM events)
SELECT event_id, name, CASE event_id % 4 WHEN 0 THEN 'barcodes' WHEN 1 THEN 'matrix' WHEN 2 THEN 'fragments' END AS member_class, CASE WHEN event_id % 4 < 3 THEN 's' || u END AS sample FROM n""")
def member_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("GEX_barcodes.tsv.gz", "GEX_matrix.mtx.gz", "ATAC_fragments.tsv.gz", "notes.txt")]), (F.col("event_id") % 4 + 1).cast("int"))
    names = T.table(spark, sf, "events").select("event_id", F.concat(F.format_string("GSM%d_s%d_", "event_id", F.col("user_id") % 11), kind).alias("name"))
    patterns = {k: rf"^GSM[0-9]+_(.+?)_{v}$" for k, v in (("barcodes", r"GEX_barcodes\.tsv\.gz"), ("matrix", r"GEX_matrix\.mtx\.gz"), ("fragments", r"ATAC_fragments\.tsv\.gz"))}
    return readers.classify_members(names, "name", patterns)


@query("pfm_parse", """WITH m AS (SELECT p_partkey, p_name, p_size FROM part)
SELECT 'M' || p_partkey AS motif_id, p_name AS tf_name, 2 AS motif_length, p_size::DOUBLE AS a1, 1.0::DOUBLE AS a2, 1.0::DOUBLE AS c1, (p_partkey % 9)::DOUBLE AS c2, 2.0::DOUBLE AS g1, 0.5::DOUBLE AS g2, (p_partkey % 7)::DOUBLE AS t1, 4.0::DOUBLE AS t2 FROM m""")
def pfm_parse(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda c: c.cast("string")
    text = F.concat(
        F.lit("M"), own(F.col("p_partkey")), F.lit("\t"), F.col("p_name"), F.lit("\nA  [ "), own(F.col("p_size")), F.lit(" 1 ]\nC  [1   "), own(F.col("p_partkey") % 9),
        F.lit("]\r\nG  [ 2 .5 ]\nT  [ "), own(F.col("p_partkey") % 7), F.lit(" 4 ]\n"),
    )
    m = readers.parse_pfms(T.table(spark, sf, "part").select(text.alias("value")))
    return m.select("motif_id", "tf_name", "motif_length", *[F.col("pfm")[i][j].alias(f"{b}{j + 1}") for i, b in enumerate("acgt") for j in range(2)])


@query("provenance_check", """WITH f AS (SELECT doc_id, n_chars, sha256(text) AS h FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS name, doc_id % 10 <> 9 AS present, doc_id % 10 <> 9 AND doc_id % 7 <> 3 AS verified FROM f""")
def provenance_check(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as files: every tenth is missing, every seventh differs from its manifest entry."""
    d = T.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), F.length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    manifest = d.withColumn("sha256", F.when(F.col("doc_id") % 7 == 3, F.lit("0")).otherwise(F.col("sha256")))
    return readers.verify_provenance(d.where("doc_id % 10 <> 9").drop("doc_id"), manifest)


# the names under which the study's roles occur, best first
ROLES = {
    "entity": ["cell", "barcode", "event id", "doc id", "vec id"], "clock": ["clock", "time", "ts"], "label": ["cell type", "event-type", "lang", "label"],
    "batch": ["batch", "sample", "user id", "source"],
}
_ROLE_COLUMNS = {"events": dict(entity="event_id", clock="ts", label="event_type", batch="user_id"), "documents": dict(entity="doc_id", label="lang", batch="source"), "embeddings": dict(entity="vec_id", label="label")}


@query("role_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{r}' AS role, '{c}' AS \"column\", count({c}) AS n_filled, count(DISTINCT {c}) AS n_distinct, {str(t == 'events').lower()} AS most_roles FROM {t}" for t, cs in _ROLE_COLUMNS.items() for r, c in cs.items()))
def role_columns(spark: SparkSession, sf: str) -> DataFrame:
    tables = {t: T.table(spark, sf, t) for t in ("documents", "embeddings", "events")}
    best, _ = audit.table_by_roles({t: d.columns for t, d in tables.items()}, ROLES)
    out = [audit.role_audit(d, audit.columns_by_role(d.columns, ROLES)).select(F.lit(t).alias("table"), "*", F.lit(t == best).alias("most_roles")) for t, d in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --------------------------------------------------------------- design matrices
@query("dummy_coding", f"WITH {T.ENTITIES} SELECT id, (label = 'error')::INT AS error, (label = 'purchase')::INT AS purchase, (label = 'signup')::INT AS signup, (label = 'view')::INT AS view, (batch = 1)::INT AS batch_1, (batch = 2)::INT AS batch_2 FROM entities")
def dummy_coding(spark: SparkSession, sf: str) -> DataFrame:
    e = T.entities(spark, sf)
    return e.select("id", *stats.dummies("label", sorted(T.LABELS)), *[c.alias(f"batch_{i}") for i, c in zip((1, 2), stats.dummies("batch", [0, 1, 2]))])


# ---------------------------------------------------------------- closing tables
def _facts(spark: SparkSession, sf: str) -> DataFrame:
    v = T.vectors(spark, sf)
    pair = audit.pairing_audit(v.select("id"), T.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id").select("one_to_one")
    r = stats.one_label_r2(v.select("batch", *[F.col("va")[i].alias(f"d{i}") for i in range(T.DIMS)]), "batch", [f"d{i}" for i in range(T.DIMS)]).select(F.col("r2").alias("technical_r2"))
    # the clock of either modality: its first axis
    rho = stats.spearman(v.select(F.col("va")[0].alias("a"), F.col("vb")[0].alias("b")), "a", "b", (), "k_rho")
    near = graphs.continuity_decision(spark, sf).select("continuous")
    return pair.crossJoin(r).crossJoin(rho).crossJoin(near).withColumn("ordered", F.col("k_rho") > 0)  # one row each


_FACTS = f"""{T.ENTITIES}, {T.VECTORS.lstrip()}, w AS (SELECT batch, dimension, avg(xa) AS m FROM dims GROUP BY ALL), a AS (SELECT dimension, avg(xa) AS m FROM dims GROUP BY 1),
cd AS ({ORACLE['continuity_decision']}), pr2 AS (SELECT (SELECT count(*) FROM vectors v FULL JOIN documents d ON v.id = d.doc_id WHERE v.id IS NULL OR d.doc_id IS NULL) = 0 AS o),
r2 AS (SELECT 1 - sum((xa - w.m) ** 2) / sum((xa - a.m) ** 2) AS r FROM dims JOIN w USING (batch, dimension) JOIN a USING (dimension)),
rk AS (SELECT rank() OVER (ORDER BY va[1]) + (count(*) OVER (PARTITION BY va[1]) - 1) / 2.0 AS x, rank() OVER (ORDER BY vb[1]) + (count(*) OVER (PARTITION BY vb[1]) - 1) / 2.0 AS y FROM vectors), kr AS (SELECT corr(x, y) AS k FROM rk),
f AS (SELECT r, k, o, continuous AS c FROM r2, kr, pr2, cd)"""


def _gate(step: int, name: str, test: str) -> str:
    return f"SELECT {step} AS step, '{name}' AS criterion, {test} AS passed, CASE WHEN {test} THEN 'PASS' ELSE 'REVIEW' END AS status FROM f"


@query("suitability_summary", f"WITH {_FACTS} " + " UNION ALL ".join(_gate(i, n, t) for i, (n, t) in enumerate([
    ("paired correspondence", "o"), ("representation quality", "r < 0.05"), ("clock robustness", "k >= 0.95"), ("expected order", "k > 0"), ("local continuity", "c"), ("eligible for timing", "o AND r < 0.05 AND k >= 0.95 AND k > 0 AND c")], 1)))
def suitability_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.suitability(_facts(spark, sf))


def _stage_sql(stage: str, source: str, fields: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{f}' AS field, CAST({e} AS VARCHAR) AS value FROM {source}" for f, e in fields.items())


_STAGES = f"""WITH RECURSIVE e AS (SELECT count(DISTINCT event_id) AS n, count(DISTINCT event_type) AS k FROM events), p AS ({ORACLE['frozen_pair_windows']}), b AS ({ORACLE['bootstrap_lag_summary']}),
g AS ({ORACLE['bootstrap_gates']}), al AS ({ORACLE['alignment_evidence']}), m AS ({ORACLE['fisher_bh']}) """


@query("evidence_freeze", _STAGES + " UNION ALL ".join([
    _stage_sql("entities", "e", {"n_entities": "n", "n_labels": "k"}),
    _stage_sql("frozen_pair", "p", {"a_family_id": "max(a_family_id)", "b_family_id": "max(b_family_id)", "n_designs": "count(*)", "shortest_lag": "min(lag)", "longest_lag": "max(lag)"}),
    _stage_sql("bootstrap", "b", {f: f for f in ("n", "median", "ci_low", "ci_high", "p_positive", "detection_rate")}),
    _stage_sql("alignment", "al", {"n_significant": "n_significant", "evidence": "evidence"}),
    _stage_sql("motifs", "m", {"n_tested": "count(*)", "n_enriched": "count(*) FILTER (enriched)"}),
]))
def evidence_freeze(spark: SparkSession, sf: str) -> DataFrame:
    """The results that later work may cite, one row a value, each from the stage that made it. The order of the
    entities and the curves of all designs are made once for the stages that read them."""
    order = inference.ordered(spark, sf)
    curves = materialize(T.profiles(spark, sf, order=order))
    e = T.entities(spark, sf).agg(F.count_distinct("id").alias("n_entities"), F.count_distinct("label").alias("n_labels"))
    lag = F.col("lag")
    p = frozen_pair_windows(spark, sf, curves).agg(F.max("a_family_id").alias("a_family_id"), F.max("b_family_id").alias("b_family_id"), F.count(F.lit(1)).alias("n_designs"), F.min(lag).alias("shortest_lag"), F.max(lag).alias("longest_lag"))
    b = inference.bootstrap_lag_summary(spark, sf, order).select("n", "median", "ci_low", "ci_high", "p_positive", "detection_rate")
    m = places.fisher_bh(spark, sf).agg(F.count(F.lit(1)).alias("n_tested"), F.count_if(F.col("enriched")).alias("n_enriched"))
    return report.evidence_freeze({"entities": e, "frozen_pair": p, "bootstrap": b, "alignment": inference.alignment_evidence(spark, sf, curves), "motifs": m})


@query("claim_boundaries", _STAGES + """SELECT 'lag_observed' AS claim, coalesce((SELECT bool_and(b_first AND lag > 0) FROM p), false) AS supported UNION ALL SELECT 'lag_recovered', coalesce((SELECT bool_and(passed) FROM g), false)
UNION ALL SELECT 'alignment_beyond_chance', coalesce((SELECT bool_or(evidence IN ('STRONG', 'PARTIAL')) FROM al), false) UNION ALL SELECT 'causal_order', false UNION ALL SELECT 'regulator_identified', false""")
def claim_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    facts = report.claim_facts(frozen_pair_windows(spark, sf), inference.bootstrap_gates(spark, sf), inference.alignment_evidence(spark, sf))
    return report.claim_boundaries(spark, facts).select("claim", "supported")


@query("selection_checks", f"""WITH fs AS (SELECT * FROM ({ORACLE['family_selection']})), f AS (SELECT count(*) FILTER (selected) AS n, count(DISTINCT modality) FILTER (selected) AS m, bool_and(NOT selected OR (robust_interior AND inside_region)) AS e FROM fs)
SELECT 1 AS step, 'one family per modality' AS criterion, n = 2 AND m = 2 AS passed, CASE WHEN n = 2 AND m = 2 THEN 'PASS' ELSE 'REVIEW' END AS status FROM f
UNION ALL SELECT 2, 'selected families are robust and inside the region', e, CASE WHEN e THEN 'PASS' ELSE 'REVIEW' END FROM f""")
def selection_checks(spark: SparkSession, sf: str) -> DataFrame:
    return report.selection_checks(materialize(family_selection(spark, sf)), 2)
