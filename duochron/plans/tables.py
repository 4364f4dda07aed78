"""How the study's entities, vectors, counts and intervals are read from the given tables.

Each helper has the same relation as SQL text next to it, used by the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import section
from ..operators.ordered import rank_rows

LABELS = ["view", "click", "signup", "purchase", "error"]
VECTOR_LABELS = [str(i) for i in range(10)]
DIMS = 32

# wall-clock days since the table's first month, read without a time zone
_DAYS = (
    "datediff(to_date(ts), DATE'2024-01-01') + (hour(ts) * 3600 + minute(ts) * 60 + CAST(extract(SECOND FROM ts) AS DOUBLE)) / 86400"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """events as entities: clock, label, batch, and one scalar per modality (a, b)."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.expr(_DAYS).alias("clock"),
        F.col("event_type").alias("label"),
        (F.col("user_id") % 3).alias("batch"),
        F.col("value").alias("a"),
        F.get_json_object("props", "$.k").cast("double").alias("b"),
    )


ENTITIES = """
entities AS (
  SELECT event_id AS id,
         datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) + (hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts)::DOUBLE / 1e6::DOUBLE) / 86400 AS clock,
         event_type AS label, user_id % 3 AS batch, value AS a,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b
  FROM events)"""

RANKED = ENTITIES + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY clock, id) - 1 AS rk FROM entities)"""


def ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    e = entities(spark, sf)
    n = e.count()
    return rank_rows(e, ["clock", "id"]), n


DESIGNS_SQL = """
designs AS (SELECT * FROM (VALUES ('300/75', 300, 75), ('400/100', 400, 100), ('500/125', 500, 125)) t(window_config, window_size, step_size)),
windows AS (
  SELECT window_config, window_size, step_size, w AS window_index, w * step_size AS start_rank, w * step_size + window_size AS stop_rank
  FROM designs, LATERAL (SELECT unnest(range(0, greatest(0, ((SELECT count(*) FROM ranked) - window_size) // step_size + 1))) AS w)),
held AS (SELECT w.*, r.* FROM windows w JOIN ranked r ON r.rk >= w.start_rank AND r.rk < w.stop_rank)"""

# long score curves of both modalities: window means on window median positions
PROFILES = RANKED + "," + DESIGNS_SQL + """,
wide AS (SELECT window_config, window_index AS idx, median(clock) AS x, round(sum(a) / any_value(window_size), 9) AS ya, round(sum(b) / any_value(window_size), 9) AS yb
         FROM held GROUP BY ALL),
profile AS (
  SELECT 'A|' || window_config AS series, 'A' AS modality, window_config, idx, x, ya AS y FROM wide
  UNION ALL SELECT 'B|' || window_config, 'B', window_config, idx, x, yb FROM wide)"""


def profiles(spark: SparkSession, sf: str, designs=None, order: tuple[DataFrame, int] | None = None) -> DataFrame:
    """`order` is what `ranked` gave, where several stages read it."""
    from ..operators.windows import DESIGNS, mean_scores

    r, n = order or ranked(spark, sf)
    return mean_scores(r, designs or DESIGNS, n, {"A": "a", "B": "b"})


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as paired vectors: modality A = the first half of the dimensions, B = the second."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("label"),
        (F.col("vec_id") % 3).alias("batch"),
        (F.col("vec_id") % 7).alias("stage"),
        section(F.col("embedding"), 1, DIMS).alias("va"),
        section(F.col("embedding"), DIMS + 1, DIMS).alias("vb"),
    )


VECTORS = """
vectors AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, vec_id % 3 AS batch, vec_id % 7 AS stage,
         CAST(embedding[1:32] AS DOUBLE[]) AS va, CAST(embedding[33:64] AS DOUBLE[]) AS vb
  FROM embeddings),
dims AS (SELECT id, label, batch, stage, d AS dimension, va[d] AS xa, vb[d] AS xb FROM vectors, LATERAL (SELECT unnest(range(1, 33)) AS d))"""


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as sparse counts: entity = order, feature = part, count = quantity."""
    from ..operators.counts import collapse

    return collapse(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", F.col("l_quantity"))


COUNTS = """
counts AS (SELECT l_orderkey AS entity, l_partkey AS feature, sum(l_quantity) AS count FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as coordinates: a sequence name and a half-open interval per row."""
    code = F.col("l_suppkey") % 24 + 1
    name = F.when(code == 20, "X").when(code == 21, "Y").otherwise(code.cast("string"))
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    start = day * 2000 + F.col("l_partkey") % 2000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.concat(F.lit("chr"), name).alias("chrom"), start.alias("start"), (start + 200 + F.col("l_quantity").cast("bigint")).alias("end"), "l_quantity"
    )


INTERVALS = """
intervals AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
         'chr' || CASE l_suppkey % 24 + 1 WHEN 20 THEN 'X' WHEN 21 THEN 'Y' ELSE CAST(l_suppkey % 24 + 1 AS VARCHAR) END AS chrom,
         datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 2000 + l_partkey % 2000 AS start,
         datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 2000 + l_partkey % 2000 + 200 + CAST(l_quantity AS BIGINT) AS "end"
  FROM lineitem)"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """orders as anchors: sequence name (none on chr24), position, name and strand."""
    code = F.col("o_custkey") % 23 + 1
    name = F.when(code == 20, "X").when(code == 21, "Y").otherwise(code.cast("string"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("anchor_id"), F.concat(F.lit("chr"), name).alias("chrom"), (day * 2000 + F.col("o_custkey") % 2000).alias("position"),
        F.concat(F.lit("G"), (F.col("o_custkey") % 500).cast("string")).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


ANCHORS = """
anchors AS (
  SELECT o_orderkey AS anchor_id,
         'chr' || CASE o_custkey % 23 + 1 WHEN 20 THEN 'X' WHEN 21 THEN 'Y' ELSE CAST(o_custkey % 23 + 1 AS VARCHAR) END AS chrom,
         datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 2000 + o_custkey % 2000 AS position,
         'G' || CAST(o_custkey % 500 AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM orders)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """documents as sequences: the letters A, C, G and T of the whole text."""
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")
    )


SEQUENCES = """
sequences AS (SELECT doc_id, lang, source, n_chars, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"""
