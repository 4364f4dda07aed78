"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, contamination, langid, merkle, mil, packed, quality, secrets, simhash, substrings, topk, urls, whitening
from .common import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substrings")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


# (host, start of the path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_urls")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


@query("op4_mil")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op6_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


@query("op7_contamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_packed")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_folder(spark, "packed")
    packed.write(table(spark, sf_dir, "documents"), to, tokenizer_file("byte_bpe_50k.json"))
    return packed.documents(spark, to)


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))  # beyond long: null


OP12_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, lang, text, coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS middle,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS head,
           xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(
               [[CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, strlen(CAST(doc_id AS VARCHAR)) + 1)])),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS crc
    FROM documents
), leaves AS (
    SELECT doc_id, lang, sha256(head || middle || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN crc % 3 = 0 THEN sha256(head || middle || coalesce(strlen(text) || ':' ||
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS held
    FROM d
), placed AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos FROM leaves
), tree AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS l FROM placed GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, [sha256(array_to_string(l[i * 8 + 1 : i * 8 + 8], '')) for i in range(0, CAST(ceil(len(l) / 8) AS BIGINT))] FROM tree WHERE len(l) > 1
), sub AS (
    SELECT lang, l[1] AS subroot, CAST(row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS BIGINT) AS pos FROM tree WHERE len(l) = 1
), top AS (
    SELECT 0 AS level, list(subroot ORDER BY pos) AS l FROM sub
    UNION ALL
    SELECT level + 1, [sha256(array_to_string(l[i * 8 + 1 : i * 8 + 8], '')) for i in range(0, CAST(ceil(len(l) / 8) AS BIGINT))] FROM top WHERE len(l) > 1
), steps AS (
    SELECT p.lang, p.pos, 0 AS upper, t.level, p.pos // CAST(8 ** t.level AS BIGINT) AS i, t.l FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND len(t.l) > 1
    UNION ALL
    SELECT p.lang, p.pos, 1, t.level, s.pos // CAST(8 ** t.level AS BIGINT), t.l FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top t ON len(t.l) > 1
), paths AS (
    SELECT lang, pos, list(array_to_string(l[i - i % 8 + 1 : i], '') || '|' || array_to_string(l[i + 2 : i - i % 8 + 8], '') ORDER BY upper, level) AS path
    FROM steps GROUP BY lang, pos
), folded AS (
    SELECT p.doc_id, p.leaf, s.subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root,
           sha256(replace(array_to_string(coalesce(q.path, []), ''), '|', '')) AS proof_sha256,
           list_reduce(list_prepend(coalesce(p.held, p.leaf), coalesce(q.path, [])),
               lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
    FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op12_merkle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)]), 0) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(c.e) = len(q.e)
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_topk", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)
