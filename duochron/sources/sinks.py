"""Writers: text tables, vector matrices, and a manifest that records parameters and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, compress: bool = True) -> None:
    """Tab-separated parts with a header; nested columns go out as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip" if compress else "none")


def write_vectors(df: DataFrame, path: str, id: str, vec: str) -> None:
    """A vector matrix keyed by id (never by position), stored as array<float>."""
    df.select(id, F.col(vec).cast("array<float>").alias(vec)).write.mode("overwrite").parquet(path)


def manifest(parameters: dict, files: DataFrame, guardrails: dict[str, bool]) -> DataFrame:
    """One JSON document: sorted parameters, file hashes, what was deliberately not done."""
    spark = files.sparkSession
    head = spark.createDataFrame([(dict(sorted((k, str(v)) for k, v in parameters.items())), dict(sorted(guardrails.items())))], "parameters map<string,string>, guardrails map<string,boolean>")
    listed = files.agg(F.array_sort(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("files"))  # one entry per staged file
    doc = head.crossJoin(listed).withColumn("written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return doc.select(F.to_json(F.struct("files", "guardrails", "parameters", "written_at")).alias("value"))


def write_manifest(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").text(path)
