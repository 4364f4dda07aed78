"""Readers for the text formats of the field, each with a declared schema.

Gzip members are not splittable: every reader that feeds a heavy step spreads its rows again
after the read. Archives must be unpacked first; Spark does not look inside TAR files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_barcode, normalize_chromosome
from ..operators.audit import require_columns
from ..operators.intervals import resolve_symbols
from ..operators.ordered import rank_rows
from ..session import materialize, shipped
from . import files

HASHED_PIECE = 1 << 23


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines of a one-column text file (plain or gzip)."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value") != "")


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Barcodes with their 0-based file position."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_o"))
    kept = lines.select(F.trim("value").alias("barcode"), "_f", "_o").where(F.col("barcode") != "")
    return rank_rows(kept, ["_f", "_o"], (), "position").select("position", "barcode")


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated features: id, name and type (a missing type reads as NULL)."""
    return spark.read.csv(path, sep="\t", schema="feature_id string, feature_name string, feature_type string")


def matrix_market_size(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """rows, columns, stored entries from the size line, the first line that is no comment."""
    first = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).limit(1).collect()
    banner = spark.read.text(path).limit(1).collect()
    if not banner or not banner[0][0].startswith("%%MatrixMarket"):
        raise ValueError(f"{path}: not a MatrixMarket file")
    parts = first[0][0].split() if first else []
    if len(parts) != 3:
        raise ValueError(f"{path}: unexpected size line")
    return int(parts[0]), int(parts[1]), int(parts[2])


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries (row, col, value), 0-based.

    The size line is recognised by position, not content: the first line after the comments.
    """
    n_rows, n_cols, n_stored = matrix_market_size(spark, path)
    size_line = rf"^\s*{n_rows}\s+{n_cols}\s+{n_stored}\s*$"
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("_o", F.monotonically_increasing_id())
    header = lines.where(F.col("value").rlike(size_line)).agg(F.min("_o").alias("_h"))
    body = lines.crossJoin(F.broadcast(header)).where(F.col("_o") != F.col("_h"))  # one row: the header position
    return parse_entries(body.select("value"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """(row, col, value) of 1-based coordinate lines, made 0-based; a short line is an error."""
    t = F.split(F.trim("value"), r"\s+")
    short = F.when(F.size(t) < 3, F.raise_error(F.lit("malformed MatrixMarket entry")).cast("bigint"))
    return lines.select(F.coalesce(short, t[0].cast("bigint") - 1).alias("row"), (t[1].cast("bigint") - 1).alias("col"), t[2].cast("double").alias("value"))


def dense_header(spark: SparkSession, path: str) -> DataFrame:
    """Barcodes of the first line of a feature x barcode table: (position, raw, barcode)."""
    first = spark.read.text(path).limit(1)
    return first.select(F.posexplode(F.slice(F.split("value", "\t"), F.lit(2), F.size(F.split("value", "\t")))).alias("position", "raw")).withColumn("barcode", normalize_barcode(F.col("raw")))


def unfold_dense(lines: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """Long-form (feature, entity, count) of dense lines `feature<TAB>c1<TAB>c2...`, zeros dropped.

    `names` maps a 0-based position to its entity; unlisted columns are dropped before they
    count. A row of another width or a negative count is an error.
    """
    t = F.split("value", "\t")
    wrong = F.when(F.size(t) != width + 1, F.raise_error(F.concat(F.lit("row width differs at "), t[0])).cast("string"))
    cells = F.filter(F.transform(F.slice(t, F.lit(2), F.size(t)), lambda c, i: F.struct(i.alias("position"), c.cast("double").alias("c"))), lambda s: s["c"] != 0)
    long = lines.select(F.coalesce(wrong, t[0]).alias("feature"), F.inline(cells))
    checked = F.when(F.col("c") < 0, F.raise_error(F.lit("negative count")).cast("double")).otherwise(F.col("c"))
    return long.join(names.select("position", "entity"), "position").select("feature", "entity", checked.alias("count"))


def dense_matrix(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Long-form counts of a dense feature x barcode table; `wanted` has the barcodes to keep."""
    head = dense_header(spark, path)
    lines = spark.read.text(path).withColumn("_o", F.monotonically_increasing_id()).where("_o > 0").drop("_o")
    names = head.select("position", F.col("barcode").alias("entity"))
    if wanted is not None:
        names = names.join(wanted.select(F.col("barcode").alias("entity")).distinct(), "entity", "left_semi")
    return unfold_dense(lines, names, head.count())


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals (position, chrom, start, end), 0-based half-open, in file order."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start bigint, end bigint").withColumn("_o", F.monotonically_increasing_id())
    return rank_rows(raw, ["_o"], (), "position").select("position", "chrom", "start", "end")


def parse_fragments(lines: DataFrame) -> DataFrame:
    """Interval records of text lines, malformed ones flagged instead of failing; # lines skipped.

    Five tab fields with whole-number coordinates make a record.
    """
    t = F.split("value", "\t")
    start, end = F.get(t, F.lit(1)).try_cast("bigint"), F.get(t, F.lit(2)).try_cast("bigint")
    good = F.coalesce((F.size(t) >= 5) & start.isNotNull() & end.isNotNull(), F.lit(False))
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        *rest, F.when(good, F.get(t, F.lit(0))).alias("chrom"), F.when(good, start).alias("start"), F.when(good, end).alias("end"),
        F.when(good, F.get(t, F.lit(3))).alias("barcode"), F.when(good, F.get(t, F.lit(4)).try_cast("int")).alias("n"), (~good).alias("malformed"),
    )


def fragments(spark: SparkSession, path: str) -> DataFrame:
    rows = parse_fragments(spark.read.text(path))
    return rows.repartition() if path.endswith(".gz") else rows


def parse_header_fields(lines: DataFrame) -> DataFrame:
    """key=value pairs of the # header lines."""
    pair = r"^#+\s*([^=]+)=(.*)$"
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.col("value").rlike(pair)).select(
        *rest, F.trim(F.regexp_extract("value", pair, 1)).alias("key"), F.trim(F.regexp_extract("value", pair, 2)).alias("val")
    )


def header_fields(spark: SparkSession, path: str) -> DataFrame:
    return parse_header_fields(spark.read.text(path))


def targets_found(targets: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Targets that occur anywhere in the observed rows (exhaustive; distinct before the join)."""
    return targets.join(observed.select(key).distinct(), key, "left_semi")


def metadata(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Tab-separated entity metadata, all text, required columns checked."""
    return require_columns(spark.read.csv(path, sep="\t", header=True), required, path)


def gene_models(spark: SparkSession, path: str) -> DataFrame:
    """Transcript table with the strand-aware start site."""
    cols = "gene_symbol string, transcript_id string, chrom string, strand string, tx_start bigint, tx_end bigint, cds_start bigint, cds_end bigint, exon_count int, exon_starts string, exon_ends string"
    t = spark.read.csv(path, sep="\t", schema=cols).dropna(subset=["gene_symbol", "transcript_id", "chrom", "strand", "tx_start", "tx_end"])
    t = t.withColumn("line", F.monotonically_increasing_id())  # the place in the list
    return with_start_site(t.where(F.col("strand").isin("+", "-")).withColumn("chrom", normalize_chromosome(F.col("chrom"))), "tx_start", "tx_end")


def with_start_site(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("tss", F.when(F.col("strand") == "+", F.col(start)).otherwise(F.col(end) - 1))


def anchor_bed(spark: SparkSession, path: str, genes: DataFrame) -> tuple[DataFrame, int]:
    """Six-column anchors with start site and symbol, and the number of malformed lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    tab = F.split("value", "\t")
    t = F.when(F.size(tab) >= 6, tab).otherwise(F.split("value", r"\s+"))
    rows = lines.select(
        normalize_chromosome(t[0]).alias("chrom"), t[1].try_cast("bigint").alias("start"), t[2].try_cast("bigint").alias("end"), F.trim(t[3]).alias("name"), F.trim(t[5]).alias("strand"), F.size(t).alias("_n")
    )
    good = (F.col("_n") >= 6) & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("strand").isin("+", "-")
    malformed = rows.where(~F.coalesce(good, F.lit(False))).count()
    kept = with_start_site(rows.where(good).drop("_n"), "start", "end")
    return resolve_symbols(kept, "name", genes), malformed


def parse_pfms(blocks: DataFrame) -> DataFrame:
    """Count matrices of bracketed text blocks (header line without its mark, then four rows):
    (motif_id, tf_name, pfm 4 x L, motif_length). A missing or uneven row is an error."""
    head = F.split(F.split("value", r"\r?\n")[0], "\t")

    def row(base: str) -> Column:
        inside = F.regexp_extract("value", rf"(?m)^\s*{base}\s*\[([^\]]*)\]", 1)
        return F.transform(F.filter(F.split(inside, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))

    t = blocks.where(F.trim("value") != "").select(
        F.trim(head[0]).alias("motif_id"), F.coalesce(F.trim(F.get(head, F.lit(1))), F.trim(head[0])).alias("tf_name"), F.array(*[row(b) for b in "ACGT"]).alias("pfm")
    )
    width = F.size(F.col("pfm")[0])
    bad = (width == 0) | F.exists("pfm", lambda r: F.size(r) != width)
    return t.withColumn("motif_length", F.when(bad, F.raise_error(F.concat(F.lit("incomplete matrix "), F.col("motif_id"))).cast("int")).otherwise(width))


def pfms(spark: SparkSession, path: str) -> DataFrame:
    return parse_pfms(spark.read.text(path, lineSep=">"))


def tiles_of(sequences: DataFrame, chrom: str = "chrom", tile: int = 65_536) -> DataFrame:
    """Whole sequences (chrom, seq) as tiles (chrom, tile, part), cut in one pass over each."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    return sequences.select(chrom, F.posexplode(parts).alias("tile", "part"))


def extract_sequences(intervals: DataFrame, sequences: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", tile: int = 65_536) -> DataFrame:
    """Upper-cased sequence of each interval from a table of whole sequences (chrom, seq), and what is
    wrong with it (issue, NULL if nothing): unknown_sequence, out_of_range, length_mismatch or
    no_valid_base. Repeated intervals come out repeated; an empty or reversed one is out of range.

    Sequences are cut into tiles first, so an interval meets a tile and never a whole
    chromosome; an interval across tiles is put together again. Intervals are numbered and written
    once, so that the pieces of one row meet again.
    """
    sizes = sequences.select(chrom, F.length("seq").cast("bigint").alias("size"))
    return extract_from_tiles(intervals, tiles_of(sequences, chrom, tile), sizes, chrom, start, end, tile)


def extract_from_tiles(intervals: DataFrame, tiles: DataFrame, sizes: DataFrame, chrom: str = "chrom", start: str = "start", end: str = "end", tile: int = 65_536) -> DataFrame:
    """`extract_sequences` on sequences that are tiles (chrom, tile, part) of known sizes (chrom, size), as
    the packed reader gives them."""
    keys = intervals.columns
    numbered = materialize(intervals.withColumn("_row", F.monotonically_increasing_id()))
    placed = numbered.join(sizes.select(F.col(chrom).alias("_c"), F.col("size").alias("_size")), F.col(chrom) == F.col("_c"), "left").drop("_c")
    wrong = F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < 0) | (F.col(end) <= F.col(start)) | (F.col(end) > F.col("_size"))
    valid = placed.where(F.col("_size").isNotNull() & ~wrong)
    asked = valid.select("_row", chrom, start, end).withColumn("tile", F.explode(F.sequence(F.floor(F.col(start) / tile), F.floor((F.col(end) - 1) / tile))))
    lo = F.greatest(F.col(start) - F.col("tile") * tile, F.lit(0))
    hi = F.least(F.col(end) - F.col("tile") * tile, F.lit(tile))
    piece = F.substring(F.col("part"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    held = tiles.select(chrom, F.col("tile").cast("bigint").alias("tile"), "part")
    got = asked.join(held, [chrom, "tile"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("tile", piece.alias("p")))).alias("_p"))
    seq = F.upper(F.array_join(F.transform("_p", lambda s: s["p"]), ""))
    named = placed.join(got.select("_row", seq.alias("sequence")), "_row", "left")
    issue = (
        F.when(F.col("_size").isNull(), "unknown_sequence").when(wrong, "out_of_range")
        .when(F.length("sequence") != F.col(end) - F.col(start), "length_mismatch").when(~F.col("sequence").rlike("[ACGT]"), "no_valid_base")
    )
    return named.select(*keys, "sequence", F.coalesce(F.length("sequence") == F.col(end) - F.col(start), F.lit(False)).alias("complete"), issue.alias("issue"))


# -------------------------------------------------------------------- integrity
def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of whole files of any size, hashed on the executors.

    Spark lists the files; each is read in pieces of HASHED_PIECE bytes by one task, so memory does not
    follow a file's size. That needs a store that pyarrow opens (`files.SCHEMES`); on any other, content
    comes through Spark's reader, which holds at most 2 GiB a file and refuses more.
    """
    raw = spark.read.format("binaryFile").load(path)
    named = raw.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumnRenamed("length", "bytes")
    if any(files.scheme(f) not in files.SCHEMES for f in raw.inputFiles()[:1]):
        return named.select("name", "bytes", F.sha2("content", 256).alias("sha256"))
    spread = shipped(named.select("path", "name", "bytes")).repartition("path")  # a task a file, not a few
    return spread.mapInPandas(_hash_files, "name string, bytes bigint, sha256 string")


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        digests = []
        for path in pdf["path"]:
            fs, at = files.opened(path)
            digest = hashlib.sha256()
            with fs.open_input_file(at) as f:
                while piece := f.read(HASHED_PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pdf[["name", "bytes"]].assign(sha256=digests)


def verify_provenance(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Size and hash of each file against a manifest (name, bytes, sha256)."""
    m = manifest.select("name", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256"))
    j = m.join(found, "name", "full")
    same = (F.col("bytes") == F.col("expected_bytes")) & (F.col("sha256") == F.col("expected_sha256"))
    return j.select("name", F.col("sha256").isNotNull().alias("present"), F.coalesce(same, F.lit(False)).alias("verified"))


def readable_text(spark: SparkSession, path: str) -> bool:
    """Can the first two lines be read (decompressed) at all?"""
    return len(spark.read.text(path).limit(2).collect()) > 0


def classify_members(names: DataFrame, name: str, patterns: dict[str, str]) -> DataFrame:
    """Member class of file names by the first pattern that matches, with its first group."""
    kind: Column = F.lit(None).cast("string")
    sample: Column = F.lit(None).cast("string")
    for label, pattern in reversed(list(patterns.items())):
        hit = F.col(name).rlike(pattern)
        kind = F.when(hit, label).otherwise(kind)
        sample = F.when(hit, F.regexp_extract(name, pattern, 1)).otherwise(sample)
    return names.select("*", kind.alias("member_class"), sample.alias("sample"))


def align(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two stored artifacts joined on a key that must be unique and complete on both sides."""
    from ..operators.audit import pairing_audit, paired_join

    audit = pairing_audit(a, b, key).first()
    if not audit["one_to_one"]:
        raise ValueError(f"artifacts do not pair one to one on {key}: {audit.asDict()}")
    return paired_join(a, b, key)
