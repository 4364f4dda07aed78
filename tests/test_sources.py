"""Readers and sinks on small files; strict failures where the format demands them."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from duochron.functions import scalars as S
from duochron.operators import audit, report
from duochron.sources import readers as R, sinks


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_matrix_market_and_dense(spark, tmp_path):
    mm = put(tmp_path / "m.mtx.gz", "%%MatrixMarket matrix coordinate integer general\n% c\n3 4 3\n1 1 5\n3 4 3\n2 2 1\n")
    assert R.matrix_market_size(spark, mm) == (3, 4, 3)
    assert sorted(map(tuple, R.matrix_market(spark, mm).collect())) == [(0, 0, 5.0), (1, 1, 1.0), (2, 3, 3.0)]
    with pytest.raises(ValueError):
        R.matrix_market_size(spark, put(tmp_path / "bad.mtx", "1 2 3\n"))
    dense = put(tmp_path / "d.tsv.gz", "gene\tR1.01,P1\tR2.02,P2\ng1\t0\t4\ng2\t7\t0\n")
    assert [r.barcode for r in R.dense_header(spark, dense).orderBy("position").collect()] == ["R1.01.P1", "R2.02.P2"]
    assert sorted(map(tuple, R.dense_matrix(spark, dense).collect())) == [("g1", "R2.02.P2", 4.0), ("g2", "R1.01.P1", 7.0)]
    only = spark.createDataFrame([("R1.01.P1",)], "barcode string")
    assert [tuple(r) for r in R.dense_matrix(spark, dense, only).collect()] == [("g2", "R1.01.P1", 7.0)]
    for text in ("gene\ta\ng1\t1\t2\n", "gene\ta\ng1\t-1\n"):
        with pytest.raises(Exception):
            R.dense_matrix(spark, put(tmp_path / f"x{len(text)}.tsv", text)).collect()


def test_intervals_barcodes_features(spark, tmp_path):
    bed = put(tmp_path / "p.bed", "# c\nchr1\t1\t5\nchr2\t7\t9\n")
    assert [tuple(r) for r in R.bed(spark, bed).orderBy("position").collect()] == [(0, "chr1", 1, 5), (1, "chr2", 7, 9)]
    bc = put(tmp_path / "b.txt.gz", "b1\n\n b2 \n")
    assert [tuple(r) for r in R.barcodes(spark, bc).orderBy("position").collect()] == [(0, "b1"), (1, "b2")]
    ft = put(tmp_path / "f.tsv", "E1\tGene1\tGene Expression\n")
    assert R.feature_table(spark, ft).first()["feature_name"] == "Gene1"
    fr = put(tmp_path / "fr.tsv", "# id=run7\nchr1\t1\t5\tb1\t2\nchr1\tx\t5\tb1\t2\nchr1\t3\n")
    rows = R.fragments(spark, fr).collect()
    assert [r.malformed for r in rows].count(True) == 2 and len(rows) == 3
    assert tuple(R.header_fields(spark, fr).first()) == ("id", "run7")


def test_gene_models_and_anchors(spark, tmp_path):
    ref = put(tmp_path / "r.txt.gz", "G1\tNM_1\t1\t+\t100\t200\t0\t0\t1\t,\t,\nG2\tNM_2\tchr2\t-\t100\t200\t0\t0\t1\t,\t,\nG3\tNM_3\tchr2\t.\t1\t2\t0\t0\t1\t,\t,\n")
    g = R.gene_models(spark, ref)
    assert sorted((r.gene_symbol, r.chrom, r.tss) for r in g.collect()) == [("G1", "chr1", 100), ("G2", "chr2", 199)]
    bed = put(tmp_path / "a.bed", "track x\nchr1\t10\t20\tNM_1\t0\t+\n2 10 20 G2 0 -\nchr3\t1\t2\tZZ\t0\t+\nchr3\t1\n")
    a, bad = R.anchor_bed(spark, bed, g)
    assert bad == 1 and sorted((r.symbol, r.symbol_source, r.tss) for r in a.collect()) == [("G1", "transcript_map", 10), ("G2", "name_is_symbol", 19), ("ZZ", "unresolved", 1)]


def test_pfm_text(spark, tmp_path):
    ok = put(tmp_path / "m.txt", ">MA1.1\tTF1\nA [ 1 2 ]\nC [ 3 4 ]\nG [5 6]\nT [ 7 8 ]\n>MA2.1\nA [1]\nC [1]\nG [1]\nT [1]\n")
    got = {r.motif_id: r for r in R.pfms(spark, ok).collect()}
    assert got["MA1.1"].pfm == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]] and got["MA2.1"].tf_name == "MA2.1"
    with pytest.raises(Exception):
        R.pfms(spark, put(tmp_path / "bad.txt", ">M\tT\nA [1 2]\nC [1]\nG [1 2]\nT [1 2]\n")).collect()


def test_integrity_and_sinks(spark, tmp_path):
    f = put(tmp_path / "one.txt", "hello")
    h = R.file_hashes(spark, f).first()
    assert h["sha256"] == hashlib.sha256(b"hello").hexdigest() and h["bytes"] == 5 and R.readable_text(spark, f)
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<double>")
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first()["v"] == "[1.0,2.0]"
    sinks.write_vectors(df, str(tmp_path / "v"), "id", "v")
    assert spark.read.parquet(str(tmp_path / "v")).schema["v"].dataType.simpleString() == "array<float>"
    sinks.write_manifest(sinks.manifest({"seed": 785, "k": 30}, R.file_hashes(spark, f), {"no_tests": True}), str(tmp_path / "m"))
    part = next(p for p in os.listdir(tmp_path / "m") if p.startswith("part"))
    doc = json.loads(open(tmp_path / "m" / part).read())
    assert doc["parameters"] == {"k": "30", "seed": "785"} and doc["files"][0]["name"] == "one.txt"


def test_metadata_and_alignment_checks(spark, tmp_path):
    md = put(tmp_path / "md.tsv", "cell\tstage\nc1\tE8\n")
    assert R.metadata(spark, md, ["cell"]).count() == 1
    with pytest.raises(ValueError):
        R.metadata(spark, md, ["sample"])
    a = spark.createDataFrame([(1,), (2,)], "id bigint")
    with pytest.raises(ValueError):
        R.align(a, a.limit(1), "id")
    with pytest.raises(ValueError):
        audit.paired_join(a, a.unionAll(a), "id")
    with pytest.raises(ValueError):
        audit.require_one_row(a, "pair")


def test_scalar_edges(spark):
    one = spark.range(1)
    code = lambda s: one.select(S.encode_bin(F.lit(s), F.lit(25_000))).first()[0]
    assert (code("chrX"), code("1"), code("chr20"), code("chrM"), code("CHRy")) == (20 * 100_000 + 2, 100_002, None, None, 21 * 100_000 + 2)
    with pytest.raises(Exception):
        one.select(S.encode_bin(F.lit("chr1"), F.lit(10**10))).collect()
    assert one.select(S.gc_fraction(F.lit("NNN"))).first()[0] is None
    assert one.select(S.distance_class(F.lit(2000)), S.distance_class(F.lit(2001)), S.distance_class(F.lit(None).cast("bigint"))).first()[:] == ("promoter_2kb", "proximal_10kb", "no_reference_chromosome")


def test_markdown(spark):
    t = report.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, y int"))
    assert t.splitlines() == ["| x | y |", "|---|---|", "| a\\|b | 1 |"]


def test_repeated_and_bad_intervals(spark):
    seq = spark.createDataFrame([("c1", "ACGTNNNNacgtAC"), ("c2", "NNNN")], "chrom string, seq string")
    rows = [("c1", 0, 4), ("c1", 0, 4), ("c1", 6, 14), ("c1", 4, 4), ("c1", 9, 2), ("c1", 10, 15), ("c1", -1, 3), ("c3", 0, 2), ("c2", 0, 4), (None, 0, 1), ("c1", None, 3)]
    got = R.extract_sequences(spark.createDataFrame(rows, "chrom string, start bigint, end bigint"), seq, tile=3).collect()
    want = [("ACGT", None)] * 2 + [("NNACGTAC", None)] + [(None, "out_of_range")] * 4 + [(None, "unknown_sequence")] + [("NNNN", "no_valid_base")] + [(None, "unknown_sequence"), (None, "out_of_range")]
    assert sorted(map(str, [(r.chrom, r.start, r.end, r.sequence, r.issue) for r in got])) == sorted(map(str, [(*r, *w) for r, w in zip(rows, want)]))


def test_columns_by_role(spark):
    roles = {"label": ["cell type", "label"], "batch": ["batch", "sample"], "clock": ["time"]}
    got = audit.columns_by_role(["RNA:Cell-Type", "Label ", "sample", "x_batch"], roles)
    assert got == {"label": "Label ", "batch": "sample", "clock": None}  # very names before qualified ones
    assert audit.columns_by_role(["rna:cell_type", "subtype"], roles)["label"] == "rna:cell_type"
    assert audit.columns_by_role(["celltype", "mysample"], roles) == {"label": None, "batch": None, "clock": None}
    for twice in (["rna:batch", "atac:batch"], ["Sample", "sample "]):
        with pytest.raises(ValueError):
            audit.columns_by_role(twice, roles)
    tables = {"a": ["time"], "b": ["batch", "label"], "c": ["label", "sample"]}
    assert audit.table_by_roles(tables, roles) == ("b", {"label": "label", "batch": "batch", "clock": None})
    with pytest.raises(ValueError):
        audit.table_by_roles({"a": ["z"]}, roles)
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 2)], "`rna.label` string, batch int")
    rows = audit.role_audit(df, audit.columns_by_role(df.columns, roles)).collect()
    assert sorted(map(tuple, rows)) == [("batch", "batch", 2, 2), ("label", "rna.label", 2, 1)]
