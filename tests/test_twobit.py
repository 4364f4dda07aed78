"""Packed sequences written and read back, by byte ranges; hashes of large files in flat memory."""

import hashlib
import os
import random
import resource
import struct

import pytest

from duochron.sources import readers as R, twobit as B


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.chrom, r.tile)):
        assert r.start == len(out.get(r.chrom, ""))
        out[r.chrom] = out.get(r.chrom, "") + r.part
    return out


def test_round_trip_over_many_files_and_tasks(spark, tmp_path):
    rnd = random.Random(3)
    seqs = {f"c{i}": "".join(rnd.choices("ACGTacgtNn", [9, 9, 9, 9, 3, 3, 3, 3, 1, 1], k=rnd.choice([0, 1, 3, 4, 5, 63, 64, 65, 1000]))) for i in range(60)}
    seqs["long"] = "N" * 130 + "acgt" * 5000 + "N" * 7
    df = spark.createDataFrame([*seqs.items(), ("null", None)], "chrom string, seq string").repartition(3)
    B.write_two_bit(df, str(tmp_path / "t"), bytes_per_file=2000)
    assert len([n for n in os.listdir(tmp_path / "t") if n.endswith(".2bit")]) > 3
    # a file of a lost task is no part of the result
    (tmp_path / "t" / "part-lost.2bit").write_bytes(b"".join(B.file_bytes(["lost"], [B.packed("ACGT")])))
    got = B.read_two_bit(spark, str(tmp_path / "t"), tile=64, letters_per_task=256)
    rows = got.collect()
    assert whole(rows) == {**seqs, "null": ""}
    assert {r.chrom: r["size"] for r in rows} == {k: len(v) for k, v in {**seqs, "null": ""}.items()}
    assert got.rdd.getNumPartitions() > 60  # the long one alone is some 80 tasks


def test_one_file_in_either_byte_order_and_broken_ones(spark, tmp_path):
    little = b"".join(B.file_bytes(["a", "b"], [B.packed("ACGTNNac"), B.packed("GGx")]))
    (tmp_path / "x.2bit").write_bytes(little)
    assert whole(B.read_two_bit(spark, str(tmp_path / "x.2bit")).collect()) == {"a": "ACGTNNac", "b": "GGn"}
    # the same by hand, big-endian: T=0 C=1 A=2 G=3, first letter highest; 5 letters GATTA
    big = struct.pack(">IIII", B.SIGNATURE, 0, 1, 0) + b"\x01z" + struct.pack(">I", 22) + struct.pack(">IIIIIII", 5, 1, 1, 1, 1, 3, 2) + struct.pack(">I", 0) + bytes([0b11100000, 0b10000000])
    (tmp_path / "y.2bit").write_bytes(big)
    assert whole(B.read_two_bit(spark, str(tmp_path / "y.2bit")).collect()) == {"z": "GNTta"}
    for name, data in (("short", little[:-1]), ("mark", b"x" * 40), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception):
            B.read_two_bit(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception):
        B.write_two_bit(spark.createDataFrame([(None, "A")], "chrom string, seq string"), str(tmp_path / "n"))


def test_runs_at_the_edges_of_a_part(tmp_path):
    rnd = random.Random(6)
    text = "".join(rnd.choices("ACGTacgtNn", k=400)) + "N" * 30 + "acgt" * 9
    (tmp_path / "x").write_bytes(b"".join(B.file_bytes(["a"], [B.packed(text)])))
    reader = B.TwoBitReader({"path": str(tmp_path / "x"), "tile": "64", "lettersPerTask": "128"})
    with open(tmp_path / "x", "rb") as f:
        import pyarrow as pa

        order, entries = B.index(pa.PythonFile(f))
        r = B.Record(pa.PythonFile(f), entries[0][1], order)
        for a in range(0, 440, 4):
            for b in (a + 1, a + 3, a + 64, 10_000):
                assert r.part(a, b) == text[a:b]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert "".join(x for b in batches for x in b.column("part").to_pylist()) == text and len(batches) < 8


def test_wide_offsets():
    class Long(bytes):
        def __len__(self):
            return 1 << 32

    head = next(B.file_bytes(["a", "b"], [Long(), b""]))
    assert struct.unpack("<IIII", head)[1] == 1


def test_intervals_from_tiles(spark, tmp_path):
    seq = spark.createDataFrame([("c1", "ACGTNNNNacgtAC"), ("c2", "NNNN")], "chrom string, seq string")
    B.write_two_bit(seq, str(tmp_path / "t"))
    tiles = B.read_two_bit(spark, str(tmp_path / "t"), tile=4)
    iv = spark.createDataFrame([("c1", 0, 4), ("c1", 6, 14), ("c1", 10, 15), ("c2", 0, 4), ("c3", 0, 1)], "chrom string, start bigint, end bigint")
    sizes = tiles.where("tile = 0").select("chrom", "size")
    got = R.extract_from_tiles(iv, tiles, sizes, tile=4)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(R.extract_sequences(iv, seq, tile=4))


def test_hash_of_a_file_beyond_two_gib(spark, tmp_path):
    path = tmp_path / "sparse.bin"
    with open(path, "wb") as f:  # a sparse file: no disk is used
        f.truncate((2 << 30) + 5)
    want = hashlib.sha256()
    zero = bytes(1 << 24)
    for _ in range(128):
        want.update(zero)
    want.update(bytes(5))
    r = R.file_hashes(spark, str(path)).first()
    assert (r["bytes"], r["sha256"]) == ((2 << 30) + 5, want.hexdigest())


def test_hashing_memory_is_flat(tmp_path):
    import pandas as pd

    path = tmp_path / "sparse.bin"
    with open(path, "wb") as f:
        f.truncate(1 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    list(R._hash_files([pd.DataFrame({"path": [f"file:{path}"], "name": ["x"], "bytes": [1 << 30]})]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
