"""Merkle manifest of a table of documents, with one proof per document from octopus multiproofs.

Every row is a leaf; the leaves of a language, ascending by id, form a tree of eight-fold runs up to its
subroot, and the subroots form one more tree up to the root. Both are kept as nodes (tree, level, idx).

1. Leaves are hashed where the texts lie; only digests move on. Positions within a language come from
   range partitioning (`rank_rows`), so no language goes through one task.
2. A leaf partition is a run of 4,096 leaves of one language. Its top node is computed inside it; the levels
   above have a 4,096th of the rows and are built by grouping, level by level.
3. Each leaf partition computes the minimal union of coordinates it lacks for all its leaves together: at
   each level the siblings beside what it knows or can derive, up to the subroot, then those of its subroot.
   Spark joins fetch each coordinate once for the partition, not once for each leaf.
4. With them the partition derives its interior nodes once, expands the proof of every leaf, and folds each
   leaf that is to be checked back up to a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import rank_rows
from .common import discard, map_batches, map_groups, materialize, stored

FAN = 8
HEIGHT = 4  # of a leaf partition, so that it has 4,096 leaves
ROOTS = "r"  # the tree over subroots; languages' trees are "n" for null, else "v" and the language
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Node = tuple[str, int, int]


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above `n` nodes until one remains."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def missing(first: int, last: int, n: int, base: int = 0) -> Iterator[tuple[int, int]]:
    """(level, idx) of the fewest nodes that, with leaves `first` to `last` of `n`, give the root.
    Level 0 of the count is `base` of the tree."""
    level = base
    while n > 1:
        for i in (*range(first - first % FAN, first), *range(last + 1, min(last - last % FAN + FAN, n))):
            yield level, i
        first, last, n, level = first // FAN, last // FAN, -(-n // FAN), level + 1


def layers(digests: Sequence[str], up: int) -> list[list[str]]:
    """`digests` and the `up` levels above them."""
    out = [list(digests)]
    for _ in range(up):
        d = out[-1]
        out.append([H("".join(d[i : i + FAN])) for i in range(0, len(d), FAN)])
    return out


def beside(nodes: Sequence[str], i: int) -> tuple[str, str]:
    """Siblings of place `i` in a run, those before and those after it."""
    run = i - i % FAN
    return "".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = H(before + leaf + after)
    return leaf


def fetched_path(nodes: dict[Node, str], tree: str, idx: int, n: int, base: int) -> list[tuple[str, str]]:
    """The path of one node up to its tree's root, from fetched siblings."""
    out, level = [], base
    while n > 1:
        run = idx - idx % FAN
        out.append(("".join(nodes[tree, level, i] for i in range(run, idx)), "".join(nodes[tree, level, i] for i in range(idx + 1, min(run + FAN, n)))))
        idx, n, level = idx // FAN, -(-n // FAN), level + 1
    return out


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 over the fields, each with its length in bytes before it; `-` stands for null."""
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def leaves(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, tree, leaf and the leaf of what is held now: where `changed` is true the text's letters A-Z
    are lower-cased, which stands for tampering."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    lower = F.translate(c["text"], _UPPER, _UPPER.lower())
    return docs.select(
        c["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("v"), c["lang"]), F.lit("n")).alias("tree"),
        leaf_of(*c.values()).alias("leaf"),
        F.when(changed, leaf_of(*{**c, "text": lower}.values())).alias("held"),
    )


def tampered(doc_id: Column) -> Column:
    """Whether three divides the unsigned CRC-32 of the decimal id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0


def _levels(base: DataFrame) -> DataFrame:
    """All levels above nodes (tree, level, idx, digest, m), `m` being how many the level has."""
    most = base.agg(F.max("m")).first()[0] or 0
    out = cur = base
    for _ in range(height(most)):
        runs = cur.where("m > 1").groupBy("tree", (F.col("level") + 1).alias("level"), F.expr(f"idx div {FAN}").alias("idx"), F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"))
        cur = runs.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
        out = out.unionByName(cur)
    return out


def _top(t: pa.Table, most: int) -> pa.Table:
    """The top node of one leaf partition of height `most`."""
    row = t.slice(0, 1).to_pylist()[0]
    digests = [d for _, d in sorted(zip(t.column("pos").to_pylist(), t.column("leaf").to_pylist()))]
    up = min(most, height(row["n"]))
    return pa.table({"tree": [row["tree"]], "level": pa.array([up], pa.int32()), "idx": [row["part"]], "digest": [layers(digests, up)[up][0]], "m": [-(-row["n"] // FAN**most)]})


def _wanted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The coordinates each leaf partition lacks, with its subroot and the root to hold against."""
    for b in batches:
        for r in b.to_pylist():
            up = min(most, height(r["n"]))
            m = -(-r["n"] // FAN**most)
            ask = [(r["tree"], level, i) for level, i in missing(r["part"], r["part"], m, up)]
            ask += [(ROOTS, level, i) for level, i in missing(r["at"], r["at"], r["trees"])]
            ask += [(r["tree"], height(r["n"]), 0), (ROOTS, height(r["trees"]), 0)]
            tree, level, idx = zip(*dict.fromkeys(ask))
            yield pa.RecordBatch.from_pydict({"tree": [r["tree"]] * len(tree), "part": pa.array([r["part"]] * len(tree), pa.int64()), "from_tree": tree, "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64())})


def _expanded(t: pa.Table, most: int) -> pa.Table:
    """All proofs of one leaf partition, from its leaves (level null) and the nodes it fetched."""
    own, got = [], {}
    for r in t.to_pylist():
        if r["level"] is None:
            own.append(r)
        else:
            got[r["from_tree"], r["level"], r["idx"]] = r["digest"]
    own.sort(key=lambda r: r["pos"])
    tree, part, n, at, trees = (own[0][c] for c in ("tree", "part", "n", "at", "trees"))
    up = min(most, height(n))
    inner = layers([r["digest"] for r in own], up)  # shared by all leaves here
    above = fetched_path(got, tree, part, -(-n // FAN**most), up) + fetched_path(got, ROOTS, at, trees, 0)
    rest = "".join(a + b for a, b in above)
    subroot, root, whole = got[tree, height(n), 0], got[ROOTS, height(trees), 0], fold(inner[up][0], above)
    out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
    for i, r in enumerate(own):
        path = [beside(inner[level], i // FAN**level) for level in range(up)]
        folded = whole if r["held"] is None or r["held"] == r["digest"] else fold(r["held"], path + above)
        for c, v in zip(out, (r["doc_id"], r["digest"], subroot, root, H("".join(a + b for a, b in path) + rest), folded, folded == root)):
            out[c].append(v)
    return pa.table({c: pa.array(v, pa.int64() if c == "doc_id" else pa.bool_() if c == "verified" else pa.string()) for c, v in out.items()})


class Manifest:
    """`leaves` with their positions, and `nodes` of all trees from the tops of leaf partitions up.

    `tree, level, idx, digest` of a node; the root is the one node of the highest level of `ROOTS`."""

    def __init__(self, rows: DataFrame, most: int = HEIGHT):
        self.most = most
        table = stored(rows, "leaves")  # texts are read once
        ranked = rank_rows(table, ["doc_id", "leaf"], ["tree"], "pos").withColumn("part", F.expr(f"pos div {FAN**most}"))
        sizes = materialize(ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
        self.trees = sizes.count()
        placed = rank_rows(sizes, ["tree"], out="at").withColumn("trees", F.lit(self.trees).cast("bigint"))
        self.leaves = ranked.join(placed, "tree")
        tops = materialize(map_groups(self.leaves.select("tree", "part", "n", "pos", "leaf"), ["tree", "part"], partial(_top, most=most), "tree string, level int, idx bigint, digest string, m bigint"))
        inner = materialize(_levels(tops))
        subroots = inner.where("m = 1").join(placed.select("tree", "at"), "tree").select(F.lit(ROOTS).alias("tree"), F.lit(0).alias("level"), F.col("at").alias("idx"), "digest", F.lit(self.trees).cast("bigint").alias("m"))
        self.nodes = materialize(inner.unionByName(_levels(materialize(subroots))))
        self.parts = tops.select("tree", F.col("idx").alias("part")).join(placed, "tree")
        discard(table)

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every leaf."""
        ask = map_batches(self.parts, partial(_wanted, most=self.most), "tree string, part bigint, from_tree string, level int, idx bigint")
        nodes = self.nodes.select(F.col("tree").alias("from_tree"), "level", "idx", "digest")
        fetched = ask.join(nodes, ["from_tree", "level", "idx"])
        own = self.leaves.select("tree", "part", "n", "at", "trees", "pos", "doc_id", F.col("leaf").alias("digest"), "held")
        both = own.unionByName(fetched, allowMissingColumns=True)
        return map_groups(both, ["tree", "part"], partial(_expanded, most=self.most), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of `docs` (doc_id,
    text, lang, source, n_chars; others are not looked at).

    Rows whose id's unsigned CRC-32 is divisible by three are checked as tampered: their folded root comes
    from the text with A-Z in lower case and the original siblings. Nulls in any column hash as `-`; a null
    id comes first in its language and is not tampered with; a null language is the first tree. Rows with
    the same id are ordered by their leaves, and repeated rows are leaves each. A language of one row has
    its leaf as subroot; a single language's subroot is the root, and a single row has an empty proof. An
    empty table gives no rows.
    """
    return Manifest(leaves(docs, tampered(F.col("doc_id")))).proofs()
