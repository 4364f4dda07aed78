"""Benchmark passages in documents: one Aho-Corasick automaton over all windows, one scan of each text.

Texts are normalised byte for byte (A-Z lower-cased, ASCII separators to blanks), so word k of the
normalised text has one place in the original; hits are mapped back to code points there. A window is
`size` consecutive words of an item; an item of fewer words is one window.

The automaton holds the benchmark's windows, not the documents. Its size follows the benchmark alone
and is bounded: more than `bound` characters of benchmark are dealt to several automata by the hash of
the item, each built and scanned in turn, and the hits of a row are united.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import kept, map_batches, map_text, materialize, raw

SIZE = 10
BOUND = 500_000  # characters of items in one automaton, which takes about 380 bytes a character in each worker
_TO = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
SPAN = "array<struct<first:int,stop:int,begin:int,end:int>>"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO).split()


def windows(items: list[tuple[str | None, bytes | None]], size: int) -> dict[str, tuple[int, frozenset[str]]]:
    """Normalised window -> (its number of words, the ids of the items that have it)."""
    found: dict[str, tuple[int, set[str]]] = {}
    for id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            ids = found.setdefault(" " + b" ".join(part).decode("latin-1") + " ", (len(part), set()))[1]
            if id is not None:
                ids.add(id)
    return {k: (n, frozenset(ids)) for k, (n, ids) in found.items()}


def automaton(found: dict[str, tuple[int, frozenset[str]]]):
    a = ahocorasick.Automaton()
    for k, v in found.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def scan_text(text: bytes | None, a) -> tuple[int, list[dict[str, int]], list[str]]:
    """(words, merged hit ranges by word and by code point of the original, ids of the items hit)."""
    w = words(text)
    if not w or not len(a):
        return len(w), [], []
    hay = b" " + b" ".join(w) + b" "
    hits = list(a.iter(hay.decode("latin-1")))
    if not hits:
        return len(w), [], []
    word_of = np.cumsum(np.frombuffer(hay, np.uint8) == 0x20) - 2  # at a word's closing blank: the word
    change = np.zeros(len(w) + 1, np.int64)
    for end, (n, _) in hits:
        last = int(word_of[end])
        change[last - n + 1] += 1
        change[last + 1] -= 1
    hit = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
    first, stop = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    places = [m.span() for m in _WORD.finditer(text.translate(_TO))]
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))  # code points before a byte
    spans = [{"first": int(f), "stop": int(s), "begin": int(point[places[f][0]]), "end": int(point[places[s - 1][1]])} for f, s in zip(first, stop, strict=True)]
    return len(w), spans, sorted(set().union(*(ids for _, (_, ids) in hits)))


def _scan(docs: DataFrame, keep: list[str], text: str, found: dict) -> DataFrame:
    key = f"automaton {uuid.uuid4().hex}"

    def build():
        a = kept(key, lambda: automaton(found))

        def make(column: pa.Array) -> dict[str, object]:
            n, spans, items = zip(*(scan_text(t, a) for t in raw(column)), strict=True)
            kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "stop", "begin", "end")]))
            return {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, kind), "items": pa.array(items, pa.list_(pa.string()))}

        return make

    return map_text(docs, keep, text, build, f"n_words bigint, spans {SPAN}, items array<string>")


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching ranges of each row become one."""
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            merged: list[dict[str, int]] = []
            for s in sorted(spans, key=lambda s: s["first"]):
                if merged and s["first"] <= merged[-1]["stop"]:
                    if s["stop"] > merged[-1]["stop"]:
                        merged[-1] |= {"stop": s["stop"], "end": s["end"]}
                else:
                    merged.append(dict(s))
            out.append(merged)
        i = b.schema.get_field_index("spans")
        yield b.set_column(i, b.schema.field(i), pa.array(out, b.column(i).type))


def hits(docs: DataFrame, keep: list[str], text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", size: int = SIZE, bound: int = BOUND) -> DataFrame:
    """The `keep` columns of every row of `docs`, with n_words, spans (merged ranges of hit words:
    first, stop by word; begin, end by code point of the original) and items (sorted ids).

    `keep` must not hold the names it adds. Null and wordless texts have no words and no hits; null and
    wordless items have no window; items with a null id are found but not listed; repeated rows come out
    repeated; an empty benchmark hits nothing.
    """
    own = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    parts = 1 + int(own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // bound
    pieces = []
    if parts > 1:  # rows meet again by number; a written table keeps the numbers
        docs = materialize(docs.select(*dict.fromkeys([*keep, text])).withColumn("_row", F.monotonically_increasing_id()))
        keep = [*keep, "_row"]
    for k in range(parts):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()  # at most about `bound` characters
        pieces.append(_scan(docs, keep, text, windows([(r.id, None if r.text is None else r.text.encode()) for r in rows], size)))
    if parts == 1:
        return pieces[0]
    together = pieces[0]
    for p in pieces[1:]:
        together = together.unionByName(p)
    one = together.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in keep[:-1]), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    fields = [one.schema[c] for c in (*keep[:-1], "n_words", "spans", "items")]
    return map_batches(one.drop("_row"), _unite, StructType([StructField(f.name, f.dataType) for f in fields]))


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, bound: int = BOUND) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, the SHA-256 of the item ids, and whether any word is hit."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = hits(slim, ["id"], "text", benchmark, size=size, bound=bound)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        F.col("id").alias(id), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans"
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = hits(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), list(names.values()), names[text], benchmark)
    return found.where(F.size("spans") == 0).select(*(F.col(n).alias(c) for c, n in names.items()))
