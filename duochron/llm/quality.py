"""Quality rules: how far a text's characters and common words lie from its language.

For every text one pass counts the base measures and two histograms: characters by class, and
occurrences of common function words (one class more for all other words). The references are the same
histograms summed per language over the texts that pass the base rule; a second round sums only
those whose characters lie no farther from the first reference than the language's average text, so that
junk does not shape what it is held against. Every language has a reference of its own, however rare; one with
few texts is not trimmed, so that each of its texts is part of what it is held against. A text without a
language is held against the reference nearest to it, never against a mix. A text is rejected if its
Jensen-Shannon distance from its reference is too large in either histogram. The limits shrink with the square
root of the length, as sampling noise does, and texts under a minimum length are not judged at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text, materialize, raw

# Symbols that count, and frequent function words of four languages.
SYMBOLS = b"#*$%&|<>"
COMMON = {
    "en": "the of and to in a is that it for was on are as with his they at be this from have or by had not but what all were when",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou mais",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este fue ha",
}
WORDS = sorted({w.encode() for line in COMMON.values() for w in line.split()})

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent of words
GUARD = 50  # words that a text needs to be held against a reference
CHAR_LIMIT = (0.12, 0.9)  # a + b / sqrt(words)
WORD_LIMIT = (0.12, 2.0)
TRIMMED = 30  # texts from which a language's reference is trimmed
SMALL = 10_000  # languages up to which their references are broadcast

_CLASS_NAMES = ("lower", "upper", "digit", "mark", "symbol", "blank", "other")
_MARKS = b".,;:!?'\"()-"


def _class_of(c: int) -> int:
    if 0x61 <= c <= 0x7A:
        return 0
    if 0x41 <= c <= 0x5A:
        return 1
    if 0x30 <= c <= 0x39:
        return 2
    if c in _MARKS:
        return 3
    if c == 0x20 or 0x09 <= c <= 0x0D:
        return 5
    if c < 0x80:
        return 4
    return 6  # the first byte of a longer code point; its other bytes are not counted


_TABLE = np.zeros((256, len(_CLASS_NAMES)), np.int64)
for _c in range(256):
    if not 0x80 <= _c < 0xC0:
        _TABLE[_c, _class_of(_c)] = 1
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_ODD = np.random.default_rng(11).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled += h[j : j + n] * _ODD[j]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    start = np.flatnonzero(np.isin(rolled, twice))
    change[start] += 1
    change[start + WINDOW] -= 1
    return int((np.cumsum(change) > 0).sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int, np.ndarray, list[int]]:
    """(words, code points in words, symbols, repeated lines, repeated words, histograms)."""
    text = text or b""
    words = text.split()
    size = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = size @ _TABLE
    lines = [x for x in text.split(b"\n") if x.strip()]
    plain = text.translate(_PLAIN).split()
    counts = dict.fromkeys(WORDS, 0)
    known = [w for w in plain if w in counts]
    for w in known:
        counts[w] += 1
    return (
        len(words), int(chars.sum() - chars[5]), int(size[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words), chars, [*counts.values(), len(plain) - len(known)],
    )


def measures(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The `keep` columns, the base measures and the two histograms (chars, common) of every row."""

    def build():
        def make(column: pa.Array) -> dict[str, object]:
            got = [measure(t) for t in raw(column)]
            out: dict[str, object] = {k: pa.array([g[i] for g in got], pa.int64()) for i, k in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
            for i, k in ((5, "chars"), (6, "common")):
                flat = np.array([g[i] for g in got], np.int64).reshape(len(got), -1)
                out[k] = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            return out

        return make

    longs = ", ".join(f"{k} bigint" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_text(docs, keep, text, build, f"{longs}, chars array<bigint>, common array<bigint>")


def references(measured: DataFrame, lang: str) -> DataFrame:
    """(ref_lang, ref_chars, ref_common): the shares of the summed histograms of every language."""
    sums = [F.sum(F.col("chars")[i]) for i in range(len(_CLASS_NAMES))], [F.sum(F.col("common")[i]) for i in range(len(WORDS) + 1)]
    by = measured.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("ref_lang")).agg(*(F.array(*s).alias(k) for s, k in zip(sums, ("chars", "common"), strict=True)))
    return materialize(by.select("ref_lang", *(_shares(k).alias(f"ref_{k}") for k in ("chars", "common"))))


def distance(counts: str, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) between a histogram and a reference; null if empty."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    both = F.zip_with(F.transform(counts, lambda x: x / total), reference, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.when((total > 0) & (F.aggregate(reference, F.lit(0.0), lambda a, x: a + x) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2)))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _small(by: DataFrame) -> DataFrame:
    return F.broadcast(by) if by.count() <= SMALL else by


def _against(m: DataFrame, lang: str, refs: DataFrame) -> DataFrame:
    """The rows of `m` with both distances from their language's reference; null if it has none."""
    far = [distance(k, F.col(f"ref_{k}")).alias(name) for k, name in (("chars", "char_distance"), ("common", "word_distance"))]
    return m.join(_small(refs), F.col(lang) == F.col("ref_lang"), "left").select(*m.columns, *far)


def _against_nearest(m: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of `m` with both distances from the one reference whose words, then characters, are nearest."""
    every = refs.agg(F.collect_list(F.struct("ref_chars", "ref_common")).alias("ref_all"))
    apart = lambda r: F.struct(F.coalesce(distance("common", r["ref_common"]), F.lit(2.0)).alias("w"), distance("chars", r["ref_chars"]).alias("c"))
    near = m.crossJoin(F.broadcast(every)).withColumn("ref_near", F.array_min(F.transform("ref_all", apart)))
    return near.select(*m.columns, F.col("ref_near.c").alias("char_distance"), F.when(F.col("ref_near.w") <= 1.5, F.col("ref_near.w")).alias("word_distance"))


def judged(docs: DataFrame, keep: list[str], text: str, lang: str) -> DataFrame:
    """The `keep` columns with the base measures, char_distance, word_distance, base_failed and kept.

    `keep` must hold `lang` and none of the added names. Null and empty texts have no words and fail
    the base rule; a text with a null language is held against the nearest of all references; a language
    none of whose texts passes the base rule has no reference and null distances; repeated rows are
    judged alike; without any text of a known language that passes the base rule nothing more is rejected;
    an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    m = materialize(measures(docs, keep, text).withColumn("base_failed", failed))
    sound = m.where(~F.col("base_failed") & F.col(lang).isNotNull())
    first = _against(sound, lang, references(sound, lang))
    average = materialize(first.groupBy(F.col(lang).alias("ref_lang")).agg(F.avg("char_distance").alias("ref_average"), F.count(F.lit(1)).alias("ref_n")))
    inner = first.join(_small(average), F.col(lang) == F.col("ref_lang")).where((F.col("ref_n") < TRIMMED) | (F.col("char_distance") <= F.col("ref_average") + 1e-9))
    refs = references(inner.select(*m.columns), lang)
    unnamed = m.where(F.col(lang).isNull())
    if unnamed.isEmpty():
        out = _against(m, lang, refs)
    else:
        out = _against(m.where(F.col(lang).isNotNull()), lang, refs).unionByName(_against_nearest(unnamed, refs))
    over = lambda d, limit: F.col(d) > limit[0] + limit[1] / F.sqrt("n_words")
    far = (F.col("n_words") >= GUARD) & (over("char_distance", CHAR_LIMIT) | over("word_distance", WORD_LIMIT))
    return out.drop("chars", "common").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: id, the base measures, the distances, base_failed and kept."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return judged(slim, ["id", "lang"], "text", "lang").drop("lang").withColumnRenamed("id", id)


def clean(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that are kept, as they are."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    slim = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return judged(slim, list(names.values()), names[text], names[lang]).where("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
