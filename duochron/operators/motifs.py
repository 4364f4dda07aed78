"""Position weight matrices: log-odds, exact p thresholds, scanning, enrichment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import normalize_symbol
from ..session import materialize, shipped
from .stats import bh_adjust, fisher_greater, odds_ratio

# Background, pseudocount, match p, enrichment limits, expression limits.
BACKGROUND = 0.25
PSEUDOCOUNT = 0.8
MATCH_P = 1e-4
MAX_FDR = 0.05
MIN_ODDS = 1.5
MIN_HITS = 5
MIN_TF_CPM = 2.0
MIN_TF_FRACTION = 0.02
SCORE_UNIT = 1e-3
TILE = 65_536  # letters
LIBRARY_BYTES = 64 << 20


def log_odds(pfm: np.ndarray) -> np.ndarray:
    """4 x L counts (A, C, G, T) to natural log ratios over the background."""
    p = (pfm + PSEUDOCOUNT * BACKGROUND) / (pfm.sum(0) + PSEUDOCOUNT)
    return np.log(p / BACKGROUND)


def in_units(pwm: np.ndarray) -> np.ndarray:
    """Scores rounded to SCORE_UNIT as integers: sums are exact, so a cut is exact too."""
    return np.rint(pwm / SCORE_UNIT).astype(np.int64)


def threshold(units: np.ndarray, p: float = MATCH_P) -> int:
    """Smallest attainable score whose upper tail under the background is at most p, from the
    exact score distribution, one matrix column at a time."""
    low = units.min(0)
    dist = np.ones(1)
    for col, base in zip(units.T, low):
        nxt = np.zeros(len(dist) + int(col.max() - base))
        for s in col:
            nxt[s - base : s - base + len(dist)] += BACKGROUND * dist
        dist = nxt
    tail = np.cumsum(dist[::-1])[::-1]
    ok = np.flatnonzero((tail <= p * (1 + 1e-9)) & (dist > 0))
    return int(low.sum()) + (int(ok[0]) if len(ok) else len(dist))


_CODE = np.full(256, 4, dtype=np.int64)
_CODE[[ord(c) for c in "ACGT"]] = range(4)
_NEVER = -(10**8)  # score of any letter outside A, C, G, T: such a window never matches
LETTERS_PER_PASS = 1 << 21
INDEXED = 11  # columns of the widest matrix that is found by its words: a table of 4**11 flags is 4 MB


def _tables(units: np.ndarray) -> list[np.ndarray]:
    """Score tables over letter triples: one lookup covers three matrix columns."""
    width = units.shape[1]
    padded = np.vstack([units, np.full(width, _NEVER)])
    out = []
    for j in range(0, width, 3):
        cols = [padded[:, j + i] if j + i < width else np.zeros(5, dtype=np.int64) for i in range(3)]
        out.append((cols[0][:, None, None] + cols[1][None, :, None] + cols[2][None, None, :]).ravel().astype(np.int32))
    return out


def _strand(units: np.ndarray, cut: int) -> tuple[list[tuple[int, np.ndarray, int]], int]:
    """Score tables (first column, table, most that the later tables can add) in falling order of what
    they can tell apart, and the width. A window is dropped as soon as its score and that bound miss `cut`."""
    tables = [(3 * i, t) for i, t in enumerate(_tables(units))]
    best = [int(t[t > _NEVER // 2].max()) for _, t in tables]
    spread = [b - int(t[t > _NEVER // 2].min()) for b, (_, t) in zip(best, tables)]
    order = sorted(range(len(tables)), key=lambda i: -spread[i])
    rest = sum(best)
    out = []
    for i in order:
        rest -= best[i]
        out.append((*tables[i], cut - rest))
    return out, units.shape[1]


def _match_starts(triples: np.ndarray, n: int, strand: tuple[list[tuple[int, np.ndarray, int]], int]) -> np.ndarray:
    """Start positions whose score reaches the cut, in a code of n letters."""
    tables, width = strand
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    at, table, least = tables[0]
    s = table[triples[at : at + m]]
    alive = np.flatnonzero(s >= least)
    s = s[alive].astype(np.int64)
    for at, table, least in tables[1:]:
        s += table[triples[alive + at]]
        keep = s >= least
        alive, s = alive[keep], s[keep]
    return alive


def _words(units: np.ndarray, cut: int) -> np.ndarray:
    """Words that reach the cut, as base-4 numbers: a beginning goes on while the best end can still reach it.
    A cut leaves at most the share MATCH_P of the 4**width words."""
    best = np.concatenate((np.cumsum(units.max(0)[::-1])[::-1], [0]))
    word, score = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for j in range(units.shape[1]):
        word = (word[:, None] * 4 + np.arange(4)).ravel()
        score = (score[:, None] + units[:, j]).ravel()
        keep = score + best[j + 1] >= cut
        word, score = word[keep], score[keep]
    return word.astype(np.int32)


class _Index:
    """The words of all narrow matrices by width: which strands of which motifs a word belongs to."""

    def __init__(self, motifs: list[tuple]):
        self.names = [m[0] for m in motifs]
        self.widths = {}
        for width in sorted({m[1] for m in motifs if m[1] <= INDEXED}):
            words, owners = [], []
            for i, m in enumerate(motifs):
                if m[1] == width:
                    for strand in (0, 1):
                        w = np.frombuffer(m[5 + strand], np.int32)
                        words.append(w)
                        owners.append(np.full(len(w), 2 * i + strand))
            word, owner = np.concatenate(words), np.concatenate(owners)
            order = np.argsort(word, kind="stable")
            flags = np.zeros(4**width, bool)
            flags[word] = True
            self.widths[width] = flags, word[order], owner[order]

    def hits(self, line: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, 2 * motif + strand) of the matches in a code of n letters, a width at a time."""
        known = line[:n] < 4
        code, good, done = np.zeros(n, np.int32), np.ones(n, bool), 0
        for width, (flags, words, owners) in self.widths.items():
            m = n - width + 1
            if m <= 0:
                return
            code, good = code[:m], good[:m]
            for j in range(done, width):
                code = code * 4 + (line[j : j + m] & 3).astype(np.int32)
                good = good & known[j : j + m]
            done = width
            at = np.flatnonzero(flags[code] & good)
            found = code[at]
            lo, hi = np.searchsorted(words, found, side="left"), np.searchsorted(words, found, side="right")
            size = hi - lo
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(at, size), owners[np.repeat(lo, size) + nth]


def _scan_texts(texts: list[str], own: np.ndarray, motifs: list[tuple], index: _Index) -> list[tuple]:
    """(text number, motif, forward hits, reverse hits) of several texts joined by a stop letter. A hit
    counts where it starts within the first `own` letters; the rest is the next tile's."""
    codes = [_CODE[np.frombuffer(t.upper().encode("latin-1", "replace"), dtype=np.uint8)] for t in texts]
    starts = np.cumsum([0] + [len(c) + 1 for c in codes])
    line = np.full(starts[-1] + 2, 4, dtype=np.int64)
    for at, c in zip(starts, codes):
        line[at : at + len(c)] = c
    out, n = [], int(starts[-1])
    count = np.zeros((0, 3), np.int64)
    for hits, owner in index.hits(line, n):
        text = np.searchsorted(starts, hits, side="right") - 1
        mine = hits - starts[text] < own[text]
        cell, times = np.unique(text[mine] * (2 * len(motifs)) + owner[mine], return_counts=True)
        count = np.concatenate((count, np.stack((cell // (2 * len(motifs)), cell % (2 * len(motifs)), times), 1)))
    per: dict[tuple[int, int], list[int]] = {}
    for i, owner, times in count.tolist():
        per.setdefault((i, owner >> 1), [0, 0])[owner & 1] = times
    out.extend((i, index.names[m], f, r) for (i, m), (f, r) in per.items())
    wide = [m for m in motifs if m[1] > INDEXED]
    if not wide:
        return out
    triples = line[:-2] * 25 + line[1:-1] * 5 + line[2:]
    for name, width, units, cut, rcut, *_ in wide:
        fwd = np.frombuffer(units, np.int32).reshape(4, width).astype(np.int64)
        per = []
        for strand in (_strand(fwd, cut), _strand(fwd[::-1, ::-1], rcut)):  # complement swaps A-T and C-G
            hits = _match_starts(triples, n, strand)
            text = np.searchsorted(starts, hits, side="right") - 1
            per.append(np.bincount(text[hits - starts[text] < own[text]], minlength=len(texts)))
        out.extend((int(i), name, int(per[0][i]), int(per[1][i])) for i in np.flatnonzero(per[0] + per[1]))
    return out


def _weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matrices as score units with the exact cuts of both strands, and the words that reach them if narrow."""
    for pdf in batches:
        rows = []
        for name, pfm in zip(pdf["motif_id"], pdf["pfm"]):
            fwd = in_units(log_odds(np.array([list(r) for r in pfm], float)))
            strands = [(u, threshold(u)) for u in (fwd, fwd[::-1, ::-1])]  # complement swaps A-T and C-G
            words = [_words(u, cut).tobytes() if fwd.shape[1] <= INDEXED else b"" for u, cut in strands]
            rows.append((name, fwd.shape[1], fwd.astype(np.int32).tobytes(), strands[0][1], strands[1][1], *words))
        yield pd.DataFrame(rows, columns=["motif_id", "width", "units", "cut", "rcut", "words", "rwords"])


def _by_bytes(rows: Iterable[Row], bound: int) -> Iterator[list[tuple]]:
    """Parts of the library of at most `bound` bytes of weights and words, or one motif."""
    held, size = [], 0
    for r in rows:
        n = len(r["units"]) + len(r["words"]) + len(r["rwords"]) + 200
        if held and size + n > bound:
            yield held
            held, size = [], 0
        held.append((r["motif_id"], r["width"], bytes(r["units"]), r["cut"], r["rcut"], bytes(r["words"]), bytes(r["rwords"])))
        size += n
    if held:
        yield held


def scan(sequences: DataFrame, id: str, seq: str, motifs: DataFrame, tile: int = TILE, library_bytes: int = LIBRARY_BYTES) -> DataFrame:
    """(id, motif_id, forward_hits, reverse_hits, total_hits) for ids with any hit.

    A sequence is cut into tiles that overlap by the widest matrix less one letter, and tiles are spread
    over tasks, so a sequence of any length is scanned by many; a hit belongs to the tile it starts in.
    Cuts are computed in tasks. Matrices of up to INDEXED columns are found by their words, one look-up a
    letter for all of one width. The library is sent as weights and words, in parts of at most `library_bytes`, each
    of which is one pass over the tiles. Rows with the same id add up; a NULL sequence has no hits.
    """
    spark = sequences.sparkSession
    library = materialize(shipped(motifs.select("motif_id", "pfm")).mapInPandas(_weighted, "motif_id string, width int, units binary, cut bigint, rcut bigint, words binary, rwords binary"))
    widest = library.agg(F.max("width")).first()[0] or 1
    tile = max(tile, widest)
    parts = F.regexp_extract_all(F.col("s"), F.lit(f"(?s).{{1,{tile}}}"), F.lit(0))
    cut = sequences.select(F.col(id).alias("id"), F.col(seq).alias("s")).where("s IS NOT NULL").select("id", parts.alias("p"))
    ahead = lambda i: F.coalesce(F.substring(F.get("p", i + 1), 1, widest - 1), F.lit(""))
    tiles = cut.select("id", F.posexplode(F.transform("p", lambda x, i: F.struct(F.length(x).alias("own"), F.concat(x, ahead(i)).alias("s")))).alias("tile", "t"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a stated number, for tiles cost more than their bytes
    tiles = tiles.select("id", "tile", "t.own", "t.s").repartition(tasks, "id", "tile")
    t = sequences.schema[id].dataType.simpleString()
    schema = f"id {t}, motif_id string, forward_hits bigint, reverse_hits bigint"
    parts = [spark.sparkContext.broadcast(part) for part in _by_bytes(library.toLocalIterator(), library_bytes)]
    if len(parts) > 1:
        tiles = materialize(tiles)
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.unionByName(shipped(tiles).mapInPandas(_scanner(part), schema))
    hits = found.groupBy("id", "motif_id").agg(F.sum("forward_hits").alias("forward_hits"), F.sum("reverse_hits").alias("reverse_hits"))
    return hits.withColumn("total_hits", F.col("forward_hits") + F.col("reverse_hits")).withColumnRenamed("id", id)


def _scanner(part: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(part.value)
        for pdf in batches:
            group = (pdf["s"].str.len().cumsum() // LETTERS_PER_PASS).to_numpy()
            ids, texts, own, out = pdf["id"].to_numpy(), pdf["s"].to_numpy(), pdf["own"].to_numpy(), []
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                out.extend((ids[at[i]], m, f, r) for i, m, f, r in _scan_texts(list(texts[at]), own[at], part.value, index))
            yield pd.DataFrame(out, columns=["id", "motif_id", "forward_hits", "reverse_hits"])

    return run


def universe(motifs: DataFrame, effects: DataFrame, feature: str, cpm: list[str], fraction: list[str], later: DataFrame, early: DataFrame) -> DataFrame:
    """Motif table with its gene's expression and eligibility: one named factor, known gene,
    expressed before or at the event. `later` and `early` list candidate symbols."""
    genes = effects.withColumn("symbol", normalize_symbol(F.col(feature)))
    cols = [feature, *cpm, *fraction]
    genes = genes.groupBy("symbol").agg(F.min(F.struct(*cols)).alias("_g")).select("symbol", "_g.*")
    flag = lambda d, name: d.select(normalize_symbol(F.col(feature)).alias("symbol")).distinct().withColumn(name, F.lit(True))
    m = motifs.withColumn("symbol", normalize_symbol(F.col("tf_name"))).join(genes, "symbol", "left")
    m = m.join(flag(later, "is_later_candidate"), "symbol", "left").join(flag(early, "is_early_candidate"), "symbol", "left")
    top = lambda names: F.greatest(*[F.col(c) for c in names]) if len(names) > 1 else F.col(names[0])
    expressed = F.coalesce((top(cpm) >= MIN_TF_CPM) & (top(fraction) >= MIN_TF_FRACTION), F.lit(False))
    single = ~F.contains(F.col("tf_name"), F.lit("::"))
    return m.select(
        "motif_id", "tf_name", single.alias("single_factor"), F.col(feature).isNotNull().alias("mapped"), F.col(feature).alias("mapped_symbol"), *cpm, *fraction,
        expressed.alias("expressed"), F.coalesce("is_later_candidate", F.lit(False)).alias("is_later_candidate"),
        F.coalesce("is_early_candidate", F.lit(False)).alias("is_early_candidate"), (single & F.col(feature).isNotNull() & expressed).alias("eligible"),
    )


def enrichment(presence: DataFrame, id: str, flagged: DataFrame, flag: Column, motifs: DataFrame) -> DataFrame:
    """Per motif: hits among candidates and background, odds ratio, exact one-sided p, FDR.

    `presence` lists (id, motif_id) once per hit pair; `flagged` has one row per tested id.
    """
    tested = flagged.select(id, flag.alias("_c"))
    totals = tested.agg(F.count_if(F.col("_c")).alias("candidate_n"), F.count_if(~F.col("_c")).alias("background_n"))
    hits = presence.select(id, "motif_id").distinct().join(tested, id).groupBy("motif_id").agg(
        F.count_if(F.col("_c")).alias("_a"), F.count_if(~F.col("_c")).alias("_b")
    )
    t = motifs.select("motif_id").join(hits, "motif_id", "left").crossJoin(F.broadcast(totals))  # a single row of totals
    t = t.select("motif_id", F.coalesce("_a", F.lit(0)).alias("candidate_hits"), "candidate_n", F.coalesce("_b", F.lit(0)).alias("background_hits"), "background_n")
    a, c = F.col("candidate_hits"), F.col("background_hits")
    b, d = F.col("candidate_n") - a, F.col("background_n") - c
    t = shipped(t).withColumn("odds_ratio", odds_ratio(a, b, c, d)).withColumn("fisher_p", fisher_greater(a, b, c, d))
    t = t.withColumn("candidate_fraction", a / F.col("candidate_n")).withColumn("background_fraction", c / F.col("background_n"))
    t = bh_adjust(t, "fisher_p", "motif_id", "fdr")
    return t.withColumn("enriched", F.coalesce((F.col("fdr") <= MAX_FDR) & (F.col("odds_ratio") >= MIN_ODDS) & (a >= MIN_HITS), F.lit(False)))


def diagnostics(table: DataFrame) -> DataFrame:
    """Plot-ready columns: -log10 of p and FDR (capped at the smallest double), pass flags."""
    nlog = lambda c: -F.log10(F.greatest(F.col(c), F.lit(1e-300)))
    return table.select(
        "*", nlog("fisher_p").alias("neg_log10_p"), nlog("fdr").alias("neg_log10_fdr"), (F.col("fdr") <= MAX_FDR).alias("passes_fdr"),
        (F.col("odds_ratio") >= MIN_ODDS).alias("passes_odds"), (F.col("candidate_hits") >= MIN_HITS).alias("passes_hits"),
    )
