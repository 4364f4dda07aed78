"""Language of every word and text by a linear-chain conditional random field.

A word's score for a language sums weights of its features: the word itself (lexicon), prefixes and
suffixes of one to three letters (affixes), and its letter bigrams and trigrams, hashed into a table.
Learned transitions join neighbours, so that code-switched text is labelled word by word by
forward-backward. A text's language has the largest mean posterior over its words.

The field is fitted on the driver from at most `sample` documents per language (chosen by the hash of their
id, a documented bound; no language is left out), cut into sequences and mixed into code-switched ones. Every whole text is
labelled on the executors. Forward-backward over long texts runs block by block: first the transfer
matrix of every block, all blocks at once, then the messages at the block edges, then the words.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, map_text, materialize

SAMPLE = 400  # documents per language
BUCKETS = 1 << 16
SEQUENCE = 48  # words in a training sequence
SEQUENCES = 6000
STEPS, RATE, DECAY = 60, 0.05, 1e-4
BLOCK = 128  # words
KNOWN = 400_000  # words kept per process; a full table starts anew
SLICES = 256
LABELS = 200  # languages; more are refused, none is left out
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def features(word: str) -> list[int]:
    w = f"^{word}$"
    out = ["w" + word, *("p" + w[1 : 1 + k] for k in (1, 2, 3)), *("s" + w[-1 - k : -1] for k in (1, 2, 3))]
    out += [w[i : i + k] for k in (2, 3) for i in range(len(w) - k + 1)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in out]


def forward_backward(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [B, T, L] and summed pair posteriors [L, L] for sequences of equal length, from
    emission and transition factors (not logarithms)."""
    b, t, _ = e.shape
    alpha, scale = np.empty_like(e), np.empty((b, t))
    for i in range(t):
        a = (start if i == 0 else alpha[:, i - 1] @ trans) * e[:, i]
        scale[:, i] = a.sum(axis=1)
        alpha[:, i] = a / scale[:, i, None]
    beta = np.ones_like(e)
    pairs = np.zeros_like(trans)
    for i in range(t - 2, -1, -1):
        right = beta[:, i + 1] * e[:, i + 1] / scale[:, i + 1, None]
        pairs += trans * (alpha[:, i].T @ right)
        beta[:, i] = right @ trans.T
    return alpha * beta, pairs


class Field:
    """The fitted field. `langs` are its labels."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        n = len(langs)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.trans = np.full((n, n), -2.0) + np.eye(n) * 2.0
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, max(1, len(self.langs))), np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "weights": self.weights, "trans": self.trans}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    # ---------------------------------------------------------------- learning
    def fit(self, texts: list[list[str]], langs: list[str], seed: int = 5) -> Field:
        """texts: words of each document, in the language `langs` says."""
        if len(self.langs) < 2:
            return self
        r = np.random.default_rng(seed)
        types: dict[str, int] = {}
        coded = [np.array([types.setdefault(w, len(types)) for w in t], np.int64) for t in texts]
        by = [[c for c, g in zip(coded, langs, strict=True) if g == lang and len(c)] for lang in self.langs]
        seqs, truth = np.empty((SEQUENCES, SEQUENCE), np.int64), np.empty((SEQUENCES, SEQUENCE), np.int64)
        some = [i for i, docs in enumerate(by) if docs]
        for s in range(SEQUENCES):
            at = 0
            while at < SEQUENCE:
                lang = some[int(r.integers(len(some)))]
                doc = by[lang][int(r.integers(len(by[lang])))]
                k = min(SEQUENCE - at, int(r.integers(6, 2 * SEQUENCE)))
                start = int(r.integers(max(1, len(doc) - k + 1)))
                part = doc[start : start + k]
                seqs[s, at : at + len(part)] = part
                truth[s, at : at + len(part)] = lang
                at += len(part)
        used, seqs = np.unique(seqs, return_inverse=True)
        seqs = seqs.reshape(truth.shape)
        names = list(types)
        feats = [features(names[i]) for i in used]
        flat, owner = np.concatenate(feats), np.repeat(np.arange(len(feats)), list(map(len, feats)))
        norm = 1 / np.sqrt(np.array(list(map(len, feats))))
        share = norm[owner]
        n = len(self.langs)
        seen = np.zeros((n, n))
        np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        params = [self.weights.astype(float), self.trans]
        group = max(1, SEQUENCES * 20 // max(20, n))  # sequences at once: memory does not follow the labels
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            score = np.stack([np.bincount(owner, weights=params[0][flat, k] * share, minlength=len(feats)) for k in range(n)], axis=1)
            factors = np.exp(score - score.max(axis=1, keepdims=True))
            pairs, by_type = np.zeros((n, n)), np.zeros((len(feats), n))
            for at in range(0, SEQUENCES, group):
                some_seqs = seqs[at : at + group]
                post, some_pairs = forward_backward(factors[some_seqs], np.exp(params[1]), np.full(n, 1 / n))
                off = post.reshape(-1, n)
                off[np.arange(len(off)), truth[at : at + group].ravel()] -= 1
                pairs += some_pairs
                by_type += np.stack([np.bincount(some_seqs.ravel(), weights=off[:, k], minlength=len(feats)) for k in range(n)], axis=1)
            grads = [np.stack([np.bincount(flat, weights=by_type[owner, k] * share, minlength=BUCKETS) for k in range(n)], axis=1), pairs - seen]
            for i, g in enumerate(grads):
                g = g / SEQUENCES + DECAY * params[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g**2
                params[i] -= RATE * 3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
        self.weights, self.trans = params[0].astype(np.float32), params[1]
        self._reset()
        return self

    # ---------------------------------------------------------------- labelling
    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission factors of words, each scaled so that its largest is one."""
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > KNOWN:
            self._reset()
            new = set(words)
        if new:
            feats = [features(w) for w in new]
            size = np.fromiter(map(len, feats), np.int64, len(feats))
            starts = np.cumsum(size) - size
            score = np.add.reduceat(self.weights[np.concatenate(feats)], starts, axis=0) / np.sqrt(size)[:, None].astype(np.float32)
            for w in new:
                self.index[w] = len(self.index)
            self.table = np.concatenate((self.table, np.exp(score - score.max(axis=1, keepdims=True)))).astype(np.float32)
        return self.table[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def posteriors(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Posterior of each language for every word of every text; texts must have words."""
        n, trans = len(self.langs), np.exp(self.trans).astype(np.float32)
        flat = self.emissions([w for d in docs for w in d])
        sizes = np.array(list(map(len, docs)))
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        e = np.ones((total * BLOCK, n), np.float32)
        valid = np.zeros(total * BLOCK, bool)
        place = np.arange(sizes.sum()) + np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes)
        e[place], valid[place] = flat, True
        e, valid = e.reshape(total, BLOCK, n), valid.reshape(total, BLOCK)
        # what each block does to a message that enters it
        m = np.broadcast_to(np.eye(n, dtype=np.float32), (total, n, n)).copy()
        for t in range(BLOCK):
            on = valid[:, t]
            x = (m[on] @ trans) * e[on, None, t]
            m[on] = x / x.max(axis=(1, 2), keepdims=True)
        into, after = np.empty((total, n), np.float32), np.empty((total, n), np.float32)
        order = np.argsort(-blocks, kind="stable")
        longest = int(blocks.max())
        msg = np.full((len(docs), n), 1 / n, np.float32)
        for k in range(longest):
            live = order[: int((blocks > k).sum())]
            at = first[live] + k
            into[at] = msg[live]
            x = np.einsum("di,dij->dj", msg[live], m[at])
            msg[live] = x / x.sum(axis=1, keepdims=True)
        msg = np.ones((len(docs), n), np.float32)
        for k in range(longest - 1, -1, -1):
            live = order[: int((blocks > k).sum())]
            at = first[live] + k
            after[at] = msg[live]
            x = np.einsum("dij,dj->di", m[at], msg[live])
            msg[live] = x / x.sum(axis=1, keepdims=True)
        # the words inside the blocks
        alpha = np.empty_like(e)
        a = into
        for t in range(BLOCK):
            x = (a @ trans) * e[:, t]
            a = np.where(valid[:, t, None], x / x.sum(axis=1, keepdims=True), a)
            alpha[:, t] = a
        b = after
        for t in range(BLOCK - 1, -1, -1):
            alpha[:, t] *= b
            x = (b * e[:, t]) @ trans.T
            b = np.where(valid[:, t, None], x / x.sum(axis=1, keepdims=True), b)
        post = alpha.reshape(-1, n)[place]
        post /= post.sum(axis=1, keepdims=True)
        return np.split(post, np.cumsum(sizes)[:-1])


def train(docs: DataFrame, id: str, text: str, lang: str, fold: Callable[[Column], Column] | None = None, sample: int = SAMPLE) -> Field:
    """Fit on at most `sample` documents of every language, however rare.

    Rows with a null language or id, or without letters, teach nothing; with one language every text with
    letters has it; with none every text is und. More than LABELS languages are an error.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("id")) if fold else F.lit(True)))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    ids = rows.select("id", "lang", F.xxhash64("id").alias("h")).distinct()
    # first within slices of a language by hash, so that no whole language goes to one task
    for by in (["lang", F.pmod("h", F.lit(SLICES))], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where(F.col("rank") <= sample)
    ids = materialize(ids.select("id", "lang"))
    langs = sorted(r.lang for r in ids.select("lang").distinct().limit(LABELS + 1).collect())
    if len(langs) > LABELS:
        raise ValueError(f"more than {LABELS} values of {lang}")
    some = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("lang", "id").agg(F.min("text").alias("text")).collect()
    some.sort(key=lambda r: (r.lang, r.id))
    same: dict[str, str] = {}  # one object for each word
    texts = [[same.setdefault(w, w) for w in words_of(r.text)] for r in some]
    return Field(langs).fit(texts, [r.lang for r in some])


def labelled(docs: DataFrame, keep: list[str], text: str, field: Field) -> DataFrame:
    """The `keep` columns with lang_pred, score (mean posterior of that language), and runs: the words'
    own languages as (start, stop, lang) over runs of letters. Texts without letters: und, 0, no runs."""
    runs_kind = "array<struct<start:int,stop:int,lang:string>>"
    key = f"field {uuid.uuid4().hex}"
    sent = field

    def build():
        field = kept(key, lambda: sent)  # the first copy in a process, with the words it has seen

        def make(column: pa.Array) -> dict[str, object]:
            docs = [words_of(t) if field.langs else [] for t in column.to_pylist()]
            full = [d for d in docs if d]
            posts = iter(field.posteriors(full) if full else [])
            names, scores, runs = [], [], []
            for d in docs:
                if not d:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    runs.append([])
                    continue
                post = next(posts)
                mean = post.mean(axis=0, dtype=float)
                best = int(mean.argmax())
                names.append(field.langs[best])
                scores.append(min(1.0, float(mean[best])))
                own = post.argmax(axis=1)
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                runs.append([{"start": a, "stop": b, "lang": field.langs[own[a]]} for a, b in zip(cuts, cuts[1:])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "runs": pa.array(runs, kind)}

        return make

    return map_text(docs, keep, text, build, f"lang_pred string, score double, runs {runs_kind}", piece=max(1, 1000 * 400 // max(20, len(field.langs)) ** 2))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Per row: id, held_out, lang_pred, score and the number of runs. A quarter of the ids is held out."""
    fold = lambda i: F.crc32(i.cast("string")) % 4 != 2
    field = train(docs, id, text, lang, fold, sample)
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False))
    return labelled(slim, ["id"], "text", field).select(F.col("id").alias(id), held.alias("held_out"), "lang_pred", "score", F.size("runs").alias("n_runs"))
