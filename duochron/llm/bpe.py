"""BPE as a deterministic automaton over tokens, for files of the tokenizers library.

The automaton accepts exactly the token sequences that BPE makes. It starts with one state that loops on
every letter, and each merge (u, v) adds its gadget, in order: every state from which u then v can be
read gets the arc uv; reading u leads to a copy of its old state without the arc v; reading uv leads to
where v led at that time. So the state after a token depends on the token alone, the state of uv begins
as the state of v at that moment, and a merge adds one label and removes one arc. `Automaton` keeps these
versions (birth, parts, removals) instead of copying states, which would take memory with the square of
the vocabulary; `step` reads an arc from them and keeps it in a transition table.

A word's tokens are the automaton's only path that spells it: for each prefix exactly one token can come
last, so the table is walked once from left to right. Decoding writes the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_text, raw

TABLE_SIZE = 400_000  # arcs and words kept per process
CHUNKS = 1_000_000  # chunks of text with their ids, some 300 bytes each


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], most: int | None = None):
        size = max(vocab.values()) + 1
        self.most = most or TABLE_SIZE
        self.label = [""] * size
        for text, i in vocab.items():
            self.label[i] = text
        self.birth = [0] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges, 1):
            a, b, c = vocab[u], vocab[v], vocab[u + v]
            self.birth[c], self.left[c], self.right[c] = time, a, b
            self.removed[a, b] = time
        self.now = len(merges)
        self.table: dict[tuple[int, int], bool] = {}

    def arc(self, state: int, label: int, time: int) -> bool:
        """Whether the state after token `state` has the arc `label`, as of merge number `time`."""
        while True:
            gone = self.removed.get((state, label))
            if gone is not None and gone <= time:
                return False
            born, named = self.birth[state], self.birth[label]
            if born == named == 0:
                return True
            if born > named:  # the state began as its right part's, which already had or lacked the arc
                state, time = self.right[state], born - 1
            else:  # the arc came with a gadget, where its left part could be read
                label, time = self.left[label], named

    def step(self, state: int, label: int) -> bool:
        found = self.table.get((state, label))
        if found is None:
            if len(self.table) >= self.most:
                self.table.clear()
            found = self.table[state, label] = self.arc(state, label, self.now)
        return found


class Recent:
    """A table of at most `size` entries. When its younger half is full, the older half goes, and what was
    looked up meanwhile has moved to the younger one: frequent entries stay."""

    def __init__(self, size: int):
        self.half = max(1, size // 2)
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encodes and decodes with one tokenizer file whose pieces are words with an end mark. `most` bounds the
    entries of each table that grows with the text, TABLE_SIZE and CHUNKS if it is not given."""

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], most)
        self.most = most or TABLE_SIZE
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        # tree of tokens by byte: child of (node, byte), and the token at a node inside a word or at its end
        self.child: dict[int, int] = {}
        self.inner, self.last = [-1], [-1]
        self.above: list[tuple[int, int]] = [(0, 0)]
        self.width: dict[int, int] = {}
        for text, i in model["vocab"].items():
            whole = bool(self.end) and text.endswith(self.end)
            body = text[: -len(self.end)] if whole else text
            node = 0
            for c in body:
                key = node << 8 | byte_of[c]
                if key not in self.child:
                    self.child[key] = len(self.inner)
                    self.inner.append(-1)
                    self.last.append(-1)
                    self.above.append((node, byte_of[c]))
                node = self.child[key]
            (self.last if whole else self.inner)[node] = i
            self.width[i] = len(body)
        if not self.end:
            self.last = self.inner
        self.falls: dict[int, int] = {0: 0}
        self.goes: dict[int, int] = {}
        self.inner_ends: dict[int, list[tuple[int, int]]] = {}
        self.last_ends: dict[int, list[tuple[int, int]]] = {} if self.end else self.inner_ends
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer, self.byte_of = whole.normalizer, whole.pre_tokenizer, byte_of
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)
        letters_only = "".join(map(chr, range(ord("a"), ord("z") + 1)))
        self.runs = self.words.findall(letters_only) == [letters_only]  # letters make one word
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.label = dict(enumerate(self.automaton.label)) | {i: t for t, i in self.special.items()}
        self.known = Recent(self.most)
        self.chunks = Recent(most or CHUNKS)
        self.singles: dict[int, tuple[str, str, bytes]] = {}
        self.kind = "H" if max(self.label) < 1 << 16 else "I"

    def _falls(self, node: int) -> int:
        """The node of the longest proper end of a node's letters that is in the tree."""
        found = self.falls.get(node)
        if found is None:
            above, byte = self.above[node]
            found = self.falls[node] = self._goes(self._falls(above), byte) if above else 0
        return found

    def _goes(self, node: int, byte: int) -> int:
        """The node of the longest end of a node's letters and one more that is in the tree."""
        key = node << 8 | byte
        found = self.goes.get(key)
        if found is None:
            found = self.child.get(key)
            if found is None:
                found = self._goes(self._falls(node), byte) if node else 0
            if len(self.goes) >= self.most:
                self.goes.clear()
            self.goes[key] = found
        return found

    def _ending(self, node: int, tokens: list[int], known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(token, width) of `tokens` that end a node's letters, longest first."""
        out, at = [], node
        while at:
            if tokens[at] >= 0:
                out.append((tokens[at], self.width[tokens[at]]))
            at = self._falls(at)
        known[node] = out
        return out

    def word(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word. One scan gives, for every prefix, the tokens that can end it,
        longest first; the one whose arc the automaton has after its own prefix's token is the only one."""
        n, goes, ends, table, step = len(word), self.goes, self.inner_ends, self.automaton.table, self.automaton.step
        came = [-1] * (n + 1)
        node = 0
        for i, byte in enumerate(word, 1):
            now = goes.get(node << 8 | byte)
            node = self._goes(node, byte) if now is None else now
            if i == n:
                ends = self.last_ends
            candidates = ends.get(node)
            if candidates is None:
                candidates = self._ending(node, self.inner if i < n else self.last, ends)
            for t, width in candidates:
                j = i - width
                if j:
                    before = came[j]
                    if before < 0:
                        continue
                    arc = table.get((before, t))
                    if arc is None:
                        arc = step(before, t)
                    if not arc:
                        continue
                came[i] = t
                break
        if came[n] < 0:
            raise ValueError(f"no path spells {word!r}")
        out, at = [], n
        while at > 0:
            out.append(came[at])
            at -= self.width[came[at]]
        return out[::-1]

    def split(self, plain: str) -> list[bytes]:
        """Normalised text in words. Beyond Latin letters Unicode versions differ in what a letter is; the
        library that the file belongs to decides there."""
        if not plain or max(plain) < "\u0250":
            return [w.encode() for w in self.words.findall(plain)]
        return [bytes(self.byte_of[c] for c in w) for w, _ in self.pre_tokenizer.pre_tokenize_str(plain)]

    def chunk(self, text: str) -> list[int]:
        """The ids of a text: special tokens, then normalised words."""
        if self.runs and text.isascii() and text.isalpha():
            b = text.lower().encode()
            if text.islower():  # kept with its chunk
                return self.word(b)
            ids = self.known.get(b)
            if ids is None:
                ids = self.word(b)
                if len(b) <= 64:
                    self.known.put(b, ids)
            return ids
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            plain = part.lower() if part.isascii() else self.normalizer.normalize_str(part)
            for b in self.split(plain):
                ids = self.known.get(b)
                if ids is None:
                    ids = self.word(b)
                    if len(b) <= 64:
                        self.known.put(b, ids)
                out += ids
        return out

    def single(self, id: int) -> tuple[str, str, bytes]:
        if id not in self.singles:
            self.singles[id] = str(id), self.label[id], struct.pack(f"<{self.kind}", id)
        return self.singles[id]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids)

    def both(self, text: bytes) -> tuple[str, str]:
        """(decimal ids, decoded text), each joined by blanks."""
        return self.all(text)[:2]

    def all(self, text: bytes) -> tuple[str, str, bytes]:
        """(decimal ids, decoded text, little-endian ids). Nothing crosses ASCII white space, so the
        text is done by the chunks between it, and frequent chunks once."""
        chunks = text.split()
        known = self.chunks
        found = list(map(known.young.get, chunks))
        if None in found:
            for at in [i for i, got in enumerate(found) if got is None]:
                c = chunks[at]
                got = known.get(c)
                if got is None:
                    ids = self.chunk(c.decode())
                    if len(ids) == 1:
                        got = self.single(ids[0])
                    else:
                        got = (" ".join(map(str, ids)), self.decode(ids), struct.pack(f"<{len(ids)}{self.kind}", *ids))
                    if len(c) <= 64:
                        known.put(c, got)
                found[at] = got
        if not found:
            return "", "", b""
        decimals, labels, packed = zip(*found, strict=True)
        if "" in decimals:  # a chunk that normalises to nothing
            labels = [x for x, d in zip(labels, decimals, strict=True) if d]
            decimals = [d for d in decimals if d]
        return " ".join(decimals), " ".join(labels), b"".join(packed)


def codec(path: str, most: int | None = None) -> Codec:
    """One per process and file; the tables of other operators leave the process."""
    return kept(f"codec {path} {most}", lambda: Codec(path, most), alone=True)


def coded(docs: DataFrame, keep: list[str], text: str, path: str, texts: bool = True, most: int | None = None) -> DataFrame:
    """The `keep` columns of every row with n_tokens, ids (binary: two little-endian bytes each, four in
    a vocabulary over 65,536) and decoded; with texts=False with the SHA-256 of the decimal ids, joined by
    blanks, and of the decoded text instead, so that neither leaves the task.

    Null is like empty: no ids. Rows stay where they are and `keep` must not hold the added names. `path`
    must name the same file on every machine, as an installed package does. Tables of at most `most` entries
    take less of a worker's memory and more of its time; the rows are the same.
    """

    def build():
        c = codec(path, most)

        def make(column: pa.Array) -> dict[str, object]:
            n, ids, decoded = [], [], []
            for t in raw(column):
                a, b, p = c.all(t or b"")
                n.append(a.count(" ") + 1 if a else 0)
                ids.append(p if texts else hashlib.sha256(a.encode()).hexdigest())
                decoded.append(b if texts else hashlib.sha256(b.encode()).hexdigest())
            return {"n_tokens": pa.array(n, pa.int64()), names[0]: pa.array(ids, pa.binary() if texts else pa.string()), names[1]: pa.array(decoded, pa.string())}

        return make

    names = ("ids", "decoded") if texts else ("ids_sha256", "decoded_sha256")
    adds = f"n_tokens bigint, {names[0]} {'binary' if texts else 'string'}, {names[1]} string"
    return map_text(docs, keep, text, build, adds, piece=500)


def report(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return coded(slim, ["id"], "text", path, texts=False).withColumnRenamed("id", id)
