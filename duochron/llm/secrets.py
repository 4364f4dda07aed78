"""Secret scans: patterns for candidates, then structural confirmation by decoding them.

Base kinds come from three patterns. The method looks at every maximal run of base64 (also url-safe, also
wrapped over lines, also with escaped line ends) or hex letters of sufficient length, decodes it and reports it only if the bytes have the structure of a secret: a key in
DER (nested tags whose lengths add up to the end, with a key's version, object identifier or integers),
an OpenSSH key, or a signed token whose header is JSON with an algorithm. Every span is in code points of
the original text, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

# The base patterns and the least length of what they must match.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "key", "ssh", "jwt")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_HINTS = ("passw", "secret", "token", "api")  # every assignment has one of these, in either case
# Every pattern gives back nothing it has taken ("+" after a repeat) where it could try again, and begins
# at few places, so that a scan takes time in proportion to the text.
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)(?=-----)")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}+={0,2}")
_END = r"[ \t]*+(?:\r|\n|\\++[nr])(?:[ \t\r\n]|\\++[nr])*+"  # one line end or more, with blanks
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}(?:" + _END + r"[A-Za-z0-9+/_-]++={0,2})*+")
_LINE = re.compile(r"(?:\\++[nr])|([A-Za-z0-9+/_-]++)={0,2}")
_SOFT = re.compile(r"(?<!\\)\\++[nr]|\\(?=/)|\s")  # what may stand between the letters of armour
_MOST_FIELDS = 32  # of an OpenSSH key; certificates have some fifteen
_MOST_BYTES = 1 << 17  # of a key wrapped over lines without armour: one of 16,384 bits has under 10,000
_HEADER = re.compile(r"(?:^|(?<=[\n\r])|(?<=\\[nr]))[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\n\r\\]*")
_SEALED = re.compile(r"DEK-Info:\s*[A-Z0-9-]+\s*,\s*[0-9A-Fa-f]{16,}")
_PKCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # encryption by password
_HEXES = re.compile(r"[0-9A-Fa-f]{48,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")


def der(data: bytes, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """The nested elements of DER bytes as (tag, content, children), if all lengths add up exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
            if size < 0x80:
                return None  # the short form was due
        if at + size > len(data):
            return None
        content, at = data[at : at + size], at + size
        children: list = []
        if tag & 0x20:
            if depth > 12:
                return None
            inner = der(content, depth + 1)
            if inner is None:
                return None
            children = inner
        out.append((tag, content, children))
    return out


def is_key(data: bytes) -> bool:
    """A private or public key: one DER sequence that has what such keys have."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    tree = der(data)
    if tree is None or len(tree) != 1:
        return False
    parts = tree[0][2]
    tags = [t for t, _, _ in parts]
    whole = tags[:1] == [0x02] and len(parts[0][1]) == 1  # a version
    if whole and len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True  # version, modulus, exponents, primes
    if whole and tags[1:3] == [0x30, 0x04] and parts[1][2] and parts[1][2][0][0] == 0x06:
        return True  # version, algorithm, wrapped key
    if whole and tags[1:2] == [0x04] and len(parts[1][1]) in (20, 24, 28, 32, 48, 66):
        return True  # version, scalar of a curve
    if tags == [0x30, 0x04] and [t for t, _, _ in parts[0][2]] == [0x06, 0x30] and parts[0][2][0][1].startswith(_PKCS):
        return True  # cipher with its parameters, encrypted key
    return tags == [0x30, 0x03] and bool(parts[0][2]) and parts[0][2][0][0] == 0x06  # algorithm, public bits


def is_ssh(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = 0, 0
    while at + 4 <= len(data) and fields < _MOST_FIELDS:
        size = int.from_bytes(data[at : at + 4], "big")
        if size > len(data) - at - 4:
            return False
        if not fields and not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", data[4 : 4 + size]):
            return False
        fields, at = fields + 1, at + 4 + size
    return fields >= 2 and at == len(data)


def _unpadded(text: str, url: bool = False) -> bytes | None:
    body = text.rstrip("=")
    if url:
        body = body.replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def is_signed_token(text: str) -> bool:
    """Header and claims are JSON objects, the header names an algorithm, the signature has its length."""
    head, claims, sign = text.split(".")
    try:
        h = json.loads(_unpadded(head, True) or b"")
        c = json.loads(_unpadded(claims, True) or b"")
    except (ValueError, RecursionError):
        return False
    if not (isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(c, dict)):
        return False
    size = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}.get(h["alg"])
    got = _unpadded(sign, True)
    return got is not None and (len(got) == size if size else h["alg"] == "none" or len(got) >= 128)


def _kind_of(data: bytes | None) -> str | None:
    if not data:
        return None
    return "key" if is_key(data) else "ssh" if is_ssh(data) else None


def _armoured_kind(body: str) -> str | None:
    """Of what stands between the two lines of PEM armour."""
    data = _unpadded(_SOFT.sub("", _HEADER.sub("", body)), True)
    if _SEALED.search(body):
        return "key" if data and len(data) >= 24 and len(data) % 8 == 0 else None  # whole cipher blocks
    return _kind_of(data)


def _der_size(head: bytes) -> int:
    """Bytes of the key that may begin so, by its own length; else 0."""
    if len(head) < 6 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] >= 0x80 else 0
    if more > 3 or head[1] == 0x80 or head[2 + more] not in (0x02, 0x30):
        return 0
    return 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])


class Letters:
    """The bytes of base64 letters from one place on, decoded no further than they are asked for."""

    def __init__(self, whole: str, begin: int):
        self.whole, self.begin = whole, begin
        self.size = (len(whole) - begin) // 4 * 3

    def bytes(self, at: int, n: int) -> bytes:
        first = self.begin + at // 3 * 4
        return (_unpadded(self.whole[first : first + -(-(at % 3 + n) // 3) * 4], True) or b"")[at % 3 : at % 3 + n]

    def number(self, at: int) -> int:
        return int.from_bytes(self.bytes(at, 4), "big")


def _ssh_sizes(data: Letters) -> list[int]:
    """Sizes at which an OpenSSH key that begins so can end."""
    if data.bytes(0, 15) == b"openssh-key-v1\0":
        at, left = 15, 3  # cipher, derivation, its options; then the number of keys
        while left and at + 4 <= data.size:
            at, left = at + 4 + data.number(at), left - 1
        if left or at + 4 > data.size:
            return []
        at, left = at + 4, data.number(at) + 1
        if left > _MOST_FIELDS:
            return []
        while left and at + 4 <= data.size:
            at, left = at + 4 + data.number(at), left - 1
        return [] if left else [at]
    first = data.number(0)
    if not 4 <= first <= 64 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", data.bytes(4, first)):
        return []
    out, at = [], 0
    while at + 4 <= data.size and len(out) < _MOST_FIELDS:
        at += 4 + data.number(at)
        if at > data.size:
            break
        out.append(at)
    return out[1:]


def _may_be_der(data: Letters, size: int) -> bool:
    """Whether the sizes of the outermost parts, sixteen at most, add up to `size`."""
    at, parts = 2 + (data.bytes(1, 1)[0] & 0x7F if data.bytes(1, 1)[0] >= 0x80 else 0), 0
    while at < size and parts < 16:
        head = data.bytes(at, 6)
        more = head[1] & 0x7F if len(head) == 6 and head[1] >= 0x80 else 0
        if len(head) < min(6, size - at) or len(head) < 2 or more > 4:
            return False
        at, parts = at + 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1]), parts + 1
    return at == size


def _wrapped(text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
    """Keys in consecutive lines of base64: each begins with a line, and its own length says at the end of
    which line it must end."""
    lines = [(m.start(), m.end(), m[1]) for m in _LINE.finditer(text, start, stop) if m[1]]
    ends = list(accumulate(len(t) for _, _, t in lines))
    whole, out, i = "".join(t for _, _, t in lines), [], 0
    while i < len(lines):
        begin = ends[i] - len(lines[i][2])
        sizes: list[int] = []
        if whole[begin] == "M":
            size = _der_size(_unpadded(whole[begin : begin + 8], True) or b"")
            sizes = [size] if size <= _MOST_BYTES else []
        elif whole.startswith(("AAAA", "b3BlbnNzaC1rZXktdjEA"), begin):
            sizes = _ssh_sizes(Letters(whole, begin))
        found = None
        for size in sorted(set(sizes), reverse=True):
            letters = -(-4 * size // 3)
            j = bisect_left(ends, begin + letters)
            if not size or j >= len(lines) or ends[j] != begin + letters or whole[begin] == "M" and not _may_be_der(Letters(whole, begin), size):
                continue
            if kind := _kind_of(_unpadded(whole[begin : begin + letters], True)):
                found = j, kind
                break
        if found:
            out.append((lines[i][0], lines[found[0]][1], _ORDER[found[1]]))
            i = found[0]
        i += 1
    return out


def _armours(text: str) -> list[tuple[int, int, int, int]]:
    """(start, body's start, body's end, end) of armour: each end line with the last such begin line since
    the armour before it."""
    out: list[tuple[int, int, int, int]] = []
    begun: dict[str, tuple[int, int]] = {}
    for m in _ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begun[m[2]] = m.start(), m.end() + 5
        elif m[2] in begun and m.start() >= begun[m[2]][1]:
            out.append((*begun[m[2]], m.start(), m.end() + 5))
            begun = {}
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the three base patterns."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of candidates whose decoded bytes have a secret's structure."""
    out, first, last = [], [], []  # and the places of armour, in order
    if "-----BEGIN " in text:
        for a, b, c, d in _armours(text):
            kind = _armoured_kind(text[b:c])
            if kind:
                out.append((a, d, _ORDER[kind]))
                first.append(a)
                last.append(d)

    def in_armour(a: int, b: int) -> bool:
        k = bisect_right(first, a) - 1
        return k >= 0 and b <= last[k]

    for m in _WRAPPED.finditer(text):
        out += [s for s in _wrapped(text, *m.span()) if not in_armour(s[0], s[1])]
    for pattern, decode in ((_BASE64, _unpadded), (_HEXES, lambda h: bytes.fromhex(h) if len(h) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            kind = _kind_of(decode(m[0]))
            if kind and not in_armour(*m.span()):
                out.append((m.start(), m.end(), _ORDER[kind]))
    if "eyJ" in text:
        out += [(m.start(), m.end(), _ORDER["jwt"]) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(set(out), key=lambda s: (s[0], s[2]))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    more = confirmed_spans(text)
    return base, sorted({*base, *more}, key=lambda s: (s[0], s[2])) if more else base


def spans(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The `keep` columns with `base` and `spans`: arrays of (kind, start, stop). Null is like empty;
    every row gives one row; `keep` must not hold the added names."""

    def build():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

        def make(column: pa.Array) -> dict[str, object]:
            got = [scan_text(t) for t in column.to_pylist()]
            as_dicts = lambda s: [{"kind": KINDS[k], "start": a, "stop": b} for a, b, k in s]
            return {"base": pa.array([as_dicts(g[0]) for g in got], kind), "spans": pa.array([as_dicts(g[1]) for g in got], kind)}

        return make

    array = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return map_text(docs, keep, text, build, f"base {array}, spans {array}")


def _listed(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    found = spans(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), ["id"], "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(F.col("id").alias(id), *(count(k) for k in KINDS[:3]), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every secret of its text replaced by [kind]; overlapping secrets by the first's kind.

    Texts without a secret, other columns and the number of rows stay as they are.
    """
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def build():
        def make(column: pa.Array) -> dict[str, object]:
            out = []
            for t in column.to_pylist():
                found = scan_text(t)[1]
                if found:
                    parts, done = [], 0
                    for a, b, k in found:
                        if a >= done:
                            parts += [t[done:a], f"[{KINDS[k]}]"]
                        done = max(done, b)
                    t = "".join(parts) + t[done:]
                out.append(t)
            return {"masked": pa.array(out, pa.string())}

        return make

    kept = [n for n in names if n != names[at]]
    out = map_text(docs.toDF(*names), kept, names[at], build, "masked string")
    return out.select(*(F.col("masked" if i == at else n).alias(c) for i, (n, c) in enumerate(zip(names, docs.columns, strict=True))))
