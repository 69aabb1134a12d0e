"""Secret scans: keyword automaton, anchored expressions only where it hits, checksums of what carries one.

Kinds, in this order: ``assign`` (a name such as password or api_key, then : or =, then 12 or more characters),
``access`` (AKIA and 18 or more in all), ``hex`` (16 or more lower-case hex digits), and, found only with a valid
checksum, ``github`` (gh[pousr]_, 30 base-62 characters and the CRC-32 of them in six base-62 digits), ``npm`` (npm_ in
the same way), ``age`` (AGE-SECRET-KEY-1 with its Bech32 checksum) and ``card`` (a payment card's number: an issuer's
prefix and length, plain or in groups of four, with its Luhn digit). Matches of a kind are leftmost and do not overlap.

An Aho-Corasick automaton finds all keywords in one pass, and an expression is tried only at a hit. Runs of hex digits
have no keyword; every eighth place of the text is looked up instead, and a run of 16 covers two such places in a row.
Texts are scanned as one byte a code point (others than Latin-1 become ``?``, which no expression accepts), so places
are code points. Null texts are empty and have no spans; repeated rows are scanned each; an empty table gives no rows. A row costs memory in
proportion to its own text only.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "github", "npm", "age", "card")
BASE = KINDS[:3]
#: Names before an assignment; prefixes of keys.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
GITHUB = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
AGE = "AGE-SECRET-KEY-1"
#: First digits of card numbers and how many digits those have.
CARDS = {"4": (13, 16, 19), **dict.fromkeys(("51", "52", "53", "54", "55"), (16,)), "34": (15,), "37": (15,), "6011": (16,), "65": (16,)}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_CRC_TOKEN = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_AGE = re.compile(rb"AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58}(?![0-9A-Z])")
_CARD = re.compile(rb"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![0-9A-Za-z])")
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_github long, n_npm long, n_age long, n_card long"


def automaton() -> ahocorasick.Automaton:
    """Of lower-cased keywords, each with its kind; the expressions then mind the case."""
    found = ahocorasick.Automaton()
    for kind, words in (("assign", NAMES), ("access", ("AKIA",)), ("github", GITHUB), ("npm", ("npm_",)), ("age", (AGE,)), ("card", CARDS)):
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def base62_crc(body: bytes) -> bytes:
    """The CRC-32 of ``body`` as six base-62 digits."""
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.encode()


def bech32_valid(text: str) -> bool:
    """Whether the last six characters are the checksum of the rest."""
    prefix, _, data = text.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.find(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for k, step in enumerate(_BECH32_STEPS):
            if top >> k & 1:
                check ^= step
    return min(values) >= 0 and check == 1


def luhn_valid(digits: str) -> bool:
    """Whether the last digit makes the sum of all, every second from the right doubled and cast out by nine, end in 0."""
    doubled = sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def _card(number: str) -> bool:
    return any(number.startswith(first) and len(number) in lengths for first, lengths in CARDS.items()) and luhn_valid(number)


def _hex_runs(flat: bytes) -> list[tuple[int, int]]:
    """Maximal runs of 16 or more hex digits."""
    probes = _IS_HEX[np.frombuffer(flat, dtype=np.uint8)[::8]]
    out, beyond = [], 0
    for p in (8 * np.flatnonzero(probes[1:] & probes[:-1])).tolist():
        if p < beyond:
            continue
        start = p
        while start > beyond and _IS_HEX[flat[start - 1]]:
            start -= 1
        beyond = _HEX.match(flat, start).end()
        if beyond - start >= 16:
            out.append((start, beyond))
    return out


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 12
    if kind == "access":
        return len(match[0]) >= 18
    if kind == "age":
        return bech32_valid(match[0].decode())
    if kind == "card":
        return _card(match[0].decode().replace(" ", "").replace("-", ""))
    return base62_crc(match[1]) == match[2]


_PATTERNS = {"assign": _ASSIGN, "access": _ACCESS, "github": _CRC_TOKEN, "npm": _CRC_TOKEN, "age": _AGE, "card": _CARD}


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of all secrets in ``text``, in code points, sorted."""
    flat = text.encode("latin-1", "replace")
    found = [(a, b, 2) for a, b in _hex_runs(flat)]
    beyond = dict.fromkeys(KINDS, 0)
    hits = sorted({(end + 1 - n, kind) for end, (kind, n) in words.iter(flat.lower().decode("latin-1"))})
    for at, kind in hits:
        if at < beyond[kind]:
            continue
        match = _PATTERNS[kind].match(flat, at)
        if match is None:
            continue
        beyond[kind] = match.end()
        if _valid(kind, match):
            found.append((at, match.end(), KINDS.index(kind)))
    return sorted(found, key=lambda s: (s[0], s[2]))


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scanned(batches):
    words = automaton()
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            spans = scan(text or "", words)
            n = [sum(k == kind for _, _, k in spans) for kind in range(len(KINDS))]
            base = render([s for s in spans if s[2] < len(BASE)])
            rows.append((doc, *n[:3], hashlib.sha256(base.encode()).hexdigest(), render(spans), *n[3:]))
        columns = list(zip(*rows, strict=True)) or [[]] * 10
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 4
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_github", "n_npm", "n_age", "n_card"]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, counts, base_sha256 and spans (``kind:start:end``). Other columns are not read."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scanned, SCHEMA)
