"""Token ids of a lower-casing word BPE, equal to what the ``tokenizers`` library gives for its file, but faster.

Such a tokenizer (NFC, white space to one space, lower case, split into letters, single numbers and other characters,
then merges inside a piece) never looks across ASCII white space, so a text's ids are those of its words in turn.

Plain texts, made only of ASCII white space and printable characters below U+0250, are lower-cased and cut into pieces by
Spark's own expressions (:func:`marked`), which close each piece with a marker byte; ``tiktoken`` then runs the merges:
like the library it joins the adjacent pair of the lowest rank, here over a table of ranks in which the marker closes a
word. In other texts (:meth:`WordBpe.encode`) plain words are remembered once encoded this way, and only words with other
characters, or that may hold a special string, go to the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm.shared import byte_texts

_END = "\x01"
_LINE = "\n"
#: What the library alone encodes: anything but printable characters below U+0250 (without U+0130, whose lower case is
#: two characters), or what may be a special string. In this range NFC changes nothing.
_FOREIGN = re.compile("[^\n!-~\u00a1-\u012f\u0131-\u024f]|<\\|")
_NUMBER = "\\d\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECE = re.compile(f"('s|'t|'re|'ve|'m|'ll|'d|[^\\W_{_NUMBER}]+|[{_NUMBER}]|(?:[^\\s\\w]|_)+)")
_SPACES = "\\x20\\x09-\\x0D"
#: Java's patterns. A class of what is foreign is found many times faster than the complement of what is not.
_NOT_PLAIN = "[\\x00-\\x08\\x0e-\\x1f\\x7f-\u00a0\u0130\u0250-\\x{10ffff}]"
#: In lower-cased plain text white space and letters (all from U+00C0 on but two), and pieces of anything else.
_QUIET = f"{_SPACES}a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\uffff"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_OTHER_PIECE = f"(?=[^{_QUIET}])(?:'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_QUIET}{_DIGITS}]+)"
#: Ends a document among joined ones; no plain text has this character.
_STOP = "\x02"
#: A special string that no plain text has: without any, the search for the next one stops at every character.
_NEVER = "\x03\x03"
#: Words remembered at most; beyond that the memory starts anew.
MEMORY = 250_000


def _byte_of_letter() -> dict[str, int]:
    """The library's printable stand-ins for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def marked(text: Column) -> Column:
    """A plain text in lower case with markers around all pieces but letters; null for other texts.

    Every piece is then followed by a marker or by white space.
    """
    plain = ~text.rlike(_NOT_PLAIN) & ~text.contains("<|")
    return F.when(plain, F.concat(F.regexp_replace(F.lower(text), _OTHER_PIECE, f"{_END}$0{_END}"), F.lit(" ")))


def for_words(docs: DataFrame) -> DataFrame:
    """doc_id, the marked text and, where that is null, the text itself, for :meth:`WordBpe.encode_batch`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), marked(text).alias("marked"))
    return both.select("doc_id", "marked", F.when(F.col("marked").isNull(), F.col("text")).alias("text"))


class WordBpe:
    """Encodes with the file at ``path``; keeps one memory of words for each process."""

    _held: dict[str, WordBpe] = {}

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        if model["model"]["end_of_word_suffix"] != "</w>" or model["post_processor"] is not None:
            raise ValueError(f"{path} is not a word BPE with word ends")
        letters, ends = _byte_of_letter(), (_END.encode(), b" ")
        # ranks: a last byte with either end, then single bytes, then the merges in turn, closed ones with either end
        ranks, ids = {}, np.zeros(768 + 2 * len(model["model"]["vocab"]), dtype=np.uint32)
        for b in range(256):
            ranks |= {bytes([b]) + ends[0]: b, bytes([b]) + ends[1]: 256 + b, bytes([b]): 512 + b}
        self.closes = np.zeros(len(ids), dtype=bool)
        self.closes[:512] = True
        for token, number in model["model"]["vocab"].items():
            closed = token.endswith("</w>") and len(token) > 4
            raw = bytes(letters[c] for c in (token[:-4] if closed else token))
            versions = [raw + e for e in ends] if closed else [raw]
            if len(raw) > 1:
                ranks |= {v: 768 + 2 * number + k for k, v in enumerate(versions)}
            own = [ranks[v] for v in versions]
            ids[own] = number
            self.closes[own] = closed
        self.ids = ids
        self.line = 512 + ord(_LINE)
        self.merges = tiktoken.Encoding("words", pat_str=f"[^{_END}{_SPACES}]+[{_END} ]|{_LINE}", mergeable_ranks=ranks, special_tokens={_NEVER: len(ids)})
        self.memory: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _cut(self, marked: str, closing: bool) -> list[bytes]:
        """Ids of the words that ``marked`` holds in turn, each ended by a closing token or else by a line."""
        ranks = self.merges.encode_to_numpy(marked, disallowed_special=())
        ends = np.flatnonzero(self.closes[ranks] if closing else ranks == self.line)
        flat = self.ids[ranks].tobytes()
        stops = (4 * (ends + closing)).tolist()
        starts = [0, *(stops[:-1] if closing else [s + 4 for s in stops[:-1]])]
        return [flat[a:b] for a, b in zip(starts, stops, strict=True)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        joined = b"\n".join(words).decode()
        if _FOREIGN.search(joined):
            foreign = [_FOREIGN.search(w.decode()) is not None for w in words]
            encoded = self.library.encode_batch_fast([w.decode() for w, f in zip(words, foreign, strict=True) if f], add_special_tokens=False)
            others = [w for w, f in zip(words, foreign, strict=True) if not f]
            theirs, ours = iter(encoded), iter(self._encode_words(others) if others else [])
            return [np.array(next(theirs).ids, dtype=np.uint32).tobytes() if f else next(ours) for f in foreign]
        lower = joined.lower().split(_LINE)
        letters = [x.isalpha() for x in lower]
        one = [x for x, is_one in zip(lower, letters, strict=True) if is_one]  # a single piece each
        many = [x for x, is_one in zip(lower, letters, strict=True) if not is_one]
        ones = iter(self._cut(_END.join(one) + _END, True) if one else [])
        manies = iter(self._cut(_PIECE.sub(f"\\1{_END}", _LINE.join(many)) + _LINE, False) if many else [])
        return [next(ones) if is_one else next(manies) for is_one in letters]

    def _values(self, words: list[bytes]) -> list[bytes]:
        values = list(map(self.memory.get, words))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = [words[i] for i in missing]
            found = self._encode_words(new)
            for i, value in zip(missing, found, strict=True):
                values[i] = value
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory.update(zip(new, found, strict=True))
        return values

    def encode_marked(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts prepared by :func:`marked`, as :meth:`encode` gives them; about 2 MB of texts at a time."""
        part, size = [], 0
        for k, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size > 2_000_000 or k + 1 == len(texts):
                joined = f"{_STOP}{_END}".join(part) + _STOP + _END
                for space in "\t\n\x0b\x0c\r":
                    joined = joined.replace(space, " ")
                ranks = self.merges.encode_to_numpy(joined, disallowed_special=())
                flat, at = self.ids[ranks].tobytes(), 0
                for stop in (4 * np.flatnonzero(ranks == ord(_STOP))).tolist():
                    yield flat[at:stop]
                    at = stop + 4
                part, size = [], 0

    def encode_batch(self, batch) -> Iterator[bytes]:
        """The ids of each row of an Arrow batch of :func:`for_words`, in its order."""
        prepared = batch.column("marked").to_pylist()
        ours = self.encode_marked([m for m in prepared if m is not None])
        theirs = self.encode([t or b"" for t, m in zip(byte_texts(batch.column("text")), prepared, strict=True) if m is None])
        return (next(theirs if m is None else ours) for m in prepared)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers; about 100,000 words are looked up at a time."""
        part: list[list[bytes]] = []
        size = 0
        for k, text in enumerate(texts):
            part.append(text.split())
            size += len(part[-1])
            if size > 100_000 or k + 1 == len(texts):
                values, at = self._values(list(chain.from_iterable(part))), 0
                for words in part:
                    yield b"".join(values[at : at + len(words)])
                    at += len(words)
                part, size = [], 0
