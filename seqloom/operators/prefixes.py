"""The trie of reversed sequences, counted without building it.

In sorted order a string adds the nodes beyond what it has in common with the one before it, and a node gains a child
wherever two neighbours part at its depth. So distinct strings are dealt by range and sorted, a task folds its share in one
pass with a stack as deep as a string, and leaves one summary. Nodes on the paths of its first and last string, which other
tasks may share, stay open in it; one task closes them. No prefix is ever a row.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import ship_package

#: Bytes compared at a time.
_BLOCK = 1 << 22


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax())


def _neighbours(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bases that each string but the first has in common with the one before."""
    out = [np.zeros(0, np.int64)]
    width = int(lengths.max(initial=0))
    rows = max(1, _BLOCK // max(1, width))
    at = np.arange(width)
    for k in range(0, len(starts) - 1, rows):
        own = slice(k, k + rows + 1)
        inside = at < lengths[own, None]
        text = np.where(inside, data[np.minimum(starts[own, None] + at, max(0, len(data) - 1))] if len(data) else 0, 0)
        differ = (text[1:] != text[:-1]) | ~inside[1:] | ~inside[:-1]
        out.append(np.where(differ.any(axis=1), differ.argmax(axis=1) if width else 0, width))
    return np.concatenate(out)


def _add(to: dict, more: dict) -> None:
    for k, n in more.items():
        to[k] = to.get(k, 0) + n


class _Share:
    """One task's strings, in order. ``open`` maps a prefix to [partings, whether it is a string, depths right below]."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.strings = 0
        self.begun, self.ended = Counter(), Counter()  # nodes by the first and last depth that a string adds
        self.leaves, self.nodes, self.runs = Counter(), Counter(), Counter()  # nodes: by depth and children, where strings part
        self.open: dict[bytes, list] = {}
        self.lone = False  # whether the first string is a leaf of which more is to be said than its depth
        self._stack: list[tuple[int, list, bool]] = []
        self._least = None

    def add(self, strings: pa.Array) -> None:
        if not len(strings):
            return
        strings = strings.cast(pa.large_binary())
        offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
        held = strings.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        head = strings[0].as_py()
        if self.first is None:
            self.first, self.strings = head, 1
            common = _neighbours(data, offsets[:-1], lengths)
            before, own = lengths[:-1], lengths[1:]
        else:
            common = np.concatenate([[_common(self.last, head)], _neighbours(data, offsets[:-1], lengths)])
            before, own = np.concatenate([[len(self.last)], lengths[:-1]]), lengths
        self.last = strings[-1].as_py()
        new = (common != before) | (common != own)
        common, before, own = common[new], before[new], own[new]
        self.strings += len(common)
        for to, values in ((self.begun, common + 1), (self.ended, own), (self.leaves, before[common != before])):
            _add(to, {int(k): int(n) for k, n in zip(*np.unique(values, return_counts=True), strict=True)})
        self._fold(common.tolist(), before.tolist())

    def _fold(self, common: list[int], before: list[int]) -> None:
        stack, least = self._stack, self._least
        for depth, length in zip(common, before, strict=True):
            below = {} if depth == length else {length: 1}
            if least is None and below:  # what is right above the first string, only the merge knows
                self.leaves[length] -= 1
                self.lone, below = True, {}
            while stack and stack[-1][0] > depth:
                at, node, shared = stack.pop()
                _add(node[2], below)
                if shared:
                    self.open[self.first[:at]] = node
                    below = {}
                else:
                    below = self._close(at, node)
            if stack and stack[-1][0] == depth:
                node = stack[-1][1]
                node[0] += 1
                _add(node[2], below)
            else:
                stack.append((depth, [1, depth == length, below], least is None or depth <= least))
            if least is None or depth < least:
                least = depth
        self._least = least

    def _close(self, depth: int, node: list) -> dict:
        """Count a node; the depths that are then right below its parent, or below none."""
        partings, whole, below = node
        children = partings + (not whole)
        self.nodes[depth, children] += 1
        if children < 2:
            return below
        for k, n in below.items():
            self.runs[k - depth - 1] += n
        return {depth: 1}

    def summary(self) -> bytes:
        self.open.update((self.last[:at], node) for at, node, _ in self._stack)
        return pickle.dumps((self.first, self.last, self.lone, self.strings, self.begun, self.ended, self.leaves, self.nodes, self.runs, self.open))


def _merged(summaries: list[bytes]) -> _Share:
    """All shares as one, with every node closed."""
    out, ends = _Share(), []
    for first, last, lone, strings, begun, ended, leaves, nodes, runs, still in sorted((pickle.loads(x) for x in summaries), key=lambda x: x[:2]):
        for to, more in ((out.begun, begun), (out.ended, ended), (out.leaves, leaves), (out.nodes, nodes), (out.runs, runs)):
            _add(to, more)
        for prefix, (partings, whole, below) in still.items():
            node = out.open.setdefault(prefix, [0, False, {}])
            node[0], node[1] = node[0] + partings, node[1] or whole
            _add(node[2], below)
        out.strings += strings
        ends += [first] * lone
        depth = 0
        if out.last is None:
            out.first = first
        elif out.last == first:
            out.strings -= 1
            out.last = last
            continue
        else:
            depth = _common(out.last, first)
            node = out.open.setdefault(first[:depth], [0, False, {}])
            node[0], node[1] = node[0] + 1, node[1] or depth == len(out.last)
            if depth != len(out.last):
                ends.append(out.last)
        out.begun[depth + 1] += 1
        out.ended[len(first)] += 1
        out.last = last
    if out.last is not None:
        ends.append(out.last)
    out.leaves.update(len(x) for x in ends)
    leaves, path = set(ends), []

    def close() -> None:
        prefix = path.pop()
        below = {len(prefix): 1} if prefix in leaves else out._close(len(prefix), out.open[prefix])
        if path:
            _add(out.open[path[-1]][2], below)
        else:
            _add(out.runs, below)  # no branch above: the run reaches the root

    for prefix in sorted(leaves | out.open.keys()):  # a prefix comes right before what it begins
        while path and not prefix.startswith(path[-1]):
            close()
        path.append(prefix)
    while path:
        close()
    return out


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    share = _Share()
    for batch in batches:
        share.add(batch.column(0))
    if share.first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([share.summary()], pa.binary())], ["summary"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    summaries = [x for batch in batches for x in batch.column(0).to_pylist()]
    if not summaries:
        return
    all_of = _merged(summaries)
    rows = [("strings", 0, 0, all_of.strings - (all_of.first == b""))]  # the empty one is the root
    rows += [("runs", k, 0, n) for k, n in all_of.runs.items()]
    children = Counter(all_of.nodes)
    children.update({(k, 0): n for k, n in all_of.leaves.items()})
    parted = Counter()
    for (depth, _), n in children.items():
        parted[depth] += n
    here = 0
    for depth in range(max(all_of.ended) + 1):
        here += all_of.begun[depth] - all_of.ended[depth - 1] if depth else 0
        there = here if depth else 1
        children[depth, 1] += there - parted[depth]
        rows.append(("nodes", depth, 0, there))
    rows += [("children", *k, n) for k, n in children.items() if n]
    kind, a, b, n = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x, pa.int64()) for x in (a, b, n))], ["kind", "a", "b", "n"])


def trie(sequences: DataFrame) -> DataFrame:
    """kind, a, b, n: ``strings`` (n of them), ``nodes`` (a: depth), ``children`` (a: depth, b: children) and ``runs``
    (a: one-child nodes right above a leaf or branch) of the trie of ``sequences.s`` reversed; no row for no sequence."""
    ship_package(sequences.sparkSession)
    back = sequences.where("s is not null").select(F.reverse("s").alias("back"))
    summaries = back.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(_summaries, "summary binary")
    return summaries.repartition(1).mapInArrow(_rows, "kind string, a long, b long, n long")
