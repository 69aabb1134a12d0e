"""Document quality by a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the UTF-8 bytes of a document, in chunks of ``CHUNK`` places that overlap by the
filters' width and cover it whole. A filter's response is max-pooled in each chunk, passed through a rectifier and
averaged over the chunks; a logistic unit combines the responses into one probability. On bytes a filter is a table of
256 weights for each of its places, so a convolution is ``WIDTH`` look-ups and sums, and the gradient of a maximum touches
only the bytes at its place.

Training: labelled documents outside the held-out fold, at most ``ROWS`` of them (those of least hash of doc_id; all,
where there are fewer), each by its whole text, exactly as it is scored. Nothing but the text is an input. The fit is
seeded and independent of the partitioning; it runs on the driver, which holds those documents' texts and nothing else,
and the weights (about 80 kB) travel with the scoring function. Without any labelled row the score is 0.5 everywhere.

Null texts are empty; texts shorter than a filter are padded with zero bytes. Repeated rows are scored alike; of rows and
labels with one doc_id the least quality and then the least text is learned, once. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import byte_texts

WIDTH, FILTERS, CHUNK = 5, 16, 512
ROWS = 6000
STEPS, BATCH = 300, 48
#: Chunks whose responses are held at once.
BLOCK = 128
RATE, DECAY, SEED = 0.02, 1e-4, 7
THRESHOLD = 0.7


class Network:
    """tables[k, byte, filter], bias[filter], weights[filter], offset."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = (np.where(np.arange(FILTERS) % 2, 0.3, -0.3)).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.weights, self.offset]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each place of an array of bytes."""
        n = len(data) - WIDTH + 1
        out = np.take(self.tables[0], data[:n], axis=0, mode="clip")
        for k in range(1, WIDTH):
            out += np.take(self.tables[k], data[k : n + k], axis=0, mode="clip")
        return out

    def pooled(self, text: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest response of each filter in each chunk of the whole text and, if asked for, where it is."""
        data = _bytes(text)
        n = len(data) - WIDTH + 1
        tops, at = [], []
        for start in range(0, n, BLOCK * CHUNK):
            part = self.responses(data[start : start + BLOCK * CHUNK + WIDTH - 1])
            tops.append(np.maximum.reduceat(part, np.arange(0, len(part), CHUNK), axis=0))
            if places:
                whole = len(part) // CHUNK
                best = part[: whole * CHUNK].reshape(whole, CHUNK, FILTERS).argmax(axis=1)
                if whole * CHUNK < len(part):
                    best = np.concatenate([best, part[whole * CHUNK :].argmax(axis=0)[None]])
                at.append(best + start + CHUNK * np.arange(len(best))[:, None])
        return np.concatenate(tops), np.concatenate(at) if places else None

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features * self.weights).sum(axis=-1) + self.offset[0], -30, 30)))

    def score(self, text: bytes) -> float:
        """The probability of quality 1 from the whole text."""
        return float(self.probability(np.maximum(self.pooled(text)[0] + self.bias, 0).mean(axis=0, dtype=np.float64)))

    def gradient(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean logistic loss of whole texts, for each of the parameters."""
        out = [np.zeros_like(p) for p in self.parameters()]
        for text, y, w in zip(texts, labels.tolist(), weight.tolist(), strict=True):
            tops, at = self.pooled(text, places=True)
            raised = tops + self.bias
            features = np.maximum(raised, 0).mean(axis=0)
            g = (float(self.probability(features)) - y) * w / len(texts)
            each = (g * self.weights / len(tops)) * (raised > 0)  # chunks, filters
            data, filters = _bytes(text), np.broadcast_to(np.arange(FILTERS), at.shape)
            for k in range(WIDTH):
                np.add.at(out[0][k], (data[at + k], filters), each)
            out[1] += each.sum(axis=0)
            out[2] += (g * features).astype(np.float32)
            out[3] += np.float32(g)
        return out


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.ljust(WIDTH, b"\0"), dtype=np.uint8)


def train(rows: list[tuple[bytes, int]], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to (text, label) by Adam on the logistic loss of whole texts."""
    net = Network(seed)
    if not rows:
        net.weights[:] = 0
        return net
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], dtype=np.float32)
    by_class = [np.flatnonzero(labels == y) for y in (0, 1)]
    rate = float(labels.mean())
    if rate in (0.0, 1.0):
        net.weights[:] = 0
        net.offset[:] = 3 if rate else -3
        return net
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        # half of each class, weighted back to their shares, so that scores stay probabilities
        drawn = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
        y = labels[drawn]
        grads = net.gradient([rows[i][0] for i in drawn], y, np.where(y > 0, rate, 1 - rate) * 2)
        lr = RATE * (1 - step / (steps + 1))
        for parameter, grad, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            grad = grad + DECAY * parameter
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            parameter -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of doc_id as text, modulo 4, is 2 (a null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Network:
    """Train on at most ``rows`` labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` narrow rows
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    # one row a document, folded where it lies: a doc_id that repeats does not reach the driver twice
    found = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "quality", F.encode("text", "UTF-8").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return train([(bytes(r["text"]), r["quality"]) for r in found])


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs``: doc_id, held_out, score, predicted. Other columns are not read."""
    net = fit(docs, labels, rows)

    def scored(batches):
        for batch in batches:
            scores = [net.score(t) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
