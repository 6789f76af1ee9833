"""Quality probability of documents from a byte-level convolutional network in numpy.

Every filter looks at WIDTH neighbouring bytes through a table of learned byte vectors. Its responses are
max-pooled over overlapping chunks that cover the whole text (STEP positions, chunks of two steps), the
pooled values of all chunks are averaged, and a logistic unit turns them into one probability.

Training: at most TRAIN_ROWS labelled documents, those of smallest doc_id hash, with all chunks of their whole
texts, so a document is trained on the mean that it is scored by. Only the rows are bounded. Scoring reads
whole texts in one pass without a shuffle. Null and empty texts get the score of an empty chunk; equal
texts get equal scores; without labels of both kinds every score is the labels' mean, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_of, pieces, sampled, texts_of, utf8

WIDTH, STEP, FILTERS = 4, 128, 16
TRAIN_ROWS, EPOCHS = 4000, 12


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS: what a byte adds at each place of a filter
    bias: np.ndarray
    weight: np.ndarray
    shift: float

    def pairs(self) -> np.ndarray:
        """The taps of two neighbouring places as tables over byte pairs."""
        return np.stack([(self.taps[j][:, None, :] + self.taps[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)])

    def score(self, data: np.ndarray, off: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """One probability for each text data[off[i]:off[i + 1]]."""
        steps = np.maximum(1, -(-np.diff(off) // STEP))
        at = np.concatenate([[0], np.cumsum(steps)])
        # An empty step after each text, so that its last places don't reach into the next one.
        begin = np.concatenate([[0], np.cumsum(steps + 1)])
        wide = np.zeros(begin[-1] * STEP + WIDTH, np.int64)
        wide[np.arange(len(data)) + np.repeat(begin[:-1] * STEP - off[:-1], np.diff(off))] = data
        pair = wide[:-1] * 256 + wide[1:]
        top = np.empty((begin[-1], FILTERS), np.float32)
        for a in range(0, begin[-1], 256):  # so that responses stay in the cache
            b = min(begin[-1], a + 256)
            own = pairs[0][pair[a * STEP : b * STEP]] + pairs[1][pair[a * STEP + 2 : b * STEP + 2]]
            top[a:b] = own.reshape(b - a, STEP, FILTERS).max(1)
        top = np.delete(top, begin[1:] - 1, 0)
        last = np.zeros(at[-1], bool)
        last[at[1:] - 1] = True
        chunk = np.where(last[:, None], top, np.maximum(top, np.roll(top, -1, 0)))
        # A text of several steps has a chunk from each but the last; one of a single step has that one.
        use = ~last | np.repeat(steps == 1, steps)
        mean = np.add.reduceat(np.maximum(chunk + self.bias, 0) * use[:, None], at[:-1], 0) / np.maximum(1, steps - 1)[:, None]
        return 1 / (1 + np.exp(-np.clip(mean.astype(np.float64) @ self.weight + self.shift, -30, 30)))


def _steps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All steps of the texts with the bytes that filters at their last places reach, and where each text's begin."""
    at = np.concatenate([[0], np.cumsum([max(1, -(-len(t) // STEP)) for t in texts])])
    wide = np.zeros((at[-1], STEP + WIDTH - 1), np.uint8)
    for i, t in enumerate(texts):
        own = np.zeros((at[i + 1] - at[i]) * STEP + WIDTH - 1, np.uint8)
        own[: len(t)] = np.frombuffer(t, np.uint8)
        wide[at[i] : at[i + 1]] = np.lib.stride_tricks.sliding_window_view(own, STEP + WIDTH - 1)[::STEP]
    return wide, at


def _pooled(x: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter in each step and its place."""
    top, best = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for a in range(0, len(x), 64):  # so that responses stay in the cache
        c = x[a : a + 64]
        r = taps[0][c[:, :STEP]]
        for j in range(1, WIDTH):
            r += taps[j][c[:, j : j + STEP]]
        r = np.ascontiguousarray(r.transpose(0, 2, 1))
        best[a : a + 64] = r.argmax(2)
        top[a : a + 64] = np.take_along_axis(r, best[a : a + 64, :, None], 2)[..., 0]
    return top, best


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss; classes weigh alike half-way (square root of their ratio)."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS), 0.0)
    rate = float(np.mean(labels)) if len(labels) else 0.5
    if rate in (0.0, 1.0) or not len(labels):
        return Network(net.taps * 0, net.bias, net.weight * 0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    cost = np.where(labels == 1, 1.0, np.sqrt(rate / (1 - rate)))
    x, begin = _steps(texts)
    f = np.arange(FILTERS)
    state = {k: [np.zeros_like(v, dtype=np.float64), np.zeros_like(v, dtype=np.float64)] for k, v in (("taps", net.taps), ("bias", net.bias), ("weight", net.weight), ("shift", np.zeros(1)))}
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 64):
            docs = order[a : a + 64]
            t += 1
            idx = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            steps = begin[docs + 1] - begin[docs]
            own, best = _pooled(x[idx], net.taps)
            # A text of several steps has a chunk from each but the last; one of a single step has that one.
            last = np.zeros(len(idx), bool)
            last[np.cumsum(steps) - 1] = True
            first = np.flatnonzero(~last | np.repeat(steps == 1, steps))
            second = first + ~last[first]
            n = np.maximum(1, steps - 1)
            at = np.where(own[second] > own[first], second[:, None], first[:, None])  # the step that wins each chunk
            top = own[at, f] + net.bias
            seg = np.concatenate([[0], np.cumsum(n)[:-1]])
            mean = np.add.reduceat(np.maximum(top, 0), seg, 0) / n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.weight + net.shift, -30, 30)))
            g = (p - labels[docs]) * cost[docs] / len(docs)
            back = np.repeat(g[:, None] * net.weight / n[:, None], n, 0) * (top > 0)
            taps = np.zeros_like(net.taps)
            for j in range(WIDTH):
                cell = x[idx[at], best[at, f] + j].astype(np.int64) * FILTERS + f
                taps[j] = np.bincount(cell.ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            for k, d in (("taps", taps), ("bias", back.sum(0)), ("weight", mean.T @ g + 1e-4 * net.weight), ("shift", np.array([g.sum()]))):
                m, v = state[k]
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, float(net.shift - step[0]) if k == "shift" else (getattr(net, k) - step).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality") -> Network:
    """A network from at most TRAIN_ROWS labelled documents for which `learnable` (of doc_id) holds; of a repeated doc_id the least text and label."""
    chosen = sampled(labels.where(learnable & F.col(label).isNotNull()), TRAIN_ROWS, label)
    rows = texts_of(docs, chosen).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r[label]))
    return train([(r.text or "").encode() for r in rows], np.array([r[label] for r in rows], np.float64))


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """`keep` columns, which may hold the text, and the score, a double called name, which must not be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for b in pieces(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(net.score(*utf8(b), pairs), pa.float64())], [*keep, name])

    source = docs.select(*dict.fromkeys((*keep, "text")))
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + f", `{name}` double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; rows of crc32 remainder 1 of 3 are never learned from."""
    net = fit(docs, labels, bucket_of(F.col("doc_id"), 3) != 1)
    out = score(docs, net)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
