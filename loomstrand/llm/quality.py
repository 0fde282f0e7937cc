"""Quality: a byte-level convolutional network over whole texts, in numpy.

Bytes are embedded; learned filters slide over them, chunk by chunk. Chunks
overlap by the filters' width less one step, so every place that a filter
could see in the whole text is seen. Each filter is max-pooled within a chunk;
over the chunks of a text the pooled values are averaged, their spread is
taken and their maximum, and a logistic layer makes one probability of these.

It is trained by gradient descent on a bounded sample of labelled rows, whole
texts again. Scoring uses the same forward pass, a block of chunks at a time.

Defined results: null and empty texts are scored as one blank; without labels
of both kinds every score is 0.5; a null id is kept, and is never held out;
rows that repeat are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, sample, text_of

#: Bytes embedded in DIM numbers; FILTERS of WIDTH bytes every STEP bytes; places of a chunk.
DIM, FILTERS, WIDTH, STEP, PLACES = 6, 24, 10, 2, 64
SPAN = (PLACES - 1) * STEP + WIDTH
#: Bytes by which the next chunk is further on: its first place is the one after the last.
HOP = PLACES * STEP
#: Labelled rows that are learned from, at most: good ones, poor ones; turns over them; steps at least; texts of a step.
TRAIN_ROWS, TURNS, STEPS, STEP_TEXTS = (900, 600), 6, 500, 16
#: Rows whose checksum leaves this rest are never learned from: (divisor, rest).
HELD = (5, 0)
#: Chunks of one forward pass.
PASS_CHUNKS = 1024


@dataclass
class Network:
    """embed (256, DIM), filters (WIDTH * DIM, FILTERS), bias, dense (3 * FILTERS), base."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    base: np.ndarray

    @classmethod
    def started(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(f(256, DIM, scale=0.5), f(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), f(3 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.dense, self.base]


def chunks(data: np.ndarray) -> np.ndarray:
    """(n, SPAN) bytes: the whole text in overlapping chunks, blanks after its end."""
    n = max(1, -(-max(len(data) - WIDTH + STEP, 1) // HOP))
    room = np.full((n - 1) * HOP + SPAN, 32, np.uint8)
    room[: min(len(data), len(room))] = data[: len(room)]
    return np.lib.stride_tricks.sliding_window_view(room, SPAN)[::HOP]


def patches(bytes_: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(n, PLACES, WIDTH * DIM): the embedded bytes that each place sees."""
    seen = np.ascontiguousarray(embed[bytes_])
    a, b, c = seen.strides
    return np.lib.stride_tricks.as_strided(seen, (len(seen), PLACES, WIDTH * DIM), (a, STEP * b, c))


def pooled(net: Network, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk, its place, and what was seen."""
    seen = patches(bytes_, net.embed)
    answers = (seen.reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(bytes_), PLACES, FILTERS)
    place = answers.argmax(1)
    top = np.take_along_axis(answers, place[:, None], 1)[:, 0]
    return np.tanh(np.maximum(top + net.bias, 0)), place, seen


def pooled_only(net: Network, bytes_: np.ndarray) -> np.ndarray:
    out = np.empty((len(bytes_), FILTERS), np.float32)
    for low in range(0, len(bytes_), PASS_CHUNKS):
        some = bytes_[low : low + PASS_CHUNKS]
        answers = patches(some, net.embed).reshape(-1, WIDTH * DIM) @ net.filters
        out[low : low + len(some)] = answers.reshape(len(some), PLACES, FILTERS).max(1)
    return np.tanh(np.maximum(out + net.bias, 0))


def combined(top: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and maximum over each text's chunks, side by side."""
    n = np.diff(np.append(starts, len(top)))[:, None].astype(np.float32)
    mean = np.add.reduceat(top, starts) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(top * top, starts) / n - mean * mean, 0) + 1e-4)
    most = np.maximum.reduceat(top, starts)
    return np.concatenate([mean, spread, most], 1), n, most


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability for each text."""
    out = np.empty(len(texts))
    low = 0
    while low < len(texts):
        held, high, n = [], low, 0
        while high < len(texts) and (high == low or n < PASS_CHUNKS):
            held.append(chunks(np.frombuffer(texts[high], np.uint8)))
            n += len(held[-1])
            high += 1
        starts = np.cumsum([0] + [len(x) for x in held[:-1]])
        features, _, _ = combined(pooled_only(net, np.concatenate(held)), starts)
        out[low:high] = _sigmoid(features @ net.dense + net.base)
        low = high
    return out


def _gradients(net: Network, bytes_: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    top, place, seen = pooled(net, bytes_)
    features, n, most = combined(top, starts)
    error = (weight * (_sigmoid(features @ net.dense + net.base) - y)).astype(np.float32)
    dense, base = features.T @ error, error.sum(keepdims=True)
    back = error[:, None] * net.dense[None, :]
    counts = np.diff(np.append(starts, len(top)))
    spread_out = lambda x: np.repeat(x, counts, axis=0)
    mean, spread = features[:, :FILTERS], features[:, FILTERS : 2 * FILTERS]
    grad = spread_out(back[:, :FILTERS] / n)
    grad += spread_out(back[:, FILTERS : 2 * FILTERS] / (n * spread)) * (top - spread_out(mean))
    largest = top == spread_out(most)
    grad += spread_out(back[:, 2 * FILTERS :]) * largest / spread_out(np.maximum(np.add.reduceat(largest.astype(np.float32), starts), 1))
    grad = grad * (1 - top * top) * (top > 0)
    bias = grad.sum(0)
    # only the winning place of each filter has a gradient
    won = np.take_along_axis(seen, place[:, :, None], 1)  # (n, FILTERS, WIDTH * DIM)
    filters = np.einsum("nfk,nf->kf", won, grad, optimize=True)
    into = grad[:, :, None] * net.filters.T[None]  # (n, FILTERS, WIDTH * DIM)
    at = (place * STEP)[:, :, None] + np.arange(WIDTH)
    which = bytes_[np.arange(len(bytes_))[:, None, None], at]
    embed = np.stack([np.bincount(which.ravel(), into[:, :, d::DIM].ravel(), 256) for d in range(DIM)], 1)
    return [embed, filters, bias, dense, base]


def trained(good: list[bytes], poor: list[bytes], turns: int = TURNS, seed: int = 7, rate: float = 0.01) -> Network | None:
    """The network after ``turns`` over the texts (Adam; both kinds weigh the same); None without both kinds."""
    if not good or not poor:
        return None
    per_turn = -(-(len(good) + len(poor)) // STEP_TEXTS)
    turns = max(turns, -(-STEPS // per_turn))
    net, r = Network.started(seed), np.random.default_rng(seed)
    texts = [chunks(np.frombuffer(t, np.uint8)) for t in good + poor]
    y = np.array([1.0] * len(good) + [0.0] * len(poor))
    weight = np.where(y == 1, 0.5 / len(good), 0.5 / len(poor)) * len(y)
    first, second, k = [np.zeros(p.shape) for p in net.parts()], [np.zeros(p.shape) for p in net.parts()], 0
    total = turns * per_turn
    for _ in range(turns):
        order = r.permutation(len(texts))
        for low in range(0, len(order), STEP_TEXTS):
            some = order[low : low + STEP_TEXTS]
            starts = np.cumsum([0] + [len(texts[i]) for i in some[:-1]])
            grads = _gradients(net, np.concatenate([texts[i] for i in some]), starts, y[some], weight[some])
            k += 1
            for part, grad, m, v in zip(net.parts(), grads, first, second, strict=True):
                grad = grad / len(some) + 1e-4 * part
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (rate * (1 - 0.9 * k / total) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: tuple[int, int] = TRAIN_ROWS) -> Network | None:
    good, poor = sample(docs, labels.where(~held_out(id_col, *HELD)), label, id_col, text_col, rows)
    return trained([t.encode() for t in good], [t.encode() for t in poor])


def scored(network):
    """Rows (id, text) to (id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            score = probabilities(net, texts) if net is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return run


def scores(spark: SparkSession, docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; no row is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(scored(spark.sparkContext.broadcast(network)), f"id {kind}, score double")


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    out = scores(spark, docs, train(docs, labels)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", *HELD).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
