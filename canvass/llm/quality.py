"""A byte-level convolutional network that scores the quality of texts.

Filters ``WIDTH`` bytes wide slide over every byte of the text. Their strongest answer is pooled within
each of the overlapping chunks that cover the whole text; the mean and the maximum of the chunks go
into one logistic unit. Being pooled, a text of any length has the same number of features, and long
ones are scored in pieces of bounded size.

The network is small and fitted on a bounded sample on the driver; scoring runs on Arrow batches.
For scoring the filters are tabulated over byte pairs, so a position costs WIDTH / 2 additions of rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import labelled
from canvass.llm.common import col, free, remainder

WIDTH, FILTERS = 6, 16
SEGMENT = 64        # bytes pooled first
CHUNK, HOP = 4, 3   # segments of a chunk, and between the starts of two chunks
PIECE = 1 << 12     # segments that are convolved at a time
ACCEPT = 0.7


@dataclasses.dataclass
class Network:
    """``filters``: WIDTH x 256 x FILTERS; ``bias`` of the filters; the logistic unit."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def tables(self) -> list[np.ndarray]:
        """Filter answers to the byte pairs at offsets 0, 2, 4, …; a pair's number is first + 256 * second."""
        f = self.filters
        return [(f[j + 1][:, None] + f[j][None]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with each text on whole segments, followed by zero bytes; segments per text."""
    segments = np.array([-(-(len(t) + WIDTH) // SEGMENT) for t in texts], dtype=np.int64)
    buffer = np.frombuffer(b"".join(t.ljust(n * SEGMENT, b"\0") for t, n in zip(texts, segments, strict=True)) + bytes(WIDTH), np.uint8)
    return buffer, segments


def convolve(buffer: np.ndarray, tables: list[np.ndarray], last: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Strongest answer of each filter in each segment, and its position if wanted.

    At the end of a ``last`` segment windows would reach into the next text; the one before them, which
    sees the zero bytes only, stands for them.
    """
    n = len(buffer) - WIDTH
    pairs = buffer[:-1].astype(np.uint16) | (buffer[1:].astype(np.uint16) << 8)
    answers = tables[0][pairs[:n]]
    for k, t in enumerate(tables[1:], 1):
        answers += t[pairs[2 * k: 2 * k + n]]
    answers = answers.reshape(-1, SEGMENT, FILTERS)
    answers[last, SEGMENT - WIDTH + 1:] = answers[last, SEGMENT - WIDTH][:, None]
    return answers.max(axis=1), answers.argmax(axis=1) if where else None


def chunks_of(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of each chunk (the last one repeated at the end of a text), chunks per text, first chunk per text."""
    count = np.maximum(1, -(-(segments - 1) // HOP))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    begin = np.concatenate([[0], np.cumsum(segments)[:-1]])
    text = np.repeat(np.arange(len(segments)), count)
    start = begin[text] + HOP * (np.arange(len(text)) - first[text])
    last = (begin + segments - 1)[text]
    return np.minimum(start[:, None] + np.arange(CHUNK), last[:, None]), count, first


def pool(peaks: np.ndarray, segments: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean and maximum over a text's chunks of their strongest answers."""
    index, count, first = chunks_of(segments)
    chunk = np.maximum(peaks[index].max(axis=1) + bias, 0)
    return np.hstack([np.add.reduceat(chunk, first) / count[:, None], np.maximum.reduceat(chunk, first)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], labels: list[int], share: float, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 0) -> Network:
    """Fit on a sample; errors are weighed so that label 1 has its share among all labels.

    Without texts of both labels the network answers with that share, 0.5 if there are no labels.
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    y = np.array(labels, dtype=float)
    share = min(max(share, 1e-3), 1 - 1e-3)
    net.offset = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return net
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    net.weights = rng.normal(0, 0.1, 2 * FILTERS)
    raw = [t.encode() for t in texts]
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("filters", net.filters), ("bias", net.bias), ("weights", net.weights))}
    state["offset"] = [0.0, 0.0]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(raw), batch):
            pick = order[at: at + batch]
            buffer, segments = lay_out([raw[i] for i in pick])
            peaks, places = convolve(buffer, net.tables(), np.cumsum(segments) - 1, where=True)
            index, count, first = chunks_of(segments)
            of_chunk = peaks[index]
            strongest = of_chunk.argmax(axis=1)
            chunk = np.maximum(of_chunk.max(axis=1) + net.bias, 0)
            top = np.maximum.reduceat(chunk, first)
            features = np.hstack([np.add.reduceat(chunk, first) / count[:, None], top])
            error = (sigmoid(features @ net.weights + net.offset) - y[pick]) * weigh[pick] / len(pick)
            text = np.repeat(np.arange(len(pick)), count)
            back = (error / count)[text][:, None] * net.weights[:FILTERS] + (chunk == top[text]) * error[text][:, None] * net.weights[FILTERS:]
            back *= chunk > 0
            segment = np.take_along_axis(index, strongest, axis=1)
            filters = np.broadcast_to(np.arange(FILTERS), segment.shape)
            position = segment * SEGMENT + places[segment, filters]
            gradient = np.stack([
                np.bincount((buffer[position + j].astype(np.int64) * FILTERS + filters).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                for j in range(WIDTH)])
            step += 1
            speed = rate * (0.5 if epoch >= epochs - 2 else 1)
            for k, g in (("filters", gradient + 1e-5 * net.filters), ("bias", back.sum(0)), ("weights", features.T @ error + 1e-4 * net.weights), ("offset", error.sum())):
                m, v = state[k] = [0.9 * state[k][0] + 0.1 * g, 0.999 * state[k][1] + 0.001 * g * g]
                setattr(net, k, getattr(net, k) - speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    return net


def probabilities(net: Network, texts: list[str | None], tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 per whole text; a null text counts as empty."""
    tables = tables or net.tables()
    out, group, size = [], [], 0

    def flush() -> None:
        buffer, segments = lay_out(group)
        last, peaks = np.cumsum(segments) - 1, []
        for k in range(0, int(last[-1]) + 1, PIECE):
            ends = last[np.searchsorted(last, k): np.searchsorted(last, k + PIECE)] - k
            peaks.append(convolve(buffer[k * SEGMENT: (k + PIECE) * SEGMENT + WIDTH], tables, ends)[0])
        peaks = np.concatenate(peaks)
        out.append(sigmoid(pool(peaks, segments, net.bias) @ net.weights + net.offset))

    for t in texts:
        group.append((t or "").encode())
        size += len(group[-1])
        if size >= PIECE * SEGMENT:
            flush()
            group, size = [], 0
    if group:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 65_536, **how) -> Network:
    """Fit on labels whose crc32(doc_id) mod 4 is not 2; the bounds are those of the sample, see ``labelled.sample``."""
    texts, y, share = labelled.sample(docs, labels, "quality", ~remainder(F.col("doc_id"), 4, 2), per_class, max_bytes)
    return fit(texts, y, share, **how)


def scored(docs: DataFrame, net: Network, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with the probability of label 1 in the column ``name``; only the text is read for it.

    A column of that name is replaced. Null texts are scored as empty ones.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = net.tables()
        for texts in batches:
            yield pd.Series(probabilities(net, texts.tolist(), tables))

    return docs.withColumn(name, score(col(text_col)))


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """One row per input row, repeated ones and null ids too: doc_id, held_out, score, predicted. An empty table gives an empty one."""
    narrow = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    return scored(narrow, net).select(
        "doc_id", remainder(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """The documents that the network does not reject, with their columns; all, if it was not fitted on both labels.

    Null texts are scored as empty ones; repeated rows and null ids are rows like others. An empty table
    gives an empty one.
    """
    if not net.weights.any():
        return docs
    name = free(docs, "_quality")
    return scored(docs, net, name=name).where(F.col(name) >= ACCEPT).drop(name)
