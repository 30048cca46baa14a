"""A linear-chain conditional random field that tags toxic spans.

Labels exist per document, so tokens are labelled first: a token of a toxic document is labelled toxic
if its word, or how the word begins, is found in toxic documents far more often than chance allows.
The field is fitted to these token labels. At scoring, forward-backward marginals give every token the
probability of being toxic; the marginals of a text aggregate to its score, and runs of probable
tokens are reported with their offsets.

Chains are evaluated exactly and without a loop over tokens: all texts of a batch form one chain in
which a text's first token forgets what came before, and that chain is cut into blocks of equal
length, whose 2 x 2 transfer matrices are multiplied in step.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import labelled
from canvass.llm.common import col, remainder
from canvass.llm.quality import sigmoid

BUCKETS = 1 << 18
TOKEN = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
BLOCK = 256
#: Tokens evaluated as one chain at a time; a longer text is a chain of its own.
TOKENS = 1 << 19
#: Words whose potential a worker remembers before it starts anew.
REMEMBERED = 400_000
ACCEPT = 0.7
SPANS = "struct<score double, spans array<struct<start int, stop int, probability double>>>"


def hashes(word: str) -> list[int]:
    """Feature numbers of a word: always, the word, its beginnings."""
    names = ["", "w" + word] + [f"{k}{word[:k]}" for k in PREFIXES if len(word) >= k]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


@dataclasses.dataclass
class Field:
    """Weights of the features for the toxic state; log transitions; log start; the logistic unit of the score."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    unit: np.ndarray


def ratios(emission: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward messages of a two-state chain, as state 1 over state 0, at every token.

    ``emission`` is the factor of state 1, ``step[i, j]`` the factor of going from i to j, ``start``
    the factors at tokens marked ``first``. The first token must be marked.
    """
    n = len(emission)
    width = -(-n // BLOCK)
    e = np.ones(width * BLOCK)
    e[:n] = emission
    f = np.zeros(width * BLOCK, bool)
    f[:n] = first
    e, f = e.reshape(width, BLOCK).T.copy(), f.reshape(width, BLOCK).T.copy()
    a, b, c, d = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(BLOCK):
        m00, m10 = np.where(f[t], start[0], step[0, 0]), np.where(f[t], start[0], step[1, 0])
        m01, m11 = np.where(f[t], start[1], step[0, 1]) * e[t], np.where(f[t], start[1], step[1, 1]) * e[t]
        a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        z = a + b + c + d
        a, b, c, d = a / z, b / z, c / z, d / z
    entry, r = np.empty(width), 1.0
    for k, (p, q, s, u) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        entry[k] = r
        r = (q + u * r) / max(p + s * r, 1e-300)
    out, r = np.empty((BLOCK, width)), entry
    for t in range(BLOCK):
        up = np.where(f[t], start[1], step[0, 1] + step[1, 1] * r)
        r = np.minimum(up * e[t] / np.where(f[t], start[0], step[0, 0] + step[1, 0] * r), 1e200)
        out[t] = r
    return out.T.ravel()[:n]


def marginals(field: Field, potential: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) per token, and the forward and backward ratios."""
    emission, step = np.exp(np.clip(potential, -30, 30)), np.exp(field.transitions)
    forward = ratios(emission, first, step, np.exp(field.start))
    last = np.append(first[1:], True)
    backward = ratios(emission[::-1], last[::-1], step.T, np.ones(2))[::-1]
    odds = forward * backward / emission
    return odds / (1 + odds), forward, backward


def fit_field(words: list[list[str]], marks: list[np.ndarray], rounds: int = 45, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximise the penalised conditional likelihood of the marked tokens by adaptive gradient steps."""
    number = defaultdict(lambda: len(number))
    ids = np.array([number[w] for text in words for w in text], dtype=np.int64)
    of = [hashes(w) for w in number]
    flat, word = np.array([h for hs in of for h in hs]), np.repeat(np.arange(len(of)), [len(hs) for hs in of])
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0, *(len(t) for t in words[:-1])])] = True
    y = np.concatenate(marks).astype(float)
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.array([0.0, -2.0]), np.zeros(3))
    field.weights[hashes("")[0]] = -3.0
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    squares = [np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), np.full(2, 1e-8)]
    for _ in range(rounds):
        potential = np.bincount(word, field.weights[flat], len(of))[ids]
        p, forward, backward = marginals(field, potential, first)
        error = np.bincount(ids, p - y, len(of))
        gradient = np.bincount(flat, error[word], BUCKETS) / len(words) + ridge * field.weights
        before, after, step = forward[inner - 1], backward[inner], np.exp(field.transitions)
        pair = np.stack([np.full(len(inner), step[0, 0]), step[0, 1] * after, step[1, 0] * before, step[1, 1] * before * after])
        moved = ((pair / pair.sum(0)).sum(1).reshape(2, 2) - seen) / len(words)
        begun = np.array([0.0, (p[first] - y[first]).sum() / len(words)])
        for value, g, s in zip((field.weights, field.transitions, field.start), (gradient, moved, begun), squares, strict=True):
            s += g * g
            value -= rate * g / np.sqrt(s)
    return field


def mark(words: list[list[str]], toxic: list[int], z: float = 5.0, purity: float = 0.9) -> list[np.ndarray]:
    """Token labels from document labels; copies of a text count once."""
    unique = {hash(tuple(w)): (set(w), y) for w, y in zip(words, toxic, strict=True)}.values()
    share = sum(y for _, y in unique) / max(len(unique), 1)
    all_, bad = Counter(), Counter()
    for ws, y in unique:
        names = {n for w in ws for n in ("w" + w, *(f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k))}
        all_.update(names)
        if y:
            bad.update(names)
    signs = {n for n, k in bad.items() if k >= purity * all_[n] and k - share * all_[n] > z * np.sqrt(share * (1 - share) * all_[n])}
    hit = lambda w: "w" + w in signs or any(f"{k}{w[:k]}" in signs for k in PREFIXES if len(w) >= k)
    return [np.array([bool(y) and hit(w) for w in text], bool) for text, y in zip(words, toxic, strict=True)]


def tokens(text: str | None) -> list[str]:
    """The tokens of the text, each in lower case."""
    text = text or ""
    lower = text.lower()
    # Of equal length: every character has one for itself, so the tokens lie in the same places.
    return TOKEN.findall(lower) if len(lower) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def aggregate(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: log odds of the strongest marginal, and the log of the expected number of toxic tokens, and 1."""
    begin = np.flatnonzero(first)
    top, many = np.maximum.reduceat(p, begin), np.add.reduceat(np.where(p > 0.05, p, 0), begin)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log(many + 0.01), np.ones(len(begin))], axis=1)


def fit(texts: list[str], toxic: list[int], share: float, rounds: int = 45) -> Field:
    """Mark tokens, fit the field, then the logistic unit that turns a text's marginals into its score.

    Without texts of both labels every score is the share of toxic labels, 0.5 without labels.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    pairs = [(t, y) for t, y in ((tokens(t), y) for t, y in zip(texts, toxic, strict=True)) if t]
    if len({y for _, y in pairs}) < 2:
        return Field(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2), np.array([0, 0, np.log(share / (1 - share))]))
    words, y = [w for w, _ in pairs], np.array([y for _, y in pairs], float)
    field = fit_field(words, mark(words, [int(v) for v in y]), rounds)
    known = Scorer(field)
    x = np.concatenate([aggregate(*known.chain([w])) for w in words])
    weigh = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    for _ in range(50):  # Newton steps of a ridge-penalised logistic regression
        p = sigmoid(x @ field.unit)
        ridge = np.diag([1.0, 1.0, 0.01])
        slope = x.T @ (weigh * (p - y)) + ridge @ field.unit
        field.unit = field.unit - np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + ridge, slope)
    return field


class Scorer:
    """Scores texts and finds spans; remembers the potentials of words it has seen."""

    def __init__(self, field: Field) -> None:
        self.field, self.known = field, {}

    def potential(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = float(self.field.weights[hashes(word)].sum())
        return got

    def chain(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens, and which are first in their text; a text without tokens has one clean one."""
        look = self.potential
        values = [[look(w) for w in t] or [-30.0] for t in texts]
        first = np.zeros(sum(map(len, values)), bool)
        first[np.cumsum([0, *(len(v) for v in values[:-1])])] = True
        return marginals(self.field, np.array([x for v in values for x in v]), first)[0], first

    def __call__(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        out, group, size = [], [], 0
        for k, text in enumerate(texts):
            group.append(tokens(text))
            size += len(group[-1])
            if size < TOKENS and k + 1 < len(texts):
                continue
            p, first = self.chain(group)
            scores = sigmoid(aggregate(p, first) @ self.field.unit)
            begin = np.flatnonzero(first)
            flagged = np.add.reduceat(p > 0.5, begin) > 0
            ends = np.append(begin[1:], len(p))
            start = k + 1 - len(group)
            out += [(float(s), self.spans(texts[start + i], p[begin[i]: ends[i]]) if flagged[i] else []) for i, s in enumerate(scores)]
            group, size = [], 0
        return out

    @staticmethod
    def spans(text: str | None, p: np.ndarray) -> list[tuple[int, int, float]]:
        """Runs of tokens with P(toxic) > 0.5: first and last + 1 code point, highest probability."""
        out, before = [], -2
        at = [m.span() for m in TOKEN.finditer(text or "")]
        for i in np.flatnonzero(p > 0.5):
            if i == before + 1:
                out[-1] = (out[-1][0], at[i][1], max(out[-1][2], float(p[i])))
            else:
                out.append((*at[i], float(p[i])))
            before = i
        return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 16_384, **how) -> Field:
    """Fit on labels whose crc32(doc_id) mod 3 is not 1; the bounds are those of the sample, see ``labelled.sample``."""
    texts, y, share = labelled.sample(docs, labels, "toxic", ~remainder(F.col("doc_id"), 3, 1), per_class, max_bytes)
    return fit(texts, y, share, **how)


def tagged(docs: DataFrame, field: Field, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """The documents with a struct ``name`` of score and spans, over whole texts.

    Offsets count code points of the text. Null texts are scored as empty ones and have no spans; repeated
    rows are scored alike. A column of that name is replaced; an empty table gives an empty one.
    """
    @F.pandas_udf(SPANS)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = Scorer(field)
        for texts in batches:
            got = score(texts.tolist())
            yield pd.DataFrame({"score": [s for s, _ in got], "spans": [
                [{"start": a, "stop": b, "probability": p} for a, b, p in spans] for _, spans in got]})

    return docs.withColumn(name, tag(col(text_col)))


def classify(docs: DataFrame, field: Field) -> DataFrame:
    """One row per input row, repeated ones and null ids too: doc_id, held_out, score, predicted, spans; see ``tagged``."""
    narrow = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    return tagged(narrow, field).select(
        "doc_id", remainder(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= ACCEPT).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))
