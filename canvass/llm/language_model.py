"""Cross-entropy difference between a target and a background model of word bigrams.

Both models share one vocabulary: all words of the corpus. Words that only the target has are one
unknown word; no text of the corpus holds them. Every bigram keeps its own discounted probability, and
the mass taken from it goes to the single words, so each model is a distribution over the vocabulary.
``word_share`` and ``pair_share`` make rarer words unknown and let rarer bigrams go to the single
words; they are 0 unless the caller asks for less.

Counts of words and bigrams are written tables, which grow with the corpus. The bigrams that make up at
least ``OFTEN`` of it, no more than 1 / OFTEN, travel to the tasks and are scored where a text is read;
all others are looked up by joins. That split decides where a bigram is scored, not how. Sums are of
whole 1 / ``UNIT`` of a bit, so they do not depend on the order of tasks.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col
from canvass.session import materialize

DISCOUNT, OFTEN, UNIT = 0.75, 4e-6, 1 << 30
#: Entries that a task counts before it passes them on.
HELD = 1 << 19
# No word holds white space. The word before the first one of a text is empty.
UNKNOWN, BETWEEN = "\n", "\n"
MODELS = ("target", "background")


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def bigrams(ws: list[bytes]) -> Iterator[bytes]:
    """Each word with the one before it and a space between them."""
    return map(b" ".join, zip([b"", *ws], ws, strict=False))


def tally(docs: DataFrame, entries, name: str, text_col: str) -> DataFrame:
    """Occurrences of the entries of all texts, summed by task."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter()
        for batch in batches:
            for text in batch.iloc[:, 0]:
                seen.update(entries(text))
                if len(seen) >= HELD:
                    yield pd.DataFrame({name: list(seen), "n": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({name: list(seen), "n": list(seen.values())})

    return docs.select(col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(count, f"{name} binary, n long")


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences of every word of all texts."""
    return tally(docs, words, "word", text_col).groupBy("word").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences of every bigram in the target and in the background."""
    zero, pair = F.lit(0).cast("long"), F.col("pair").cast("string").alias("pair")
    of = lambda df: tally(df, lambda text: bigrams(words(text)), "pair", text_col)
    both = of(docs).select(pair, zero.alias("target"), F.col("n").alias("background")).unionAll(
        of(target).select(pair, F.col("n").alias("target"), zero.alias("background")))
    return both.groupBy("pair").agg(*[F.sum(m).alias(m) for m in MODELS])


def pieces(texts: list, characters: int = 1 << 25) -> Iterator[list]:
    """Runs of texts of bounded size; a longer text is a run of its own."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield texts[at: k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def halves(pairs: DataFrame) -> DataFrame:
    """The bigrams with their two words."""
    return pairs.withColumns({"before": F.substring_index("pair", " ", 1), "now": F.substring_index("pair", " ", -1)})


@dataclasses.dataclass
class Difference:
    """Both models as tables: ``pairs`` has the occurrences of each bigram of the vocabulary; ``words`` has for each
    word per model how often it is followed, the mass left to single words after it, and its probability as a single
    word. ``absent`` has these for words outside the vocabulary; ``least`` are the occurrences of which a bigram is kept."""

    pairs: DataFrame
    words: DataFrame
    absent: dict[str, float]
    least: dict[str, float]
    total: int

    def bits(self, pairs: DataFrame) -> DataFrame:
        """-log2 P in 1 / UNIT of a bit of each of the bigrams, under both models."""
        side = lambda s: self.words.select(*[F.col(c).alias(f"{s}_{c}") for c in self.words.columns])
        placed = halves(pairs.select("pair")).join(side("b"), F.col("before") == F.col("b_word"), "left").join(
            side("w"), F.col("now") == F.col("w_word"), "left")
        # The empty word is one of the words unless there are no texts at all.
        code = F.concat(F.coalesce("b_word", F.lit(UNKNOWN)), F.lit(" "), F.coalesce("w_word", F.lit(UNKNOWN)))
        counted = self.pairs.select(F.col("pair").alias("_pair"), *MODELS)
        placed = placed.withColumn("_code", code).join(counted, F.col("_code") == F.col("_pair"), "left")

        def of(m: str):
            n = F.coalesce(m, F.lit(0))
            follows, left = (F.coalesce(f"b_{c}_{m}", F.lit(self.absent[f"{c}_{m}"])) for c in ("follows", "left"))
            single = F.coalesce(f"w_single_{m}", F.lit(self.absent[f"single_{m}"]))
            own = F.when((n > 0) & (n >= F.lit(self.least[m])), (n - DISCOUNT) / follows).otherwise(0.0)
            return F.round(-F.log2(own + left * single) * UNIT).cast("long").alias(m)

        return placed.select("pair", *[of(m) for m in MODELS])


def train(docs: DataFrame, target: DataFrame, word_share: float = 0.0, pair_share: float = 0.0) -> Difference:
    """Count words and bigrams of all documents and all target texts; null texts count as empty."""
    # Written down: totals and tables are several reads of the same counts.
    counted = materialize(count_words(docs).select(F.col("word").cast("string").alias("word"), "n"), "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    known = counted.where(F.col("n") >= F.lit(max(total * word_share, 1))).select("word")
    size = known.count() + 1

    raw = materialize(count_pairs(docs, target), "bigrams")
    # Without a share all words of the background are known: only bigrams that it lacks may hold others.
    whole, some = (raw.where("background > 0"), raw.where("background = 0")) if not word_share else (raw.limit(0), raw)
    placed = halves(some).join(known.toDF("b"), F.col("before") == F.col("b"), "left").join(
        known.toDF("w"), F.col("now") == F.col("w"), "left")
    before = F.when(F.col("before") == "", "").otherwise(F.coalesce("b", F.lit(UNKNOWN)))
    code = F.concat(before, F.lit(" "), F.coalesce("w", F.lit(UNKNOWN)))
    pairs = whole.unionAll(materialize(placed.groupBy(code.alias("pair")).agg(*[F.sum(m).alias(m) for m in MODELS]), "pairs"))
    totals = pairs.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MODELS]).first().asDict()
    least = {m: totals[m] * pair_share for m in MODELS}

    # Discounted counts are whole quarters, so their sums are exact.
    kept = lambda m: F.when((F.col(m) > 0) & (F.col(m) >= F.lit(least[m])), F.col(m) - DISCOUNT).otherwise(0.0)
    none, split = F.lit(0).cast("long"), halves(pairs)
    follows = split.select(F.col("before").alias("word"), *[e for m in MODELS for e in (
        F.col(m).alias(f"f_{m}"), kept(m).alias(f"k_{m}"), none.alias(f"n_{m}"))])
    occurs = split.select(F.col("now").alias("word"), *[e for m in MODELS for e in (
        none.alias(f"f_{m}"), F.lit(0.0).alias(f"k_{m}"), F.col(m).alias(f"n_{m}"))])
    single = lambda m, n: (n + 0.5) / F.lit(totals[m] + 0.5 * size)
    table = follows.unionAll(occurs).groupBy("word").agg(*[F.sum(f"{c}_{m}").alias(f"{c}_{m}") for m in MODELS for c in "fkn"])
    table = materialize(table.select("word", *[e for m in MODELS for e in (
        F.col(f"f_{m}").alias(f"follows_{m}"),
        F.when(F.col(f"f_{m}") > 0, 1 - F.col(f"k_{m}") / F.col(f"f_{m}")).otherwise(1.0).alias(f"left_{m}"),
        single(m, F.col(f"n_{m}")).alias(f"single_{m}"))]), "models")
    absent = {k: v for m in MODELS for k, v in ((f"follows_{m}", 0), (f"left_{m}", 1.0), (f"single_{m}", 0.5 / (totals[m] + 0.5 * size)))}
    unknown = table.where(F.col("word") == UNKNOWN).drop("word").first()
    return Difference(pairs, table, unknown.asDict() if unknown else absent, least, totals["background"])


def scored(docs: DataFrame, difference: Difference) -> DataFrame:
    """One row per document: doc_id, n_words, target_bits and background_bits per word, and their difference.

    The lower the difference, the more the text is like the target. A text without words has nulls.
    """
    often = difference.bits(difference.pairs.where(F.col("background") >= F.lit(max(difference.total * OFTEN, 1)))).toPandas()
    number = {p.encode(): i for i, p in enumerate(often["pair"])}
    value = often[list(MODELS)].to_numpy(np.int64).reshape(-1, 2)

    @F.pandas_udf("struct<n_words long, target long, background long, rest binary>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                ws = words(text)
                found, rest = [], []
                for p in bigrams(ws):
                    i = number.get(p)
                    if i is None:
                        rest.append(p)
                    else:
                        found.append(i)
                t, b = value[found].sum(axis=0).tolist() if found else (0, 0)
                rows.append((len(ws), t, b, BETWEEN.encode().join(rest) if rest else None))
            yield pd.DataFrame(rows, columns=["n_words", *MODELS, "rest"])

    read = docs.select(col("doc_id").alias("doc_id"), score(col("text")).alias("of"))
    # Written down: ids may repeat or be null, so rows are told apart by a number that must not change.
    read = materialize(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "of.*"), "texts")
    rest = read.where("rest IS NOT NULL").select("row", F.explode(F.split(F.col("rest").cast("string"), BETWEEN)).alias("pair"))
    seldom = rest.join(difference.bits(rest.select("pair").distinct()), "pair")
    null = F.lit(None).cast(read.schema["doc_id"].dataType)
    parts = read.select("row", "doc_id", "n_words", *MODELS).unionAll(
        seldom.select("row", null.alias("doc_id"), F.lit(0).cast("long").alias("n_words"), *MODELS))
    out = parts.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", *MODELS)])
    per = lambda m: F.when(F.col("n_words") > 0, F.col(m) / F.lit(float(UNIT)) / F.col("n_words")).alias(f"{m}_bits")
    return out.select("doc_id", "n_words", *[per(m) for m in MODELS]).withColumn(
        "difference", F.col("target_bits") - F.col("background_bits"))
