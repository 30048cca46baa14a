"""Open answers: batches, enrichment by a user function, joining results back by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.ranking import number_rows
from canvass.session import materialize


def batches(df: DataFrame, by: list[str], order: list[str], k: int, name: str = "batch") -> DataFrame:
    """Number batches of k answers within each source, in the given order."""
    numbered = number_rows(df, by, order, "_row")
    return numbered.withColumn(name, F.ceil(F.col("_row") / k)).drop("_row")


def enrich_text(df: DataFrame, key: str, col: str, fn: Callable[[list[str]], list[str]], batch: int = 5) -> DataFrame:
    """Send answers to ``fn`` in batches; returns key, text, result and error.

    If a batch fails, its answers are sent one by one, so the failing answer alone carries the error
    and no answer is lost. The result does not depend on how Spark splits the rows. ``fn`` runs in
    the executors, where it may call a service at its own pace.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return fn([text])[0], None
        except Exception as problem:  # noqa: BLE001 - any failure of the user function is recorded
            return None, str(problem)

    def several(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            results = fn(texts)
        except Exception:  # noqa: BLE001
            return [one(t) for t in texts]
        if len(results) != len(texts):
            return [one(t) for t in texts]
        return [(r, None) for r in results]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[col].tolist()
            answers = [a for i in range(0, len(texts), batch) for a in several(texts[i:i + batch])]
            yield pd.DataFrame({
                key: frame[key], col: frame[col],
                "result": pd.Series([a[0] for a in answers], index=frame.index, dtype=object),
                "error": pd.Series([a[1] for a in answers], index=frame.index, dtype=object)})

    schema = df.select(key, col).schema.add("result", "string").add("error", "string")
    return df.where(F.col(col).isNotNull()).select(key, col).mapInPandas(run, schema)


LEDGER = "digest string, result string, error string, attempts int"


class Pace:
    """Tokens of one task: ``rate`` a second, ``burst`` of them at most kept; a rate of 0 is no limit."""

    def __init__(self, rate: float, burst: int) -> None:
        self.rate, self.burst, self.tokens, self.at = rate, burst, float(burst), time.monotonic()

    def take(self) -> None:
        if not self.rate:
            return
        now = time.monotonic()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            time.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, time.monotonic()
        self.tokens -= 1


def enrich_resumable(df: DataFrame, key: str, col: str, fn: Callable[[list[str]], list[str]], ledger: str, batch: int = 5,
                     rate: float = 0.0, burst: int = 1, attempts: int = 3, parts: int = 16) -> DataFrame:
    """As :func:`enrich_text`, but every distinct text is sent once, at a pace, and a stopped run goes on where it was.

    Results are appended to the table ``ledger`` (a folder), keyed by the text's digest, after each of ``parts``
    parts of the texts. A run sends what the ledger has no result for, except texts that have failed ``attempts``
    times. In a task calls wait for a token: ``rate`` a second, ``burst`` at once; a failing batch is sent again one
    by one, and a failing text up to ``attempts`` times. Null texts are not sent and get no row.
    """
    def pending(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(rate, burst)

        def call(texts: list[str]) -> list[str]:
            pace.take()
            results = fn(texts)
            if len(results) != len(texts):
                raise ValueError(f"{len(results)} results for {len(texts)} texts")
            return results

        def one(text: str, tried: int) -> tuple[str | None, str | None, int]:
            while True:
                tried += 1
                try:
                    return call([text])[0], None, tried
                except Exception as problem:  # noqa: BLE001 - any failure of the user function is recorded
                    if tried >= attempts:
                        return None, str(problem), tried

        for frame in frames:
            texts, tried, out = frame["text"].tolist(), frame["tried"].tolist(), []
            for i in range(0, len(texts), batch):
                part = texts[i: i + batch]
                try:
                    out += [(r, None, t + 1) for r, t in zip(call(part), tried[i: i + batch], strict=True)]
                except Exception:  # noqa: BLE001
                    out += [one(t, n) for t, n in zip(part, tried[i: i + batch], strict=True)]
            yield pd.DataFrame(out, columns=["result", "error", "attempts"]).assign(digest=frame["digest"].tolist())[["digest", "result", "error", "attempts"]]

    spark = df.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    digest = F.sha2(F.col(col), 256)
    texts = materialize(df.where(F.col(col).isNotNull()).groupBy(digest.alias("digest")).agg(F.first(col).alias("text")), "texts")
    for part in range(parts):
        known = spark.read.schema(LEDGER).parquet(ledger).groupBy("digest").agg(F.max("attempts").alias("tried"), F.bool_or(F.col("error").isNull()).alias("done"))
        rest = texts.where(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part).join(known, "digest", "left").where(
            "NOT coalesce(done, false)").select("digest", "text", F.coalesce("tried", F.lit(0)).alias("tried")).where(F.col("tried") < attempts)
        rest.mapInPandas(pending, LEDGER).write.mode("append").parquet(ledger)
    # A later success stands; else the last failure.
    last = F.max(F.struct(F.col("error").isNull().alias("done"), "attempts", "result", "error"))
    found = spark.read.schema(LEDGER).parquet(ledger).groupBy("digest").agg(last.alias("l")).select(F.col("digest").alias("_digest"), "l.result", "l.error")
    sent = df.where(F.col(col).isNotNull()).select(key, col)
    return sent.join(found, digest == F.col("_digest"), "left").drop("_digest")


def attach_by_id(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Attach results to respondents by key; respondents without a result stay."""
    return df.join(other, key, "left")
