"""Cross-entropy difference of a corpus's own documents, counted and scored in one shuffle.

The models are those of ``language_model`` without shares: the background is counted on the documents that are
scored, every word and bigram of them counts, and words that only the target has are one unknown word.

1. Words are counted with their text and get 63-bit keys, hashes under a seed for which no two words of the corpus
   agree (checked; other seeds are tried), frequent ones their rank. The words and bigrams that make up at least ``OFTEN`` of the corpus, no more
   than 1 / ``OFTEN`` each, travel to the tasks. A bigram that is not among these makes up less than 2 ``OFTEN``.
2. Every other bigram goes with its row and its times to the bucket of its word before if that is seldom, else to that
   of its word now if that is seldom, else to one of the bigram; the counts of seldom words go to their buckets. So a bucket
   sees all occurrences of its bigrams, all followers of its seldom words before and the counts of its seldom words after
   frequent ones. It is written as one row of packed arrays, with its sums for the frequent words before.
3. These sums are added up (1 / ``OFTEN`` words), and each bucket is scored where it lies. Only bigrams of two seldom
   words, which lie with the first, lack something, the count of the second: they go packed to the block of the second.
4. What a bucket has summed by document goes to the documents' blocks, one packed row per bucket and block.

Buckets have ``ENTRIES`` entries on average however large the corpus is, and blocks ``BLOCK`` times as many. A document has a sum in every
bucket that holds one of its bigrams, so sums are no more than bigrams; they travel in packed arrays. Rows between tasks are one per bucket and
piece of text or block, so beyond some 10^10 words these rows get small and the shuffles take several times the bytes per entry. Sums are of
whole 1 / ``UNIT`` of a bit, so they do not depend on the order of tasks.
"""

from __future__ import annotations

import itertools
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm import language_model
from canvass.llm.common import col
from canvass.llm.language_model import DISCOUNT, HELD, MODELS, UNIT, bigrams, tally, words
from canvass.session import materialize

OFTEN, ENTRIES, BLOCK, SEEDS = 4e-6, 1 << 21, 4, 100
#: Kinds of rows between tasks.
DOC, HOT, BUCKET, BEFORE, BOTH, WORDS = range(6)
#: In place of a document's row: bigrams of the target.
TARGET = -1
#: Bytes of the texts, and words of the table, that a task takes at a time.
PIECE, TAKEN = 1 << 23, 1 << 20
#: ASCII white space by byte, and the bytes with A-Z in lower case.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class Numbers:
    """Codes of words: the rank of a frequent word, -1 - h for others, where h is its key by ``number``."""

    def __init__(self, seed: int, ranks: dict[int, int] | None = None):
        self.seed = xxhash.xxh64_intdigest(struct.pack("<q", seed), 42)
        keys, at = (np.fromiter(of, np.int64, len(ranks or {})) for of in ((ranks or {}).keys(), (ranks or {}).values()))
        order = np.argsort(keys)
        self.often, self.rank = keys[order], at[order]

    def key(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word, self.seed) >> 1

    def coded(self, keys: np.ndarray) -> np.ndarray:
        at = place(self.often, keys)
        out = -1 - keys
        out[at >= 0] = self.rank[at[at >= 0]]
        return out

    def of(self, ws: list[bytes] | np.ndarray) -> np.ndarray:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, ws, itertools.repeat(self.seed)), np.uint64, len(ws))
        return self.coded((keys >> np.uint64(1)).astype(np.int64))

    def fixed(self) -> tuple[int, int]:
        """Keys of the empty word before a text and of the unknown word."""
        return self.key(b""), self.key(language_model.UNKNOWN.encode())


def number(seed: int) -> Column:
    """The key of ``word``: 63 bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), "word"), 1)


def mixed(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """A hash of each bigram of numbers."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ now.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def added(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``start``."""
    return np.add.reduceat(values, start) if len(start) else values[:0]


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted keys, -1 where it is absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; nulls are empty."""
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[at[0]: at[-1]]
    return data, at - at[0]


def parts(texts: pa.Array, piece: int) -> Iterator[pa.Array]:
    """Runs of texts of bounded size; a longer text ends its run."""
    ends, at = raw(texts)[1][1:] if len(texts) else [], 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + piece)) + 1
        yield texts[at:stop]
        at = stop


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ``words`` of all texts one after another, and how many each text has.

    On the bytes themselves: Arrow 23 returns zero bytes for lower case of a part of an array of large strings.
    """
    data, at = raw(texts)
    data, inside = LOWER[data], ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.concatenate([[0], np.cumsum(last + 1 - first)])
    found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return found, np.diff(np.searchsorted(first, at))


def entries(texts: pa.Array, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the two words of every bigram, text by text, and the words of each text."""
    found, sizes = split(texts)
    told = found.dictionary_encode()
    now = numbers.of(told.dictionary.to_numpy(zero_copy_only=False))[told.indices.to_numpy()]
    before = np.roll(now, 1)
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = numbers.of([b""])
    return before, now, sizes


def count_words(docs: DataFrame) -> DataFrame:
    """Occurrences of every word of all texts."""
    piece = PIECE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        told = lambda: pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in parts(batch.column(0), piece):
                found, n = split(part)[0].value_counts().flatten()
                seen.update(dict(zip(found.to_numpy(zero_copy_only=False), n.to_numpy().tolist(), strict=True)))
                if len(seen) >= HELD:
                    yield told()
                    seen.clear()
        yield told()

    return docs.select(col("text").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them all."""
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def based(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as the least of them and the distances from it."""
    base = rows[:1] if not len(rows) else rows.min(keepdims=True)
    return base, small(rows - base)


def packed(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays, each with its bytes ordered by significance, compressed together."""
    head = struct.pack("<H", len(arrays)) + b"".join(struct.pack("<Bq", a.itemsize, len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return head + zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(data: bytes) -> list[np.ndarray]:
    count, out = struct.unpack_from("<H", data)[0], []
    sizes = [struct.unpack_from("<Bq", data, 2 + 9 * i) for i in range(count)]
    body, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2 + 9 * count:]), np.uint8), 0
    for width, n in sizes:
        out.append(np.ascontiguousarray(body[at: at + width * n].reshape(width, n).T).view(f"<i{width}").ravel())
        at += width * n
    return out


def bits(n, follows, kept, occurs, total: int, size: int) -> np.ndarray:
    """-log2 of the probability in whole 1 / UNIT of a bit; ``kept`` is in quarters."""
    n, follows, kept, occurs = (np.asarray(x, np.float64) for x in (n, follows, kept, occurs))
    safe = np.maximum(follows, 1)
    own = np.where(n > 0, (n - DISCOUNT) / safe, 0.0)
    left = np.where(follows > 0, 1 - kept / 4 / safe, 1.0)
    return np.rint(-np.log2(own + left * ((occurs + 0.5) / (total + 0.5 * size))) * UNIT).astype(np.int64)


def frequent_pairs(docs: DataFrame, seed: int, total: int, ranks: dict[int, int]) -> np.ndarray:
    """Bigrams of which single pieces of the corpus report at least ``OFTEN`` of all occurrences, as sorted
    rank before x number of ranks + rank now. Both words of such a bigram are frequent."""
    often, piece, width = OFTEN, PIECE, len(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(seed, ranks)
        for batch in batches:
            for part in parts(batch.column(0), piece):
                before, now, _ = entries(part, numbers)
                both = (before >= 0) & (now >= 0)
                pair, n = np.unique(before[both] * width + now[both], return_counts=True)
                keep = n >= often * len(before)
                yield pa.record_batch([pair[keep], n[keep]], names=["pair", "n"])

    told = docs.select(col("text").alias("text")).where("text IS NOT NULL").mapInArrow(count, "pair long, n long")
    found = told.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(max(total * often, 1))).toPandas()
    return np.sort(found["pair"].to_numpy(np.int64))


def compared(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, target_bits and background_bits per word, and their difference.

    The lower the difference, the more the text is like the target. Null texts count as empty; a text without words has
    nulls. Repeated and null ids are rows of their own; an empty table gives an empty one, an empty target a uniform
    distribution. Other columns play no part, whatever their names.
    """
    counted = materialize(count_words(docs), "words")
    size, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    for seed in range(SEEDS):
        key = number(seed).alias("key")
        fixed = Numbers(seed).fixed()
        keys = counted.select(key)
        if not keys.where(key.isin(*fixed)).head(1) and keys.distinct().count() == size:
            break
    else:
        raise ValueError("no seed tells all words apart")
    begin, unknown = fixed
    size += 1

    # The target's bigrams, with words that the corpus lacks as the unknown one.
    code = lambda side: F.when(F.col(side) == F.lit(b""), F.lit(begin)).otherwise(F.coalesce(f"{side}_key", F.lit(unknown)))
    raw = tally(target, lambda text: bigrams(words(text)), "pair", "text").groupBy("pair").agg(F.sum("n").alias("n"))
    text = F.col("pair").cast("string")
    halves = raw.select(F.substring_index(text, " ", 1).cast("binary").alias("before"), F.substring_index(text, " ", -1).cast("binary").alias("now"), "n")
    for side in ("before", "now"):
        halves = halves.join(counted.select(F.col("word").alias(side), key.alias(f"{side}_key")), side, "left")
    wanted = materialize(halves.groupBy(code("before").alias("before"), code("now").alias("now")).agg(F.sum("n").alias("n")), "target")
    totals = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], total
    numbered = counted.select(key, F.col("n").alias("background"), F.lit(0).cast("long").alias("target")).unionAll(
        wanted.select("now", F.lit(0).cast("long"), "n"))
    table = materialize(numbered.groupBy("key").agg(*[F.sum(m).alias(m) for m in MODELS]), "numbers")
    bound = F.lit(max(total * OFTEN, 1))
    top = table.where((F.col("background") >= bound) | F.col("key").isin(begin, unknown)).toPandas()
    for n in (begin, unknown):
        if n not in set(top["key"]):
            top.loc[len(top)] = {"key": n, "target": 0, "background": 0}
    top = top.sort_values(["background", "key"], ascending=[False, True])
    occurs = top[list(MODELS)].to_numpy(np.int64)
    ranks = {int(k): i for i, k in enumerate(top["key"])}
    width = len(ranks)
    hot = frequent_pairs(docs, seed, total, ranks)
    hot_before, hot_now = np.divmod(hot, width)

    buckets, piece, taken = max(total // ENTRIES, 1) + 1, PIECE, TAKEN
    blocks = buckets // BLOCK + 1
    id_type = docs.select(col("doc_id").alias("doc_id")).limit(0).toArrow().schema.field("doc_id").type
    kind_of = docs.select(col("doc_id").alias("doc_id")).schema["doc_id"].dataType.simpleString()
    columns = f"bucket long, kind int, data binary, row long, doc_id {kind_of}, n_words long"

    def spread_of(keys: np.ndarray, among: int = buckets) -> np.ndarray:
        return (mixed(keys, keys) % np.uint64(among)).astype(np.int64)

    def by_place(to: np.ndarray) -> np.ndarray:
        """An order by bucket or block that keeps the order within; few of them are sorted by their digits."""
        return np.argsort(to.astype(np.uint16 if max(buckets, blocks) < 1 << 16 else np.int64), kind="stable")

    def slices(to: np.ndarray) -> Iterator[tuple[int, slice]]:
        start = runs(to)
        for i, j in itertools.pairwise(np.append(start, len(to)).tolist()):
            yield int(to[i]), slice(i, j)

    def dealt(before, now, row, times) -> Iterator[tuple[int, int, bytes]]:
        """Packed entries by kind and bucket."""
        at = np.full(len(before), -1)
        both = np.flatnonzero((before >= 0) & (now >= 0))
        at[both] = place(hot, before[both] * width + now[both])
        is_hot = at >= 0
        if is_hot.any():
            yield HOT, -1 - int(spread_of(row[is_hot][:1])[0]), packed(*based(row[is_hot]), small(at[is_hot]), small(times[is_hot]))
        before, now, row, times = (x[~is_hot] for x in (before, now, row, times))
        to = spread_of(np.where(before < 0, before, np.where(now < 0, now, mixed(before, now).view(np.int64))))
        order = np.argsort(before)
        order = order[by_place(to[order])]
        before, now, row, times, to = (x[order] for x in (before, now, row, times, to))
        for bucket, i in slices(to):
            yield BUCKET, bucket, packed(before[i], now[i], *based(row[i]), small(times[i]))

    def batch_of(sent: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        n, (kind, bucket, data) = len(sent), zip(*sent, strict=True) if sent else ((), (), ())
        return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.nulls(n, pa.int64()),
                                pa.nulls(n, id_type), pa.nulls(n, pa.int64())], names=["bucket", "kind", "data", "row", "doc_id", "n_words"])

    def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(seed, ranks)
        for batch in batches:
            at = 0
            for texts in parts(batch.column(2), piece):
                before, now, sizes = entries(texts, numbers)
                n = len(sizes)
                rows, ids = batch.column(0).slice(at, n), batch.column(1).slice(at, n)
                at += n
                row = rows.to_numpy()
                yield batch_of(list(dealt(before, now, np.repeat(row, sizes), np.ones(len(now), np.int8))))
                yield pa.record_batch([pa.array(-1 - spread_of(row)), pa.array(np.full(n, DOC, np.int32)), pa.nulls(n, pa.binary()),
                                       rows, ids, pa.array(sizes)], names=["bucket", "kind", "data", "row", "doc_id", "n_words"])

    def read_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(seed, ranks)
        for batch in batches:
            before, now, n = (c.to_numpy() for c in batch.columns)
            yield batch_of(list(dealt(numbers.coded(before), numbers.coded(now), np.full(len(n), TARGET), n)))

    def read_words(among: int):
        """Counts of the seldom words by bucket or block."""
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, held = Numbers(seed, ranks), []

            def sent() -> pa.RecordBatch:
                keys, *n = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                code = numbers.coded(keys)
                order = np.flatnonzero(code < 0)
                order = order[np.argsort(code[order])]
                to = spread_of(code[order], among)
                again = by_place(to)
                order, to = order[again], to[again]
                return batch_of([(WORDS, bucket, packed(code[order[i]], *(small(c[order[i]]) for c in n))) for bucket, i in slices(to)])

            for batch in batches:
                held.append([c.to_numpy() for c in batch.columns])
                if sum(len(h[0]) for h in held) >= taken:
                    yield sent()
            if held:
                yield sent()
        return table.select("key", *MODELS).mapInArrow(read, columns)

    def counts_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The seldom words of a bucket or block in order, and their occurrences."""
        told = [unpacked(d) for d in group.filter(pc.equal(group["kind"], WORDS))["data"].to_pylist()]
        if not told:
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        code, *n = (np.concatenate(c) for c in zip(*told, strict=True))
        order = np.argsort(code)
        return code[order], np.stack(n, axis=1)[order].astype(np.int64)

    def gathered(group: pa.Table) -> pa.Table:
        """A bucket's entries by bigram, its sums for frequent words and its bigrams of two seldom words."""
        kind = group["kind"][0].as_py()
        if kind == HOT or kind == DOC:
            # Groups of these mix: every row goes on, documents to their block.
            to = pc.if_else(pc.equal(group["kind"], DOC), pa.array(spread_of(group["row"].fill_null(0).to_numpy(), blocks)), group["bucket"])
            return group.set_column(group.schema.get_field_index("bucket"), "bucket", to)
        sent = [unpacked(d) for d in group.filter(pc.equal(group["kind"], BUCKET))["data"].to_pylist()]
        if not sent:
            return group.slice(0, 0)
        before, now, row, times = (np.concatenate(a) for a in zip(*((b, w, r.astype(np.int64) + base, t) for b, w, base, r, t in sent), strict=True))
        del sent
        order = np.lexsort((now, before))
        before, now, row, times = (x[order] for x in (before, now, row, times))
        own, start = row != TARGET, runs(before, now)
        n = np.stack([added(np.where(own, 0, times).astype(np.int64), start), added(np.where(own, times, 0).astype(np.int64), start)], axis=1)
        held = np.diff(np.append(start, len(before)))
        pair = np.repeat(np.arange(len(start), dtype=np.int32), held)
        before, now = before[start], now[start]
        first = runs(before)
        sums = np.concatenate([added(n, first), added(4 * n - np.where(n > 0, int(4 * DISCOUNT), 0), first)], axis=1)  # followers; kept in quarters
        lies = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(before))))
        rare, both = before[first] < 0, (before < 0) & (now < 0)
        out = [(BEFORE, -1, packed(before[first][~rare], *(small(c) for c in sums[~rare].T)))]

        # Bigrams of two seldom words, by the block of the second.
        mine = np.flatnonzero(own & both[pair])
        to = spread_of(now, blocks)[pair[mine]]
        order = by_place(to)
        mine, to = mine[order], to[order]
        for block, i in slices(to):
            of = pair[mine[i]]
            first_of = runs(of)
            told = of[first_of]
            out.append((BOTH, block, packed(*based(row[mine[i]]), small(times[mine[i]]), small(np.diff(np.append(first_of, len(of)))), now[told],
                                            *(small(c[told]) for c in n.T), *(small(c[lies[told]]) for c in sums.T))))

        # All others: what the bucket knows of its seldom words goes behind what all know of the frequent ones.
        mine = np.flatnonzero(own & ~both[pair])
        kept, held = np.unique(pair[mine], return_counts=True)
        names, row_at = np.unique(row[mine], return_inverse=True)
        before, now, lies = before[kept], now[kept], lies[kept]
        rare_before, before_at = np.unique(lies[before < 0], return_inverse=True)
        rare_now, now_at = np.unique(now[now < 0], return_inverse=True)
        before[before < 0], now[now < 0] = width + before_at, width + now_at
        code, occurring = counts_of(group)
        out.append((BUCKET, -1, packed(small(before), small(now), *(small(c[kept]) for c in n.T), small(held), *based(names), small(row_at), small(times[mine]),
                                       *(small(c[rare_before]) for c in sums.T), *(small(c) for c in occurring[place(code, rare_now)].T))))
        return pa.Table.from_batches([batch_of(out)])

    source = docs.select(F.monotonically_increasing_id().alias("row"), col("doc_id").alias("doc_id"), col("text").alias("text"))
    stream = source.mapInArrow(read_docs, columns).unionAll(wanted.mapInArrow(read_target, columns)).unionAll(read_words(buckets))
    held = materialize(stream.groupBy("bucket").applyInArrow(gathered, columns), "buckets")

    # Sums of the frequent words before, and counts of the frequent bigrams: bounded by 1 / OFTEN each.
    def often_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = np.zeros((len(hot), 4), np.int64), np.zeros((width, 4), np.int64)
        for batch in batches:
            for kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == HOT:
                    base, row, at, times = unpacked(data)
                    np.add.at(n, (at, np.where(row + base == TARGET, 0, 1)), times)
                else:
                    key, *told = unpacked(data)
                    of[key] += np.stack(told, axis=1)
        for kind, values in ((HOT, n), (BEFORE, of)):
            at = np.flatnonzero(values.any(axis=1))
            yield pa.record_batch([np.full(len(at), kind, np.int32), at.astype(np.int64), *values[at].T], names=["kind", "at", "v0", "v1", "v2", "v3"])

    often = held.where(F.col("kind").isin(HOT, BEFORE)).select("kind", "data").mapInArrow(often_counts, "kind int, at long, v0 long, v1 long, v2 long, v3 long")
    told = often.groupBy("kind", "at").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(4)]).toPandas()
    hot_n, sums = np.zeros((len(hot), 4), np.int64), np.zeros((width, 4), np.int64)
    for kind, values in ((HOT, hot_n), (BEFORE, sums)):
        mine = told[told["kind"] == kind]
        values[mine["at"].to_numpy(np.int64)] = mine[[f"v{i}" for i in range(4)]].to_numpy(np.int64)
    hot_n = hot_n[:, :2]
    np.add.at(sums, hot_before, np.concatenate([hot_n, 4 * hot_n - np.where(hot_n > 0, int(4 * DISCOUNT), 0)], axis=1))

    def both_bits(n, follows_kept, occurring) -> list[np.ndarray]:
        return [bits(n[:, m], follows_kept[:, m], follows_kept[:, 2 + m], occurring[:, m], totals[m], size) for m in (0, 1)]

    hot_bits = np.stack(both_bits(hot_n, sums[hot_before], occurs[hot_now]), axis=1)

    def summed(row: np.ndarray, at: np.ndarray, cost: list[np.ndarray]) -> pa.RecordBatch:
        """The costs of entries by the row that ``at`` gives, packed for the rows' blocks."""
        total_of = [np.zeros(len(row), np.int64) for _ in MODELS]
        for t, c in zip(total_of, cost, strict=True):
            np.add.at(t, at, c)
        to = spread_of(row, blocks)
        order = by_place(to)
        row, to, total_of = row[order], to[order], [t[order] for t in total_of]
        return batch_of([(DOC, block, packed(*based(row[i]), *(small(t[i]) for t in total_of))) for block, i in slices(to)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == HOT:
                    base, row, at, times = unpacked(data)
                    own = row + base != TARGET
                    names, row_at = np.unique(row[own], return_inverse=True)
                    yield summed(names + base, row_at, [c[at[own]] * times[own] for c in hot_bits.T])
                    continue
                before, now, target_n, background_n, times_of, base, names, row_at, times, *of = unpacked(data)
                n, of = np.stack([target_n, background_n], axis=1), [np.asarray(a, np.int64) for a in of]
                cost = both_bits(n, np.concatenate([sums, np.stack(of[:4], axis=1)])[before], np.concatenate([occurs, np.stack(of[4:], axis=1)])[now])
                yield summed(names + base, row_at, [np.repeat(c, times_of) * times for c in cost])

    def joined(group: pa.Table) -> pa.Table:
        """Costs of the bigrams whose second word belongs to a block."""
        code, occurring = counts_of(group)
        out = []
        for data in group.filter(pc.equal(group["kind"], BOTH))["data"].to_pylist():
            base, row, times, times_of, now, target_n, background_n, *of = unpacked(data)
            cost = both_bits(np.stack([target_n, background_n], axis=1), np.stack(of, axis=1), occurring[place(code, now)])
            out.append((row + base, *[np.repeat(c, times_of) * times for c in cost]))
        if not out:
            return group.slice(0, 0)
        row, *cost = (np.concatenate(c) for c in zip(*out, strict=True))
        names, row_at = np.unique(row, return_inverse=True)
        return pa.Table.from_batches([summed(names, row_at, cost)])

    def finished(group: pa.Table) -> pa.Table:
        """The documents of a block with the sums of their costs."""
        of = group.filter(pc.is_valid(group["row"]))
        rows, costs = of["row"].to_numpy(), np.zeros((len(MODELS), len(of)), np.int64)
        order = np.argsort(rows)
        rows = rows[order]
        for data in group.filter(pc.is_valid(group["data"]))["data"].to_pylist():
            base, row, *told = unpacked(data)
            costs[:, place(rows, row + base)] += np.stack(told)
        of = of.select(["doc_id", "n_words"]).take(pa.array(order))
        return pa.table([*of.columns, *map(pa.array, costs)], names=["doc_id", "n_words", *MODELS])

    apart = held.where(F.col("kind") == BOTH).unionAll(read_words(blocks)).groupBy("bucket").applyInArrow(joined, columns)
    costs = held.where(F.col("kind").isin(HOT, BUCKET)).select("kind", "data").mapInArrow(scored, columns).unionAll(apart)
    out = costs.unionAll(held.where(F.col("kind") == DOC)).groupBy("bucket").applyInArrow(
        finished, f"doc_id {kind_of}, n_words long, target long, background long")
    per = lambda m: F.when(F.col("n_words") > 0, F.col(m) / F.lit(float(UNIT)) / F.col("n_words")).alias(f"{m}_bits")
    return out.select("doc_id", "n_words", *[per(m) for m in MODELS]).withColumn(
        "difference", F.col("target_bits") - F.col("background_bits"))
