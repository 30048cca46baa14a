"""SentencePiece encoding with seeded merge dropout, and lossless decoding.

A text is cut into characters, and neighbours are merged as long as their union is a piece: always the
best-scored candidate first, the leftmost of equals. With dropout a candidate (first, middle and last
character of the two neighbours) is skipped if a keyed hash says so, so the text is segmented in a
varied but reproducible way into pieces that spell it all the same. Without dropout the result is that
of the public SentencePiece library.

No piece reaches over the start of a word, so words are segmented on their own. The key of the hash is
seed, document, copy, place and word, so every occurrence of a word has draws of its own. Distinct words
of a batch are first segmented without dropout. An occurrence whose draws skip none of the merges that
its word took then has that segmentation, as a skipped candidate that is never the best one changes
nothing; all other occurrences are segmented one by one. That happens side by side on arrays, one merge
per word and round; long unbroken words are segmented by an agenda. Characters without a piece fall back to bytes, among them a U+2581 of the
text itself, which SentencePiece uses for the space; so every text decodes to itself.
"""

from __future__ import annotations

import dataclasses
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import col

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORDS = re.compile(r" +[^ ]*|[^ ]+")
#: Words up to this length are segmented on arrays.
SHORT = 40
#: Characters of texts whose words are gathered before they are segmented.
GATHERED = 1 << 22
#: Words that are segmented at once.
CHUNK = 1 << 17
# The odd multipliers of a published 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BITS64 = (1 << 64) - 1


@dataclasses.dataclass
class Vocabulary:
    """``symbol``: number of a character or piece; ``pairs``: left * size + right of mergeable symbols, sorted,
    with the merged symbol and its rank; ``spelling``: bytes of each piece; ``byte``: piece of each byte."""

    symbol: dict[str, int]
    pairs: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    size: int
    spelling: list[bytes]
    byte: list[int]


def load(path: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model of kind BPE with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    text = {i: model.id_to_piece(i).replace("▁", " ") for i in plain}
    if any(" " in t.lstrip(" ") for t in text.values()):
        raise ValueError("a piece reaches over the start of a word")
    symbol = {t: i for i, t in text.items()}
    for c in sorted({c for t in text.values() for c in t}):
        symbol.setdefault(c, n + len(symbol))
    size = max(symbol.values()) + 1
    order = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -model.get_score(i)))}
    found = {symbol[t[:k]] * size + symbol[t[k:]]: i for i, t in text.items() for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol}
    pairs = np.array(sorted(found), dtype=np.int64)
    merged = np.array([found[p] for p in pairs.tolist()], dtype=np.int64)
    spelling = [text[i].encode() if i in text else b"" for i in range(n)]
    byte = [0] * 256
    for i in range(n):
        if model.is_byte(i):
            byte[int(model.id_to_piece(i)[1:-1], 16)] = i
            spelling[i] = bytes([int(model.id_to_piece(i)[1:-1], 16)])
    return Vocabulary(symbol, pairs, merged, np.array([order[i] for i in merged.tolist()], dtype=np.int64), size, spelling, byte)


def mixed(x):
    """A 64-bit hash of 64-bit numbers, of an array or one by one."""
    if isinstance(x, np.ndarray):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
        return x ^ (x >> np.uint64(31))
    x = ((x ^ (x >> 30)) * MIX[1]) & BITS64
    x = ((x ^ (x >> 27)) * MIX[2]) & BITS64
    return x ^ (x >> 31)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, seed: int = 0, dropout: float = 0.0) -> None:
        self.v, self.seed = vocabulary, seed
        self.limit = min(int(dropout * 2**64), BITS64)
        # Symbols of characters that no piece has: numbers that are in no pair.
        self.other = 1 << 22

    def key(self, word: str, occurrence: int) -> int:
        return mixed((self.seed * MIX[0] + occurrence * MIX[1] + zlib.crc32(word.encode())) & BITS64)

    def symbols(self, word: str) -> list[int]:
        get = self.v.symbol.get
        return [s if (s := get(c)) is not None and c != "▁" else self.other + ord(c) for c in word]

    def agenda(self, word: str, key: int) -> list[int]:
        """Segment one word by a queue of candidates."""
        v = self.v
        sym = self.symbols(word)
        n = len(sym)
        stop, nxt, prev, queue = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), []
        merges = dict(zip(v.pairs.tolist(), zip(v.rank.tolist(), v.merged.tolist(), strict=True), strict=True)) if not hasattr(self, "merges") else self.merges
        self.merges = merges

        def propose(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            if i < 0 or j >= n or sym[i] >= self.other or sym[j] >= self.other:
                return
            found = merges.get(sym[i] * v.size + sym[j])
            if found and not (self.limit and mixed((key + i * MIX[0] + stop[i] * MIX[1] + stop[j] * MIX[2]) & BITS64) < self.limit):
                heapq.heappush(queue, (found[0], i, stop[i], stop[j], found[1]))

        for i in range(n - 1):
            propose(i)
        gone = [False] * n
        while queue:
            _, i, middle, end, piece = heapq.heappop(queue)
            j = nxt[i]
            if gone[i] or stop[i] != middle or j >= n or stop[j] != end:
                continue
            sym[i], stop[i], nxt[i], gone[j] = piece, end, nxt[j], True
            if nxt[j] < n:
                prev[nxt[j]] = i
            propose(prev[i])
            propose(i)
        return [s for s, g in zip(sym, gone, strict=True) if not g]

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of all words in order, and how many each has."""
        return np.array([s for w in words for s in self.symbols(w)], dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64)

    def side_by_side(self, words: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Segment many occurrences of words at once; symbols of all words in order, and how many each has."""
        key = np.array([self.key(w, k) for w, k in words], dtype=np.uint64)
        return self.merged(*self.letters([w for w, _ in words]), key)

    def draws(self, key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Are the candidates skipped?"""
        u = lambda x: x.astype(np.uint64)
        return mixed(key + u(begin) * np.uint64(MIX[0]) + u(middle) * np.uint64(MIX[1]) + u(end) * np.uint64(MIX[2])) < np.uint64(self.limit)

    def merged(self, sym: np.ndarray, lengths: np.ndarray, key: np.ndarray | None, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of words, without dropout if there are no keys; ``taken`` gets the merges of each round."""
        v = self.v
        word = np.repeat(np.arange(len(lengths)), lengths)
        begin = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym, stop = sym.copy(), begin + 1
        done = []
        while len(sym):
            pair = np.where((sym[:-1] < self.other) & (sym[1:] < self.other) & (word[:-1] == word[1:]), sym[:-1] * v.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
            hit = np.flatnonzero(v.pairs[at] == pair)
            if self.limit and key is not None and len(hit):
                hit = hit[~self.draws(key[word[hit]], begin[hit], stop[hit], stop[hit + 1])]
            live = np.zeros(len(lengths), bool)
            live[word[hit]] = True
            rest = live[word]
            done.append((sym[~rest], word[~rest]))
            if not len(hit):
                break
            owner = word[hit]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat((v.rank[at[hit]] << 32) | hit, heads) & 0xFFFFFFFF
            if taken is not None:
                taken.append((word[best], begin[best], stop[best], stop[best + 1]))
            sym[best], stop[best] = v.merged[at[best]], stop[best + 1]
            rest[best + 1] = False
            sym, word, begin, stop = sym[rest], word[rest], begin[rest], stop[rest]
        if not done:
            return sym, np.zeros(len(lengths), np.int64)
        sym, word = np.concatenate([s for s, _ in done]), np.concatenate([w for _, w in done])
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))

    def spelled(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes for characters that have no piece."""
        plain = len(self.v.spelling)
        odd = np.flatnonzero(sym >= plain)
        if not len(odd):
            return sym, count
        name = {i: c for c, i in self.v.symbol.items() if i >= plain}
        raw = [[self.v.byte[b] for b in (chr(s - self.other) if s >= self.other else name[s]).encode()] for s in sym[odd].tolist()]
        times = np.ones(len(sym), dtype=np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(sym, times)
        place = np.cumsum(times) - times
        flat = np.concatenate([np.arange(place[o], place[o] + len(r)) for o, r in zip(odd, raw, strict=True)])
        out[flat] = [b for r in raw for b in r]
        owner = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(owner, times, len(count)).astype(np.int64)

    def batch(self, texts: list[str | None], ids: list) -> Iterator[np.ndarray]:
        """Piece numbers of each text; the draws depend on seed, id, place and word."""
        known: dict[str, int] = {}
        use, drawn, sizes = [], [], []
        for text, i in zip(texts, ids, strict=True):
            words = WORDS.findall(" " + text) if text else []
            use.extend([known.setdefault(w, len(known)) for w in words])
            sizes.append(len(words))
            if self.limit:
                first = mixed((self.seed * MIX[2] + xxhash.xxh64_intdigest(str(i).encode())) & BITS64)
                drawn.append(mixed(np.arange(len(words), dtype=np.uint64) * np.uint64(MIX[0]) + np.uint64(first)))
        # Short words first; the segmentation of a word without dropout has the number of the word.
        names = sorted(known, key=lambda w: len(w) > SHORT)
        short = sum(len(w) <= SHORT for w in names)
        place = np.empty(len(known), np.int64)
        place[[known[w] for w in names]] = np.arange(len(names))
        use = place[np.array(use, dtype=np.int64)]
        del known
        parts, counts = [], []

        def keep(sym: np.ndarray, count: np.ndarray) -> None:
            sym, count = self.spelled(sym, count)
            parts.append(sym.astype(np.int32))
            counts.append(count)

        letters, lengths = self.letters(names[:short])
        begins = np.cumsum(lengths) - lengths
        if self.limit:
            crc = np.array([zlib.crc32(w.encode()) for w in names], dtype=np.uint64)
            key = np.uint64(self.seed * MIX[0] & BITS64) + np.concatenate(drawn) * np.uint64(MIX[1]) + crc[use]
            key = mixed(key)
            del drawn
            skipped = np.zeros(len(use), bool)
            by_word = np.argsort(use, kind="stable")
            bounds = np.searchsorted(use[by_word], np.arange(short + 1))
        for k in range(0, short, CHUNK):
            end = min(k + CHUNK, short)
            taken = [] if self.limit else None
            keep(*self.merged(letters[begins[k]: begins[end - 1] + lengths[end - 1]], lengths[k:end], None, taken))
            if taken:
                word, *candidate = (np.concatenate(c) for c in zip(*taken, strict=True))
                order = np.argsort(word, kind="stable")
                candidate = [c[order] for c in candidate]
                many = np.bincount(word, minlength=end - k)
                start = np.cumsum(many) - many
                mine = by_word[bounds[k]: bounds[end]]
                for j in range(0, len(mine), CHUNK):
                    part = mine[j: j + CHUNK]
                    of = use[part] - k
                    n = many[of]
                    flat = np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    owner = np.repeat(part, n)
                    skipped[owner[self.draws(key[owner], *[c[flat] for c in candidate])]] = True
        if self.limit:
            # Long words are always segmented one by one.
            again = np.flatnonzero(skipped)
            for k in range(0, len(again), CHUNK):
                part = again[k: k + CHUNK]
                n = lengths[use[part]]
                flat = np.repeat(begins[use[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keep(*self.merged(letters[flat], n, key[part]))
            far = np.flatnonzero(use >= short)
            todo = [(names[w], int(x)) for w, x in zip(use[far].tolist(), key[far].tolist(), strict=True)]
            use[again] = short + np.arange(len(again))
            use[far] = short + len(again) + np.arange(len(far))
        else:
            todo = [(w, 0) for w in names[short:]]
        for w, x in todo:
            sym = np.array(self.agenda(w, x), dtype=np.int64)
            keep(sym, np.array([len(sym)]))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        at = 0
        for many in sizes:
            mine = use[at: at + many]
            at += many
            n = size[mine]
            yield flat[np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def encode(self, texts: list[str | None], ids: list) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < GATHERED):
                size += len(texts[end] or "")
                end += 1
            yield from self.batch(texts[at:end], ids[at:end])
            at = end


def decode(vocabulary: Vocabulary, pieces) -> str:
    """The text that the pieces spell, without the space that encoding puts before it."""
    spelling = vocabulary.spelling
    return b"".join([spelling[i] for i in pieces]).decode("utf-8", "replace")[1:]


def encoded(docs: DataFrame, seed: int = 0, dropout: float = 0.1, model: str = MODEL, id_col: str = "doc_id",
            text_col: str = "text", name: str = "pieces", copy_col: str | None = None) -> DataFrame:
    """The documents with their piece numbers in the column ``name``, which is replaced if there is one.

    A null or empty text has no pieces. Rows with the same id and text are segmented alike, unless ``copy_col``
    tells them apart.
    """
    vocabulary = load(model)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary, seed, dropout)
        for texts, ids in batches:
            yield pd.Series(list(encoder.encode(texts.tolist(), ids.tolist())), dtype=object)

    ident = col(id_col).cast("string")
    if copy_col:
        ident = F.concat_ws(":", F.coalesce(ident, F.lit("\\N")), col(copy_col).cast("string"))
    return docs.withColumn(name, encode(col(text_col), ident))


def decoded(df: DataFrame, model: str = MODEL, pieces_col: str = "pieces", name: str = "text") -> DataFrame:
    """The rows with the text that their pieces spell; null pieces spell the empty text."""
    vocabulary = load(model)

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([decode(vocabulary, r) if r is not None else "" for r in rows], dtype=object)

    return df.withColumn(name, spell(col(pieces_col)))


def digests(docs: DataFrame, seed: int = 0, dropout: float = 0.1, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pieces, pieces_crc32 (of the numbers as 4 little-endian bytes), and
    whether decoding gives the text back. Encoding and decoding happen in one pass, so the pieces do not
    travel."""
    vocabulary = load(model)

    @F.pandas_udf("struct<n_pieces long, pieces_crc32 long, lossless boolean>")
    def summarise(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary, seed, dropout)
        for texts, ids in batches:
            texts, rows = texts.tolist(), []
            for text, pieces in zip(texts, encoder.encode(texts, ids.tolist()), strict=True):
                rows.append((len(pieces), zlib.crc32(pieces.astype("<i4").tobytes()), decode(vocabulary, pieces.tolist()) == (text or "")))
            yield pd.DataFrame(rows, columns=["n_pieces", "pieces_crc32", "lossless"])

    return docs.select(col("doc_id").alias("doc_id"), summarise(col("text"), col("doc_id").cast("string")).alias("of")).select("doc_id", "of.*")
