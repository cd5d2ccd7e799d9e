"""Document likelihood over subword lattices (operator 5).

A text is a sequence of words and one end.  A word (a blank, then its bytes) is spelled
by pieces of an existing subword vocabulary or single bytes, in any segmentation; pieces
and the end are drawn independently.  A word's probability is the sum over all
segmentations, by a forward recursion in log space, and a document's probability the
product over its words and the end.

The vocabulary is given; its scores (by rank) are where the weights start, and
expectation-maximisation over the training words' lattices sets them.  Only distinct
words are run through lattices: the corpus is folded to a table of words with counts.
Scoring sends no frequent word through a shuffle: the most frequent ones, a bounded
number of bounded length, are looked up where the text is, the others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .setsketch import _BYTES, _powers, mix
from .shared import id_fold, staged, text_or_empty

U = np.uint64
BLANK = "▁"
FLUSH = 300_000
#: Bytes of a word in one lattice pass; longer ones are counted in stretches of this size, and scored whole.
STRETCH = 256


@dataclass(frozen=True)
class Settings:
    """``head`` words of at most ``head_bytes`` bytes are looked up in memory; ``passes`` of fitting."""

    parts: int = 7
    held_out: int = 2
    head: int = 65_536
    head_bytes: int = 64
    passes: int = 2
    smooth: float = 0.05


def vocabulary(path: str) -> list[bytes]:
    """Pieces a lower-cased word can hold, best first; a leading blank is a space, bytes come last."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    order = sorted(range(model.get_piece_size()), key=lambda i: -model.get_score(i))
    found: dict[bytes, None] = {}
    for i in order:
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or BLANK in piece[1:]:
            continue
        data = piece.replace(BLANK, " ").encode()
        if data.lower() == data:
            found[data] = None
    for b in range(256):
        found.setdefault(bytes([b]), None)
    return list(found)


#: Leading bits of a hash that a piece is found by.
_TOP = 18


class Lattice:
    """Pieces by hash, with natural log weights."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.longest = max(map(len, pieces))
        codes = np.array([self._code(np.frombuffer(p, np.uint8)) for p in pieces], U)
        by = np.argsort(codes)
        # One more entry at the end, so that a search may stop behind the last piece.
        self.codes, self.ids = np.append(codes[by], U(2**64 - 1)), np.append(by, -1)
        self.logp = logp
        self.first = np.searchsorted(codes[by], np.arange(1 << _TOP, dtype=U) << U(64 - _TOP)).astype(np.int32)
        self.most = int(np.bincount((codes >> U(64 - _TOP)).astype(np.int64)).max())

    def find(self, code: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for others: the leading bits say where to look."""
        at = self.first[code >> U(64 - _TOP)]
        for _ in range(self.most - 1):
            at = at + (self.codes[at] < code)
        return np.where(self.codes[at] == code, self.ids[at], -1)

    @staticmethod
    def _code(data: np.ndarray) -> U:
        up, _ = _powers(len(data))
        return mix(np.array([(_BYTES[data] * up).sum(dtype=U)], U) + U(len(data)))[0]

    def pieces_at(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece ids or -1) for all stretches of equally long words (a row of bytes each)."""
        m, n = words.shape
        up, down = _powers(n + 1)
        sums = np.zeros((m, n + 1), U)
        np.cumsum(_BYTES[words] * up[:n], axis=1, dtype=U, out=sums[:, 1:])
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                ids = self.find(mix((sums[:, end] - sums[:, start]) * down[start] + U(end - start)))
                if (ids >= 0).any():
                    yield start, end, ids

    def forward(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        m, n = words.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        arcs = []
        for start, end, ids in self.pieces_at(words):
            way = alpha[start] + np.where(ids >= 0, self.logp[ids], -np.inf)
            alpha[end] = np.logaddexp(alpha[end], way)
            arcs.append((start, end, ids))
        return alpha, arcs

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word."""
        out = np.empty(len(words))
        for index, block in _blocks(words, None):
            if block.shape[1] <= 4 * STRETCH:
                out[index] = self.forward(block)[0][-1]
            else:
                out[index] = [self._long(row) for row in block]
        return out

    def _long(self, word: np.ndarray) -> float:
        """One long word: pieces of all stretches at once, then the recursion over a window of ends."""
        n = len(word)
        up, down = _powers(n + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[word] * up[:n], dtype=U)))
        table = np.full((self.longest, n), -np.inf)
        for size in range(1, min(self.longest, n) + 1):
            ids = self.find(mix((sums[size:] - sums[:-size]) * down[: n - size + 1] + U(size)))
            table[size - 1, size - 1 :][ids >= 0] = self.logp[ids[ids >= 0]]
        alpha = np.full(n + 1 + self.longest, -np.inf)  # index shifted, so that windows never leave it
        alpha[self.longest] = 0
        for end in range(1, n + 1):
            before = alpha[end : end + self.longest][::-1]
            alpha[self.longest + end] = np.logaddexp.reduce(before + table[:, end - 1])
        return float(alpha[-1])

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """How often each piece is used over all segmentations, by their weight."""
        out = np.zeros(len(self.logp))
        for index, block in _blocks(words, STRETCH):
            alpha, arcs = self.forward(block)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for start, end, ids in reversed(arcs):
                way = beta[end] + np.where(ids >= 0, self.logp[ids], -np.inf)
                beta[start] = np.logaddexp(beta[start], way)
            total = alpha[-1]
            for start, end, ids in arcs:
                use = ids >= 0
                post = np.exp(alpha[start][use] + self.logp[ids[use]] + beta[end][use] - total[use])
                out += np.bincount(ids[use], post * weights[index][use], len(out))
        return out


def _blocks(words: list[bytes], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, matrix of bytes) of words of one length with their blank; longer ones cut to ``most`` bytes."""
    pieces = []
    for i, w in enumerate(words):
        w = b" " + w
        pieces += [(i, w)] if most is None or len(w) <= most else [(i, w[k : k + most]) for k in range(0, len(w), most)]
    by: dict[int, list] = {}
    for i, w in pieces:
        by.setdefault(len(w), []).append((i, w))
    for size, group in by.items():
        step = max(1, 2_000_000 // size**2) if size < 1000 else 1
        for at in range(0, len(group), step):
            part = group[at : at + step]
            yield np.array([i for i, _ in part]), np.frombuffer(b"".join(w for _, w in part), np.uint8).reshape(-1, size)


def _words(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, n): every distinct word of the corpus, ``n`` times in training texts."""
    train = id_fold(F.col("doc_id"), settings.parts) != settings.held_out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for learn, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().lower().split()
                if learn:
                    counts.update(words)
                else:
                    counts.update(dict.fromkeys(words, 0))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(train.alias("learn"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, pieces: list[bytes], ends: int, settings: Settings) -> np.ndarray:
    """Natural log weights of the pieces and, last, of the end."""
    start = 1 / (np.arange(len(pieces)) + 10.0)
    logp = np.log(start / start.sum())
    spark = words.sparkSession
    count = np.zeros(len(pieces))
    for _ in range(settings.passes):
        shared = spark.sparkContext.broadcast((pieces, logp))  # bounded by the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.logp))
            for batch in batches:
                total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        found = words.where("n > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        count = np.zeros(len(pieces))
        for row in found.collect():  # a row for each piece of the vocabulary at most
            count[row.piece] = row.n
        logp = np.log((count + settings.smooth) / (count.sum() + settings.smooth * len(pieces)))
    every = np.concatenate((count, [ends])) + settings.smooth
    return np.log(every / every.sum())


def score(docs: DataFrame, vocabulary_path: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Null texts are empty (only an end).  Rows without an id are learnt from.  Texts and
    ids may repeat; every row is scored by itself.
    """
    spark = docs.sparkSession
    held = id_fold(F.col("doc_id"), settings.parts) == settings.held_out
    words = staged(_words(docs, settings), "words")
    ends = docs.where(~held).count()
    sums = words.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    tokens = (sums[0] or 0) + ends
    distinct = (sums[1] or 0) + (ends > 0)
    base = np.log10(tokens + distinct + 1.0)
    pieces = vocabulary(vocabulary_path)
    logp = fit(words, pieces, ends, settings)
    shared = spark.sparkContext.broadcast((pieces, logp[:-1]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            marginal = lattice.marginal(batch.column(0).to_pylist()) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marginal)], names=["word", "n", "logp"])

    weighed = staged(words.mapInArrow(weigh, "word binary, n long, logp double"), "weighed")
    short = weighed.where(F.length("word") <= settings.head_bytes)
    head = short.orderBy(F.desc("n"), "word").limit(settings.head).collect()  # bounded in rows and bytes
    lookup = spark.sparkContext.broadcast(
        {bytes(r.word): (float(np.log10(r.n + 1) - base), r.logp, int(r.n > 0)) for r in head}
    )
    end = (float(np.log10(ends + 1) - base), float(logp[-1] / np.log(10)), int(ends > 0))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = lookup.value
        for batch in batches:
            names = ["row", "doc_id", "word", "k", "n_tokens", "n_known", "base_score", "score"]
            cols: dict[str, list] = {n: [] for n in names}
            rows: list[tuple] = []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(text.lower().split())
                total, known, low, likely = 1, end[2], end[0], end[1]
                for word, k in found.items():
                    total += k
                    have = known_words.get(word)
                    if have is None:
                        rows.append((row, None, word, k, 0, 0, 0.0, 0.0))
                    else:
                        low += k * have[0]
                        likely += k * have[1]
                        known += k * have[2]
                # No word holds a blank, so this row's key meets no word and spreads over partitions.
                rows.append((row, doc_id, b" %d" % row, 0, total, known, low, likely))
            for name, values in zip(names, zip(*rows, strict=True) if rows else [()] * 8, strict=True):
                cols[name] = list(values)
            types = [pa.int64(), batch.schema.field(1).type, pa.binary(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(names, types, strict=True)], names=names)

    seen = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().cast("binary").alias("text")
    ).mapInArrow(
        look, f"row long, doc_id {kind}, word binary, k long, n_tokens long, n_known long, base_score double, score double"
    )
    joined = seen.join(weighed, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    add = lambda name, more: F.sum(F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    per_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        add("n_known", F.when(F.col("n") > 0, F.col("k"))),
        add("base_score", F.col("k") * (F.log10(F.col("n") + 1.0) - F.lit(float(base)))),
        add("score", F.col("k") * F.col("logp")),
    )
    return per_row.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
