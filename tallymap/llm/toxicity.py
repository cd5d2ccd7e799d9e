"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained, one on toxic and one on ordinary text; a
window of text is compressed with both and the difference of the two lengths says
which class knows it better.  Windows are cut at white space (tokens over 64 bytes
into pieces that overlap by half), since a few words make a text toxic.  Because zstandard does not
search the last bytes of its input, every window is followed by the same constant
bytes, which end both dictionaries.  Both dictionaries share a part trained on
ordinary text, so that common words cancel out and only the class parts differ.  The
class parts hold the words whose rate in texts of the class exceeds their rate in the
other by more than chance, the clearest ones whole and the rest as far as training keeps it; such words of the toxic
class are left out of the common part.
Texts are counted whole, on Spark; what training collects is counts and features.

A text's windows give four features: the share and the log count of windows that
the toxic dictionary explains better, and the sums of the differences.  A logistic
curve, fitted on labelled rows that the dictionaries have not seen, turns them into
a score.  Words come and go with the corpus, so nothing but bytes is used.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_fold, staged, text_or_empty, tidy

#: Constant bytes after each window and at the end of both dictionaries.
TAIL = hashlib.sha512(b"window end").digest()
#: Bytes that begin a window, so that what begins a word is told from what only occurs in words.
START = b"\x01\x02"
LONGEST = 64
MEMO = 400_000


@dataclass(frozen=True)
class Settings:
    """``labelled_rows`` and ``ordinary_rows`` bound the toxic and the ordinary labelled texts that training looks
    at, each of them whole.  Where a bound is reached, rows count for as many as there are, so that classes
    keep their shares.  ``excess``: standard deviations by which a class word's rate exceeds what both classes together have."""

    common_bytes: int = 800_000
    class_bytes: int = 8192
    level: int = 16
    labelled_rows: int = 4000
    ordinary_rows: int = 16_000
    excess: float = 2.0
    threshold: float = 0.7

    def bound(self, label: int) -> int:
        return self.labelled_rows if label else self.ordinary_rows


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    level: int


def windows(text: bytes) -> list[bytes]:
    tokens = text.lower().split()
    if any(len(t) > LONGEST for t in tokens):
        step = LONGEST // 2
        tokens = [t[i : i + LONGEST] for t in tokens for i in range(0, max(1, len(t) - step), step)]
    return tokens


class Distance(dict):
    """Bytes that a window saves with the toxic dictionary; remembers a bounded number of windows."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.toxic, self.ordinary = (
            _compressor(content, model.level) for content in (model.toxic, model.ordinary)
        )

    def __missing__(self, window: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        padded = START + window + START + TAIL
        saved = len(self.ordinary.compress(padded)) - len(self.toxic.compress(padded))
        self[window] = saved
        return saved


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False
    )


def features(text: bytes, distance: Distance) -> list[float]:
    """1, then what the windows' differences say; a text without windows has zeros."""
    found = windows(text)
    n = len(found)
    counts = Counter(map(distance.__getitem__, found))
    gain = sum(d * c for d, c in counts.items() if d > 0)
    loss = sum(-d * c for d, c in counts.items() if d < 0)
    better = sum(c for d, c in counts.items() if d > 0)
    clear = sum(c for d, c in counts.items() if d > 1)
    return [
        1.0,
        math.log1p(gain),
        math.log1p(clear),
        math.log1p(better),
        math.log1p(loss),
        10 * gain / (n + 20),
        math.log1p(n),
    ]


def score_of(found: list[float], weights: tuple[float, ...]) -> float:
    z = sum(a * b for a, b in zip(found, weights, strict=True))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _excess(words: dict[int, Counter], texts: Counter, label: int, w: bytes) -> float:
    """Standard deviations by which texts of a class hold a window more often than its share of all texts would make likely."""
    share = texts[label] / max(1, texts[0] + texts[1])
    both = words[label][w] + words[1 - label][w]
    return (words[label][w] - both * share) / math.sqrt(both * share * (1 - share) + 1)


def class_words(words: dict[int, Counter], texts: Counter, label: int, excess: float) -> set[bytes]:
    """Windows that texts of a class hold more often than its share of all texts would make likely."""
    return {w for w, n in words[label].items() if n > 1 and _excess(words, texts, label, w) >= excess}


def _class_part(excess: dict[bytes, float], size: int) -> bytes:
    """A class's windows whole, the largest excess last; where not all fit, half of the bytes are trained on the others by excess."""
    ranked = sorted(excess, key=lambda w: (-excess[w], w))
    ends = list(itertools.accumulate(len(w) + 2 for w in ranked))
    whole = bisect.bisect_right(ends, size if not ends or ends[-1] <= size else size // 2)
    kept = b"".join(b" " + w + b" " for w in reversed(ranked[:whole]))
    rest = {w: max(1, round(excess[w])) for w in ranked[whole:]}
    return (_dictionary(rest, size - size // 2) if rest else b"") + kept


def _dictionary(times: dict[bytes, int], size: int) -> bytes:
    """Dictionary content trained on each window so many times."""
    samples = [b" " + w + b" " for w in sorted(times) for _ in range(times[w])]
    random.Random(7).shuffle(samples)
    samples = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the samples themselves
        return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge; rows count ``n`` times, so the classes count as they occur."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (n * (y - p)) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on rows (text, toxic 0/1): at most so many of each class as the settings say, chosen by a hash of the text.

    A column ``weight``, if there is one, says how many rows each stands for.  Three in four rows train the
    dictionaries, the others the curve.  Without toxic rows or without ordinary ones every score is near the known class.
    """
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    rows = staged(
        labelled.where("toxic in (0, 1)").select(
            text_or_empty().cast("binary").alias("text"),
            F.col("toxic").cast("int").alias("toxic"),
            F.xxhash64("text").alias("h"),
            weight.cast("double").alias("weight"),
        ),
        "labelled",
    )
    last = {
        label: rows.where(F.col("toxic") == label).select("h").orderBy("h").limit(settings.bound(label)).agg(F.max("h")).first()[0]
        for label in (0, 1)
    }
    within = F.col("h") <= F.when(F.col("toxic") == 0, F.lit(last[0])).otherwise(F.lit(last[1]))
    # How many rows of its class a chosen one stands for.
    stands = rows.groupBy("toxic").agg((F.sum("weight") / F.count(F.when(within, 1))).alias("stands"))
    of_class = {r.toxic: r.stands for r in stands.collect()}
    chosen = rows.where(within)
    words, texts = _word_counts(chosen.where("h % 4 <> 0"), settings)
    toxic, ordinary = _dictionaries(words, texts, settings)
    model = Model(toxic, ordinary, (), settings.level)
    held = _held_features(chosen.where("h % 4 = 0"), model) or [([1.0] + [0.0] * 6, 0, 1)]
    x, y, n = (np.array(column, np.float64) for column in zip(*held, strict=True))
    n = n * np.array([of_class.get(label, 1.0) for label in y])
    return Model(toxic, ordinary, _logistic(x, y, n * len(n) / n.sum()), settings.level)


def _word_counts(rows: DataFrame, settings: Settings) -> tuple[dict[int, Counter], Counter]:
    """For each class, how many texts hold each window that dictionaries can use; and how many texts it has.

    Windows are counted and chosen on Spark.  What is collected is bounded by the dictionaries' sizes:
    each class's windows of largest excess, and the most frequent ordinary ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found.update((label, w) for w in set(windows(text.as_py())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([label for label, _ in found], pa.int32()),
                    pa.array([w for _, w in found], pa.binary()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["toxic", "window", "n"],
            )

    texts = Counter({r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()})
    counted = rows.select("text", "toxic").mapInArrow(tidy(run), "toxic int, window binary, n long")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0)).alias(f"n{label}")
    counts = staged(counted.groupBy("window").agg(of(0), of(1)), "windows")
    both = F.col("n0") + F.col("n1")
    chosen = [counts.orderBy(F.desc("n0"), "window").limit(settings.common_bytes // 6)]
    for label in (0, 1):
        share = texts[label] / max(1, texts[0] + texts[1])
        n = F.col(f"n{label}")
        excess = (n - both * share) / F.sqrt(both * (share * (1 - share)) + 1)
        most = counts.where((n > 1) & (excess > settings.excess * 0.999))
        chosen.append(most.orderBy(F.desc(excess), "window").limit(settings.class_bytes))
    words = {0: Counter(), 1: Counter()}
    for part in chosen:
        found = part.toArrow()
        for window, n0, n1 in zip(*(found.column(c) for c in ("window", "n0", "n1")), strict=True):
            words[0][window.as_py()], words[1][window.as_py()] = n0.as_py(), n1.as_py()
    return {label: +counter for label, counter in words.items()}, texts


def _dictionaries(words: dict[int, Counter], texts: Counter, settings: Settings) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary; a class's part stands before the common one."""
    own = {label: class_words(words, texts, label, settings.excess) for label in (0, 1)}
    # Common windows count as often as their number has binary digits.
    common = _dictionary({w: n.bit_length() for w, n in words[0].items() if w not in own[1]}, settings.common_bytes)
    own[0] -= set(common.split())
    parts = {
        label: _class_part({w: _excess(words, texts, label, w) for w in own[label]}, settings.class_bytes) for label in (0, 1)
    }
    return tuple((parts[label] + b" " + common).replace(b" ", START) + TAIL for label in (1, 0))


def _held_features(rows: DataFrame, model: Model) -> list[tuple[list[float], int, int]]:
    """(features, label, rows) of each distinct text, read whole."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value)
        for batch in batches:
            made = [features(t.as_py(), distance) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "h"]
            )

    found = rows.select("text", "toxic", "h").mapInArrow(tidy(run), "x array<double>, toxic int, h long")
    held = found.groupBy("toxic", "h").agg(F.first("x").alias("x"), F.count("*").alias("n")).collect()
    return [(list(r.x), r.toxic, r.n) for r in sorted(held, key=lambda r: (r.toxic, r.h))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1) from the column ``text`` (null: empty).

    A column of that name in the input is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the dictionaries' sizes
    rest = [c for c in docs.columns if c != "toxicity"]
    frame = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = frame.withColumn("toxicity", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = [
                score_of(features((t.as_py() or "").encode(), distance), shared.value.weights)
                for t in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"]
            )

    return frame.mapInArrow(tidy(run), schema)


def labelled_rows(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: int | None = None
) -> DataFrame:
    """(text, toxic, weight) of at most so many ids of each class as the settings say, outside the held-out fold.

    ``weight`` says for how many ids of its class one stands.  Ids with conflicting or missing labels are left out.  The ids are chosen by a hash from the
    labels alone, so no text is moved to find them; they are few enough to be sent to every task.
    """
    known = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .where(id_fold(F.col("doc_id"), 3) != (-2 if held_out is None else held_out))
        .select("doc_id", "toxic")
    )
    known = staged(known, "known-labels")
    have = Counter({r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()})
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [
        known.where(F.col("toxic") == k)
        .orderBy(*order)
        .limit(settings.bound(k))
        .withColumn("weight", F.lit(max(1.0, have[k] / settings.bound(k))))
        for k in (0, 1)
    ]
    chosen = F.broadcast(parts[0].union(parts[1]))  # bounded by the settings
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", "weight")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; learns from rows outside the held-out fold."""
    fold = id_fold(F.col("doc_id"), 3)
    model = train(labelled_rows(docs, labels, settings, held_out), settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold == held_out).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= settings.threshold).cast("int").alias("predicted"),
    )
