"""Hard negatives by exact scores from residue matrices (operator 12).

Vectors have integer components.  Scores of anchors with rows are inner products, computed
modulo several small primes: for each prime a float32 matrix product of residues centred at
zero, over so few components at a time that every sum stays below 2^24 and is exact.
Centred mixed-radix digits (Chinese remaindering) then give the signed score, exact as long
as the product of the primes is over twice the largest squared length (Cauchy-Schwarz).

Rows are packed into blocks, anchors into smaller ones, both staged in the shared folder.
Every pair of blocks is one row of a join over numbered groups, and yields only the
best few per anchor; the rest of the choice is a window.  A first pass finds the positives.
Their scores give each anchor's windows, in which a second pass finds the negatives.
Joins are merge joins by hint, so that no side is gathered on the driver.

A row with a null id, label or vector, or with a null or non-finite component, takes no
part; nor does one whose squared length reaches 2^61, since its scores would not fit a long.  Shorter
vectors count as padded with zeros.  Repeated rows are rows of their own: a copy of an
anchor is an anchor and can be a positive.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, staged

#: Largest first; eight of them reach 2^62.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: Squares of centred residues are below 2^14, so so many products stay below 2^24.
SPAN = 1024
LARGEST = 2.0**61


@dataclass(frozen=True)
class Settings:
    """Negatives have a score from ``low`` to ``high`` percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    block_rows: int = 16_384
    anchor_rows: int = 512
    group_bytes: int = 16 << 20


def primes_for(bound: float) -> tuple[int, ...]:
    """The fewest primes whose product is over twice the bound."""
    for k in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:k]) > 2 * bound + 2:
            return PRIMES[:k]
    raise ValueError(f"scores up to {bound:.0f} do not fit a long")


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    rest = values % prime
    return rest - prime * (rest > prime // 2)


def residue_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of the integer rows of ``a`` with those of ``b``, as int64."""
    digits: list[np.ndarray] = []
    for at, prime in enumerate(primes):
        x, y = (centred(m, prime).astype(np.float32) for m in (a, b))
        digit = np.zeros((len(a), len(b)), np.int32)
        for i in range(0, max(1, x.shape[1]), SPAN):
            digit += (x[:, i : i + SPAN] @ y[:, i : i + SPAN].T).astype(np.int32) % prime
        for before, earlier in zip(digits, primes[:at], strict=True):
            digit = (digit - before) * pow(earlier, -1, prime) % prime
        digits.append(centred(digit, prime))
    score = digits[-1].astype(np.int64)
    for digit, prime in zip(digits[-2::-1], primes[-2::-1], strict=True):
        score = score * prime + digit
    return score


def _integers(vector: list | None, scale: int) -> np.ndarray | None:
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore"):
        v = np.floor(np.asarray(vector, np.float64) * scale)
        return v.astype(np.int64) if (v * v).sum() < LARGEST else None  # false for a sum that is not a number


BLOCK = "block long, n int, dims int, largest double, ids binary, labels binary, parts binary, anchors binary"


def packed(rows: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of (vec_id, embedding, label, is_anchor) rows: ids, labels and components as bytes, row after row.

    ``largest`` is the largest squared length; ``block`` times 2^20 plus the place in it numbers a row.
    Labels are numbered by their 64-bit value.
    """
    frame = rows.where("vec_id is not null and label is not null and embedding is not null").select(
        F.spark_partition_id().alias("part"), F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", "is_anchor"
    )

    def block(key: int, ids: list, labels: list, vectors: list, anchors: list) -> tuple:
        dims = max(len(v) for v in vectors)
        parts = np.zeros((len(vectors), dims), np.int64)
        for row, v in zip(parts, vectors, strict=True):
            row[: len(v)] = v
        largest = float((parts.astype(np.float64) ** 2).sum(1).max())
        as_bytes = lambda values, kind: np.asarray(values, kind).tobytes()
        return (
            key, len(ids), dims, largest, as_bytes(ids, np.int64), as_bytes(labels, np.int64), as_bytes(parts, np.int32),
            as_bytes(anchors, bool),
        )

    def batch_of(blocks: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
        columns = [pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        part, made = 0, 0
        for batch in batches:
            ids, labels, anchors = (batch.column(i).to_pylist() for i in (1, 2, 4))
            for i, vector in enumerate(batch.column(3)):
                found = _integers(vector.as_py(), settings.scale)
                if found is None:
                    continue
                for values, value in zip(held, (ids[i], labels[i], found, anchors[i]), strict=True):
                    values.append(value)
                part = batch.column(0)[i].as_py()
                if len(held[0]) == settings.block_rows:
                    yield batch_of([block((part << 20) + made, *held)])
                    held, made = ([], [], [], []), made + 1
        if held[0]:
            yield batch_of([block((part << 20) + made, *held)])

    return frame.mapInArrow(run, BLOCK)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["parts"], np.int32).reshape(row["n"], row["dims"]).astype(np.int64)


ANCHORS = "chunk long, a_n int, a_dims int, a_keys binary, a_ids binary, a_labels binary, a_parts binary"


def anchor_chunks(blocks: DataFrame, settings: Settings) -> DataFrame:
    """The anchors of each block, few at a time, with their row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                parts = np.frombuffer(row["parts"], np.int32).reshape(row["n"], row["dims"])
                for k in range(0, len(places), settings.anchor_rows):
                    at = places[k : k + settings.anchor_rows]
                    keys = (row["block"] << 20) + at
                    values = [int(keys[0]), len(at), row["dims"], *(c.tobytes() for c in (keys, ids[at], labels[at], parts[at]))]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                    columns = [pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANCHORS.split(", ")])

    return blocks.select("block", "n", "dims", "ids", "labels", "parts", "anchors").mapInArrow(run, ANCHORS)


def _first(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of the places with the highest scores, ties by smaller id."""
    if len(places) > k:
        s = scores[places]
        places = places[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _pairs(blocks: DataFrame, chunks: DataFrame, groups: int) -> DataFrame:
    """Every block next to every chunk: blocks are dealt over groups, each group gets all chunks.

    Chunks hold the anchors only, the small side; a group is some blocks, so what is sent stays a
    fraction of the scores that are computed from it.  Spark's estimate of the copies leaves out how many
    there are, so it would broadcast them at any number of groups.
    """
    dealt = blocks.drop("anchors").withColumn("dealt", F.pmod(F.xxhash64("block"), F.lit(groups)))
    copies = chunks.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return copies.hint("merge").join(dealt, "dealt")


CANDIDATE = "chunk long, anchor long, anchor_id long, slot int, row long, vec_id long, score long"


def _candidates(pairs: DataFrame, primes: tuple[int, ...], settings: Settings, windows: bool) -> DataFrame:
    """For each anchor the first positives of a block, or for each of its windows the first negatives."""
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    step = max(1, (1 << 21) // settings.block_rows)

    def chosen(row: dict) -> Iterator[tuple]:
        ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        keys, a_ids, a_labels = (np.frombuffer(row[c], np.int64) for c in ("a_keys", "a_ids", "a_labels"))
        b = _matrix(row)
        a = np.frombuffer(row["a_parts"], np.int32).reshape(row["a_n"], row["a_dims"]).astype(np.int64)
        shared = min(a.shape[1], b.shape[1])
        a, b = a[:, :shared], b[:, :shared]
        own = keys - (row["block"] << 20)  # places of anchors that are rows of this block
        wanted: dict[int, list] = {}
        for w in row["windows"] or [] if windows else []:
            wanted.setdefault(w["anchor"], []).append((w["slot"], w["score"]))
        for i in range(0, len(a), step):
            scores = residue_scores(a[i : i + step], b, primes)
            for at, s in enumerate(scores, i):
                same = labels == a_labels[at]
                head = (row["chunk"], int(keys[at]), int(a_ids[at]))
                if not windows:
                    if 0 <= own[at] < len(ids):
                        same[own[at]] = False
                    found = _first(s, ids, np.flatnonzero(same), settings.positives)
                    yield from ((*head, 0, (row["block"] << 20) + int(p), int(ids[p]), int(s[p])) for p in found)
                    continue
                for slot, score in wanted.get(head[1], ()):
                    low, high = -(-settings.low * score // 100), settings.high * score // 100
                    places = np.flatnonzero(~same & (s >= low) & (s <= high)) if low <= high else ids[:0]
                    found = _first(s, ids, places, settings.negatives)
                    yield from ((*head, slot, (row["block"] << 20) + int(p), int(ids[p]), int(s[p])) for p in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(chosen(batch.slice(i, 1).to_pylist()[0]))
                columns = zip(*found, strict=True) if found else [()] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n == "slot" else pa.int64()) for c, n in zip(columns, names, strict=True)],
                    names=names,
                )

    return pairs.mapInArrow(run, CANDIDATE)


def _ranked(candidates: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, embedding, label).

    An anchor's positives are the first other rows of its label.  For each, the first rows of other labels with
    a score in its window follow.  Higher scores come first, ties by smaller vec_id.
    """
    if settings.block_rows > 1 << 20:
        raise ValueError("a block holds 2^20 rows at most")
    spark = rows.sparkSession
    marked = rows.select("vec_id", "embedding", "label", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    blocks = staged(packed(marked, settings), "vector-blocks")
    size = blocks.agg(F.max("largest").alias("largest"), F.sum(F.length("parts")).alias("bytes"), F.count("*").alias("n")).first()
    primes = primes_for(size.largest or 0.0)
    groups = max(partitions(spark), math.ceil((size.bytes or 0) / settings.group_bytes))
    groups = max(1, min(groups, 2 * size.n))  # a group without a block gets all chunks too
    chunks = staged(anchor_chunks(blocks, settings), "anchor-chunks")
    near = _candidates(_pairs(blocks, chunks, groups), primes, settings, windows=False)
    positives = staged(_ranked(near, settings.positives, "anchor").withColumn("slot", F.col("rank")), "positives")
    windows = positives.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("windows"))
    far = _candidates(_pairs(blocks, chunks.join(windows.hint("merge"), "chunk"), groups), primes, settings, windows=True)
    ranked = _ranked(far, settings.negatives, "anchor", "slot")
    found = positives.select("anchor", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(found.hint("merge"), ["anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows whose vec_id is divisible by 7 with the next of the ten labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.withColumn("label", label)


SQL = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           coalesce(CAST(list_sum(list_transform(list_zip(a.parts, b.parts), lambda p: p[1] * p[2])) AS BIGINT), 0) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
                              AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
