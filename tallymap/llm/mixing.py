"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Token counts are folded to cells (source, language, topic).  Each round scales the
cells so that one margin after the other meets its target shares, until all do; then
a cell's fitted mass over its tokens is its documents' weight.  Documents are then
drawn independently with a probability in proportion to the weight, decided by a
hash of the row, so that a draw can be repeated.  Cells are few against documents
but may be many (one per web host), so they stay a table that no step rewrites: a round makes one
small table of factors for all margins, from sums that are combined before the shuffle.  Values of margins are numbered
first, so that a plan's joins are on whole numbers and small, and the driver holds few of them.
Every text is measured once, into a staged table that topics, cells and draws all read.

Topics are clusters of whole texts by their words: log counts of hashed words, weighted by
how rare they are.  Texts become vectors when they are measured, a block of texts at a time; rarity and the eight centres are
then fitted on the vectors of all rows: these are packed in blocks, and a pass over that staged table, which weighs them,
follows for each centre and each round.
Weights are whole steps, so that sums are exact and a fit does not depend on how rows are dealt out.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import staged, text_or_empty, tidy

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Classes that words are hashed to, for topics.
BUCKETS = 2048
#: Words over this length, as in texts without blanks, count as their pairs of characters.
LONGEST = 24
#: What is not part of a word at its ends.
MARKS = ".,;:!?\"'()[]"
#: A text's vector: classes of words found and log(1 + count).
WORDS = np.dtype([("at", "<u2"), ("log", "<f4")])
#: Steps that vectors of length one and centres are rounded to; products of two still sum exactly in a double.
ONE = float(1 << 24)
#: Rows that are measured, packed and spelled out together.
BLOCK = 128
#: A block of vectors, in columns: hashes, numbers of entries, classes, the distinct logs, and for each entry the place of its log.
PACKED = {"rows": np.dtype("<i8"), "sizes": np.dtype("<i4"), "at": np.dtype("<u2"), "logs": np.dtype("<f4"), "code": None}
#: White space besides ASCII's six.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACES, _MARKS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \t\n\v\f\r", MARKS.encode()))
#: crc32 of single bytes, from which that of longer strings follows.
_CRC = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


class _Buckets(dict):
    """The class of a single word; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.strip(MARKS).encode("utf-8", "replace")) % BUCKETS
        return bucket


def word_counts(text: str, buckets: _Buckets) -> np.ndarray:
    """How often each class of words occurs in a text, by the rule as it is; ``measure`` does the same for many texts at once."""
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [
            part
            for word in words
            for part in ([word] if len(word) <= LONGEST else (word[i : i + 2] for i in range(len(word) - 1)))
        ]
    return np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)


def _within(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each of the ranges, spelled out."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _classes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The classes of many words at once, as ``_Buckets`` has them: crc32 of the bytes ``data[start:end]`` without marks around them."""
    start, end = start.copy(), end.copy()
    live = np.arange(len(start))
    while len(live := live[(start[live] < end[live]) & _MARKS[data[start[live]]]]):
        start[live] += 1
    live = np.arange(len(start))
    while len(live := live[(start[live] < end[live]) & _MARKS[data[end[live] - 1]]]):
        end[live] -= 1
    size = (end - start).astype(np.uint16)  # 24 characters at most
    longest_last = np.argsort(size, kind="stable")
    size, start = size[longest_last], start[longest_last]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[-1]) if len(size) else 0):  # the byte k of every word that has one
        first = int(np.searchsorted(size, k, "right"))
        now = crc[first:]
        crc[first:] = _CRC[(now ^ data[start[first:] + k]) & 0xFF] ^ (now >> 8)
    out = np.empty(len(size), np.int64)
    out[longest_last] = ~crc % BUCKETS
    return out


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; and the entries (``WORDS``) of all, with the number of each text's; counts as ``word_counts`` has them.

    Tokens are separated by ASCII white space, words by all of it; a text has one token at least.
    """
    lowered, tokens = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        low = text.lower()
        if _ODD_SPACE.search(text):
            tokens[i] = len(text.encode("utf-8", "replace").split())
            low = " ".join(low.split())
        lowered.append(low.encode("utf-8", "replace"))
    data = np.frombuffer(b"\n".join([b"", *lowered, b""]), np.uint8)
    space = _SPACES[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    borders = np.cumsum([len(low) + 1 for low in lowered])
    row = np.searchsorted(borders, start, "right")
    tokens = np.maximum(1, np.where(tokens > 0, tokens, np.bincount(row, minlength=len(texts))))
    cut = end - start > LONGEST  # bytes so far, of which a character may have several
    if cut.any():
        leads = _within(start[cut], end[cut] + 1 - start[cut])
        leads = leads[(data[leads] & 0xC0) != 0x80]
        cut[cut] = np.searchsorted(leads, end[cut]) - np.searchsorted(leads, start[cut]) > LONGEST
        first = np.searchsorted(leads, start[cut])
        pairs = np.searchsorted(leads, end[cut]) - first - 1
        at = _within(first, pairs)
        row = np.concatenate((row[~cut], np.repeat(row[cut], pairs)))
        start, end = np.concatenate((start[~cut], leads[at])), np.concatenate((end[~cut], leads[at + 2]))
    counts = np.bincount(row * BUCKETS + _classes(data, start, end), minlength=len(texts) * BUCKETS)
    at = np.flatnonzero(counts)
    found = np.empty(len(at), WORDS)
    found["at"], found["log"] = at % BUCKETS, np.log1p(counts[at])
    return tokens, found, np.bincount(at // BUCKETS, minlength=len(texts))


def measures_of(text: Column) -> Column:
    """Of the whole text: ``tokens``, its white-space separated words, at least one; and ``words``, its vector as bytes of ``WORDS``."""

    @F.arrow_udf("tokens long, words binary")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            tokens, sizes, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for start in range(0, len(batch), BLOCK):
                of_block = measure(batch.slice(start, BLOCK).to_pylist())
                tokens.append(of_block[0])
                found.append(of_block[1].tobytes())
                sizes.append(of_block[2])
            ends = WORDS.itemsize * np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            words = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(found))]
            vectors = pa.Array.from_buffers(pa.binary(), len(batch), words)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), vectors], names=["tokens", "words"])

    return counted(text)


def weighed(sizes: np.ndarray, at: np.ndarray, log: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the weight of each entry, in steps of 1 / ``ONE``, from rows' numbers of entries and what the entries hold."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    weight = log * rarity[at]
    length = np.sqrt(np.bincount(row, weight * weight, len(sizes)))
    return row, np.rint(ONE * weight / np.where(length > 0, length, 1)[row])


def _entries(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of entries of each row; and the entries of all."""
    return np.array([len(r) // WORDS.itemsize for r in rows], np.int64), np.frombuffer(b"".join(rows), WORDS)


class _Alike:
    """Products of rows with centres; at most ``BLOCK`` rows at a time are spelled out."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = np.ascontiguousarray(centres.T)
        self.spelled = np.zeros((BLOCK, BUCKETS))

    def __call__(self, n: int, row: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place = row * BUCKETS + at
        flat = self.spelled.reshape(-1)
        flat[place] = weight
        alike = self.spelled[:n] @ self.centres
        flat[place] = 0
        return alike


@dataclass(frozen=True)
class Topics:
    """``rarity``: weight of each class of words; ``centres``: a row of length ``ONE`` for each topic."""

    rarity: np.ndarray
    centres: np.ndarray

    def of(self, column: pa.Array) -> pa.Array:
        """The nearest centre of every row, the first one of equals."""
        alike = _Alike(self.centres)
        nearest = [np.empty(0, np.int64)]
        for start in range(0, len(column), BLOCK):
            sizes, found = _entries(column.slice(start, BLOCK).to_pylist())
            row, weight = weighed(sizes, found["at"], found["log"], self.rarity)
            nearest.append(np.argmax(alike(len(sizes), row, found["at"], weight), axis=1))
        return pa.array(np.concatenate(nearest), pa.int32())


def _sums(rows: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int) -> np.ndarray:
    """The sum over all tasks of the whole numbers, ``width`` for each class of words, that each one makes of its rows."""
    names = [f"n{k}" for k in range(width)]

    def run(batches):  # noqa: ANN001, ANN202
        made = of(batches).astype(np.int64)
        at = np.flatnonzero(made.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(n[at]) for n in made)], names=["at", *names])

    parts = rows.mapInArrow(tidy(run), ", ".join(["at int", *(f"{n} long" for n in names)]))
    found = parts.groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    whole = np.zeros((width, BUCKETS))
    for k, n in enumerate(names):
        whole[k, found["at"].to_numpy()] = found[n].to_numpy()
    return whole


def _once(rows: DataFrame) -> DataFrame:
    """Each of equal rows (``mix_row``) once; where few repeat, none but those are shuffled."""
    repeated = staged(rows.groupBy("mix_row").count().where("count > 1").select("mix_row"), "repeated")
    several = rows.join(repeated, "mix_row", "left_semi").dropDuplicates(["mix_row"])
    return rows.join(repeated, "mix_row", "left_anti").unionByName(several)


def _packed(words: DataFrame) -> DataFrame:
    """Vectors, some rows' together in one (``PACKED``): an entry's log is sent as its place among the block's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                few = batch.slice(start, BLOCK)
                sizes, found = _entries(few.column(0).to_pylist())
                logs = np.unique(found["log"])
                code = np.searchsorted(logs, found["log"]).astype(_code_type(logs))
                made = [few.column(1).to_numpy(), sizes.astype(np.int32), found["at"], logs, code]
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], names=list(PACKED))

    return words.select("mix_words", "mix_row").mapInArrow(tidy(run), ", ".join(f"{n} binary" for n in PACKED))


def _code_type(logs: np.ndarray) -> np.dtype:
    """The type of places among a block's distinct logs."""
    return np.min_scalar_type(max(0, len(logs) - 1))


def _unpacked(batches: Iterator[pa.RecordBatch], rarity: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Hashes of some rows at a time; and the row, class and weight of each of their entries."""
    for batch in batches:
        for i in range(batch.num_rows):
            *cells, code = (batch.column(k)[i].as_buffer() for k in range(len(PACKED)))
            hashes, sizes, at, logs = (np.frombuffer(cell, kind) for cell, kind in zip(cells, PACKED.values(), strict=False))
            row, weight = weighed(sizes, at, logs[np.frombuffer(code, _code_type(logs))], rarity)
            yield hashes, row, at, weight


def _rarity(packed: DataFrame) -> np.ndarray:
    """The weight of each class of words, by the number of all rows that have it."""

    def rows_with(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros((1, BUCKETS), np.int64)
        for batch in batches:
            for cell in batch.column(0):
                n[0] += np.bincount(np.frombuffer(cell.as_buffer(), PACKED["at"]), minlength=BUCKETS)
        return n

    rows = (packed.agg(F.sum(F.length("rows"))).first()[0] or 0) // PACKED["rows"].itemsize
    return np.log((1 + rows) / (1 + _sums(packed.select("at"), rows_with, 1)[0]))


def _far(packed: DataFrame, centres: np.ndarray, rarity: np.ndarray) -> np.ndarray | None:
    """The vector least like the known centres, of equals the row of the smallest hash; rows without a weight are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, best = _Alike(centres), None
        for hashes, row, at, weight in _unpacked(batches, rarity):
            some = np.flatnonzero(np.bincount(row, weight, len(hashes)))
            if len(some):
                near = np.round(products(len(hashes), row, at, weight).max(axis=1, initial=0) / ONE**2, 9)
                first = some[np.lexsort((hashes[some], near[some]))[0]]
                here = (float(near[first]), int(hashes[first]))
                if best is None or here < best[0]:
                    part = row == first
                    best = here, at[part].tobytes(), weight[part].astype(np.int32).tobytes()
        if best is not None:
            (near, h), at, weight = best
            made = [pa.array([near]), pa.array([h], pa.int64()), pa.array([at], pa.binary()), pa.array([weight], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["near", "h", "at", "weight"])

    drawn = packed.mapInArrow(tidy(run), "near double, h long, at binary, weight binary")
    found = drawn.orderBy("near", "h").first()
    if found is None:
        return None
    centre = np.zeros(BUCKETS)
    centre[np.frombuffer(found["at"], PACKED["at"])] = np.frombuffer(found["weight"], np.int32)
    return centre


def fit_topics(measured: DataFrame, rounds: int = 20) -> Topics:
    """Spherical k-means on the vectors (``mix_words``) of all rows, equal rows once; begins with texts far from each other.

    Rounds end when no centre moves.
    """
    packed = staged(_packed(_once(measured.select("mix_row", "mix_words"))), "packed")
    rarity = _rarity(packed)
    centres = np.zeros((0, BUCKETS))
    while len(centres) < TOPICS and (centre := _far(packed, centres, rarity)) is not None:
        centres = np.vstack([centres, centre])
    if not len(centres):
        return Topics(rarity, np.zeros((1, BUCKETS)))
    for _ in range(rounds):

        def members(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> np.ndarray:
            products, whole = _Alike(centres), np.zeros(centres.size)
            for hashes, row, at, weight in _unpacked(batches, rarity):
                nearest = np.argmax(products(len(hashes), row, at, weight), axis=1)
                whole += np.bincount(nearest[row] * BUCKETS + at, weight, whole.size)
            return whole.reshape(centres.shape)

        sums = _sums(packed, members, len(centres))
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(length > 0, np.rint(ONE * sums / np.where(length > 0, length, 1)), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return Topics(rarity, centres)


def topic_of(words: Column, topics: Topics) -> Column:
    """The topic of the whole text that has this vector."""
    shared = SparkSession.active().sparkContext.broadcast(topics)

    @F.arrow_udf("int")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield shared.value.of(batch)

    return nearest(words)


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin: token shares raised to ``power`` (1 keeps them, 0 makes them equal)."""
    totals = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("n"))
    raised = totals.withColumn("n", F.pow("n", F.lit(power)))
    whole = raised.agg(F.sum("n")).first()[0] or 1.0
    return raised.select(margin, (F.col("n") / whole).alias("target"))


def _coded(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Cells with their share of all tokens; and for each margin the number of its value (``_<margin>``) and the value's target."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    coded = cells.withColumn("_share", F.col("tokens") / total)
    for margin, target in targets.items():
        wanted = F.col("target").cast("double").alias(f"_target_{margin}")
        known = target.where("target > 0").select(F.col(margin).alias("_known"), wanted)
        values = cells.select(F.col(margin).alias("_value")).distinct().join(known, F.col("_value").eqNullSafe(F.col("_known")), "left")
        numbered = staged(values.select("_value", f"_target_{margin}", F.monotonically_increasing_id().alias(f"_{margin}")), "values")
        coded = coded.join(numbered, F.col(margin).eqNullSafe(F.col("_value"))).drop("_value")
    return staged(coded, "coded")


def _with_factors(coded: DataFrame, factors: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """Coded cells with each margin's factor (``_factor_<margin>``); and their share times all factors."""
    mass = F.col("_share")
    for margin, table in factors.items():
        named = table.select(F.col("number").alias(f"_{margin}"), F.col("factor").alias(f"_factor_{margin}"))
        coded = coded.join(named, f"_{margin}")
        mass = mass * F.col(f"_factor_{margin}")
    return coded, mass


def _scaled(coded: DataFrame, factors: dict[str, DataFrame], margin: str) -> DataFrame:
    """(margin, number, factor, gap): of each value, the factor that meets its target, and how far its share was from that."""
    cells, mass = _with_factors(coded, factors)
    factor = F.first(f"_factor_{margin}") if margin in factors else F.lit(1.0)
    share, target = F.sum(mass), F.first(f"_target_{margin}")
    wanted = F.coalesce(target, share)
    return cells.groupBy(F.col(f"_{margin}").alias("number")).agg(
        F.lit(margin).alias("margin"), (factor * wanted / share).alias("factor"), F.abs(wanted - share).alias("gap")
    )


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, tolerance: float = 1e-9
) -> DataFrame:
    """``cells`` (margins..., tokens) with ``fitted``: mass in shares of 1 that meets the targets.

    A margin value without a target keeps its share; targets of absent values are spread over the others.
    Rounds end when no share is off by more than ``tolerance``; ``residual`` is how far the worst one was before its last
    scaling, which stays large where targets cannot be met together.  No cells give none.

    A round is one job: margin after margin is scaled within one plan, whose parts share their joins and sums.
    """
    coded = _coded(cells, targets)
    if coded.isEmpty():
        return cells.select("*", F.lit(0.0).alias("fitted"), F.lit(0.0).alias("residual"))
    factors: dict[str, DataFrame] = {}
    worst = 0.0
    for _ in range(rounds):
        parts = []
        for margin in targets:
            factors[margin] = _scaled(coded, factors, margin)
            parts.append(factors[margin])
        gaps = Observation()
        made = staged(functools.reduce(DataFrame.unionAll, parts).observe(gaps, F.max("gap").alias("worst")), "factors")
        factors = {margin: made.where(F.col("margin") == margin) for margin in targets}
        worst = gaps.get["worst"] or 0.0
        if worst <= tolerance:
            break
    found, mass = _with_factors(coded, factors)
    norm = found.agg(F.sum(mass)).first()[0] or 1.0
    return found.select(*cells.columns, (mass / norm).alias("fitted"), F.lit(worst).alias("residual"))


def calibrate(fitted: DataFrame, keep: float) -> float:
    """The factor on weights for which the expected share of tokens kept is ``keep``, to one percent."""
    factors = [keep * 1.01**k for k in range(1200)]
    total = F.sum("tokens").cast("double")
    weight = lambda f: F.least(F.col("tokens").cast("double"), F.col("fitted") * F.col("_all") * f)
    all_tokens = float(fitted.agg(total).first()[0] or 1)
    cells = fitted.withColumn("_all", F.lit(all_tokens))
    low, high = 0, len(factors) - 1
    while low < high:  # 8 steps a pass: the sums of eight factors in one look at the cells
        tried = sorted({low + (high - low) * k // 9 for k in range(1, 9)})
        sums = cells.agg(*(F.sum(weight(factors[k])) for k in tried)).first()
        below = [k for k, v in zip(tried, sums, strict=True) if (v or 0) < keep * all_tokens]
        above = [k for k in tried if k not in below]
        low, high = (below[-1] + 1 if below else low), (above[0] if above else high)
    return factors[low]


ADDED = ("tokens", "topic", "mix_row", "mix_words", "mix_draw", "mix_weight", "mix_residual", "mix_probability", "mix_kept")


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with tokens, the row's hash, vector and draw from 0 to 1, in place of columns of the added names."""
    text = text_or_empty()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), text, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    row = F.xxhash64(F.col("doc_id").cast("string"), text).alias("mix_row")
    rows = docs.select(*own, row, measures_of(text).alias("mix_words"), draw.alias("mix_draw"))
    tokens, words = (F.col("mix_words")[part].alias(name) for part, name in (("tokens", "tokens"), ("words", "mix_words")))
    return rows.select(*own, tokens, "mix_row", words, "mix_draw")


def _placed(rows: DataFrame) -> DataFrame:
    """Measured rows with their topic in place of hash and vector."""
    topic = topic_of(F.col("mix_words"), fit_topics(rows)).alias("topic")
    return rows.select(*(topic if c == "mix_words" else F.col(f"`{c}`") for c in rows.columns if c != "mix_row"))


def _drawn(rows: DataFrame, targets: dict[str, DataFrame] | None, keep: float, power: float) -> DataFrame:
    """Rows with a topic, with their weight, probability and whether the draw keeps them."""
    cells = staged(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "margins")
    targets = targets or {m: tempered(cells, m, power) for m in MARGINS}
    fitted = staged(rake(cells, targets), "fitted")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    factor = calibrate(fitted, keep)
    weights = fitted.select(
        *MARGINS, (F.col("fitted") * total / F.col("tokens")).alias("mix_weight"), F.col("residual").alias("mix_residual")
    )
    same = [F.col(f"rows.{m}").eqNullSafe(F.col(f"weights.{m}")) for m in MARGINS]
    joined = rows.alias("rows").join(weights.alias("weights"), same[0] & same[1] & same[2])
    probability = F.least(F.lit(1.0), F.col("mix_weight") * factor)
    return joined.select(
        *(F.col(f"rows.`{c}`") for c in rows.columns if c != "mix_draw"),
        "mix_weight",
        "mix_residual",
        probability.alias("mix_probability"),
        (F.col("mix_draw") < probability).alias("mix_kept"),
    )


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    keep: float = 0.5,
    power: float = 0.7,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with ``tokens``, ``topic``, ``mix_weight``, ``mix_residual``, ``mix_probability`` and ``mix_kept``.

    ``targets`` maps margins to shares; without them shares are tempered token shares.  ``mix_residual`` says how
    far the worst share is from its target.  The expected number of tokens kept is ``keep`` of all: where weights are so
    large that their documents are all taken, the others' probabilities rise.

    Null margins are a value of their own; a null text is an empty one and has one token; columns of the added
    names (``ADDED``) are replaced; equal rows share one draw; an empty table gives an empty one.
    """
    return _drawn(_placed(staged(_measured(docs, seed), "measured")), targets, keep, power)


def mixing_report(docs: DataFrame) -> DataFrame:
    """(doc_id, margins, tokens, weight, probability, kept) for every document; what is staged holds no text.

    Cases as in ``mix``.
    """
    rows = staged(_measured(docs, 0).select("doc_id", "source", "lang", "tokens", "mix_row", "mix_words", "mix_draw"), "measured")
    return _drawn(staged(_placed(rows), "placed"), None, 0.5, 0.7).select(
        "doc_id", *MARGINS, "tokens", "mix_weight", "mix_probability", "mix_kept"
    )
