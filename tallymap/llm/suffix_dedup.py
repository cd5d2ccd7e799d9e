"""Removal of repeated byte strings with a Burrows-Wheeler transform (operator 2).

A byte goes if a string of ``least`` bytes covers it that starts at another place of
the corpus too.  Texts are compared in three steps.

1. Every window of ``least`` bytes has a key: the smallest hash of its k-grams.  Equal
   windows have equal keys.  Windows in a row with one key form a run; a run's key,
   place and content hash are all that is shuffled.  Keys with a single run and no
   repeat inside are done; where all runs of a key have the same content, every window
   of them is repeated.
2. For the other keys the runs' bytes are gathered, equal ones once, by key.  A task
   takes some keys at a time, joins their runs with a separator each, sorts the suffixes
   and finds their common prefixes by interval expansion on the Burrows-Wheeler transform:
   breadth first, an interval of the suffixes that begin with a string is extended to the
   left by each byte before it, and the extension's end gets the string's length as common
   prefix unless it has one.  Lengths come out in increasing order; the search stops at
   ``least``, and boundaries without a value are the repeats.
   Runs of a key with more than ``HOT`` bytes are not sorted together: their windows are
   dealt on by a digest of their content, counted, and those that occur twice are repeats.
3. Repeated windows go back to their texts as spans, which are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .setsketch import _BYTES, MIX, _powers, mix
from .shared import digest16, few_rows, partitions, staged, text_or_empty, tidy

U = np.uint64
LEAST = 200
GRAM = 32
#: Bytes of a text that are hashed at once; runs end at these borders.
CHUNK = 1 << 22
#: Bytes of runs whose suffixes are sorted together (a single key may have more).
BATCH = 1 << 16
#: Bytes of one key's runs from which their windows are dealt on by content.
HOT = 1 << 22
#: Columns that are set beside a caller's while spans are looked up.
HELPERS = ("_node", "_spans")
#: Windows of a run that are handed on at once.
WINDOWS = 1 << 14


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: U) -> np.ndarray:
    """``pick`` over every ``width`` values in a row: running values of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width + width, fill, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def runs(text: bytes, least: int = LEAST, gram: int = GRAM) -> np.ndarray:
    """Runs of windows with equal keys: columns start, windows, key, content hash, repeats inside (0/1)."""
    out = [np.empty((0, 5), np.int64)]
    for at in range(0, max(0, len(text) - least + 1), CHUNK):
        out.append(_runs(np.frombuffer(text[at : at + CHUNK + least - 1], np.uint8), at, least, gram))
    return np.concatenate(out)


def _runs(data: np.ndarray, offset: int, least: int, gram: int) -> np.ndarray:
    n, width = len(data), least - gram + 1
    up, down = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[data] * up[:n], dtype=U)))
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    keys = _sliding(grams, width, np.minimum, ~U(0))
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    ends = np.concatenate((starts[1:], [len(keys)]))  # windows [start, end)
    key = keys[starts]
    whole = mix((sums[ends + least - 1] - sums[starts]) * down[starts] + (ends - starts).astype(U) * MIX[2])
    # Where a run's smallest k-gram stands: twice means that the run may repeat inside.
    around = np.concatenate((np.zeros(width - 1, U), keys, np.zeros(width - 1, U)))
    places = np.flatnonzero(grams == _sliding(around, width, np.maximum, U(0)))
    values = grams[places]
    first = np.searchsorted(places, starts)
    last = np.searchsorted(places, ends + width - 1)
    seen = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    step = 0
    while len(live):
        live = live[(first[live] + step < last[live]) & (seen[live] < 2)]
        seen[live] += values[first[live] + step] == key[live]
        step += 1
    return np.stack(
        (starts + offset, ends - starts, key.view(np.int64), whole.view(np.int64), (seen > 1).astype(np.int64)), axis=1
    )


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols, two or three times as many each round; and their places."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank)
    width = 1
    bits = n.bit_length()
    parts = 3 if 3 * bits < 63 else 2  # so many ranks fit into one sorting key
    while width < depth and rank.max() < n - 1:
        key = rank + 1
        for k in range(1, parts):
            key <<= bits
            key[: max(0, n - k * width)] += rank[k * width :] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= parts
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def repeated_prefixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """Positions whose next ``least`` symbols also start elsewhere."""
    n = len(symbols)
    order, place = suffix_order(symbols, least)
    # Where the suffix one symbol longer stands.
    back = place[order - 1]
    heads = symbols[order]
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        sizes = high - low
        if not len(sizes):
            break
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        to = back[inside]
        by = np.argsort(to)
        to, owner = to[by], owner[by]
        head = heads[to]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (head[1:] != head[:-1])) + 1
        lows = to[np.concatenate(([0], cut))]
        highs = to[np.concatenate((cut - 1, [len(to) - 1]))] + 1
        fresh = common[highs] < 0
        low, high = lows[fresh], highs[fresh]
        common[high] = length
        by = np.argsort(low)
        low, high = low[by], high[by]
    same = np.flatnonzero(common[1:n] < 0)
    return np.union1d(order[same], order[same + 1])


def repeats_of(contents: list[bytes], often: list[bool], least: int = LEAST) -> list[np.ndarray]:
    """For each run's bytes, the windows (offsets) that occur elsewhere in the runs or, if ``often``, all."""
    sizes = np.array([len(c) for c in contents])
    symbols = np.empty(sizes.sum() + len(contents), np.int32)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[ends] = np.arange(len(contents))
    symbols[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int32) + len(contents)
    found = repeated_prefixes(symbols, least)
    begins = ends - sizes
    which = np.searchsorted(ends, found)
    out = []
    borders = np.searchsorted(which, np.arange(len(contents) + 1))
    for i, always in enumerate(often):
        if always:
            out.append(np.arange(sizes[i] - least + 1))
        else:
            out.append(found[borders[i] : borders[i + 1]] - begins[i])
    return out


def _ranges(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each row of consecutive offsets."""
    if not len(offsets):
        return offsets, offsets
    cut = np.flatnonzero(np.diff(offsets) != 1) + 1
    return offsets[np.concatenate(([0], cut))], offsets[np.concatenate((cut - 1, [len(offsets) - 1]))]


def _texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(digest16(text).alias("node"), text.cast("binary").alias("text"))


def _all_runs(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs(t.as_py(), least) for t in batch.column(1)]
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made])))
            found = np.concatenate([np.empty((0, 5), np.int64), *made])
            yield pa.RecordBatch.from_arrays(
                [nodes, *(pa.array(found[:, i]) for i in range(5))],
                names=["node", "start", "windows", "key", "seg", "inner"],
            )

    return _texts(docs).where(F.length("text") >= least).mapInArrow(
        tidy(run), "node binary, start long, windows long, key long, seg long, inner long"
    )


def _contents(docs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """(key, seg, content) of the marked runs, as often as rows have them."""
    wanted = marks.groupBy("node").agg(F.collect_set(F.struct("start", "windows", "key", "seg")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            keys, segs, contents = [], [], []
            for text, found in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py()
                for r in found.as_py():
                    keys.append(r["key"])
                    segs.append(r["seg"])
                    contents.append(data[r["start"] : r["start"] + r["windows"] + least - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(segs, pa.int64()), pa.array(contents, pa.binary())],
                names=["key", "seg", "content"],
            )

    joined = _texts(docs).where(F.length("text") >= least).join(wanted, "node").select("text", "runs")
    return joined.mapInArrow(tidy(run), "key long, seg long, content binary")


def _compare(contents: DataFrame, least: int) -> DataFrame:
    """(key, seg, lo, hi): ranges of repeated windows, in offsets of the run."""
    distinct = contents.groupBy("key", "seg").agg(F.first("content").alias("content"), (F.count("*") > 1).alias("often"))
    dealt = distinct.repartition(partitions(contents.sparkSession), "key").sortWithinPartitions("key")

    def result(rows: list[tuple]) -> pa.RecordBatch:
        found = [_ranges(x) for x in repeats_of([r[2] for r in rows], [r[3] for r in rows], least)]
        n = [len(a) for a, _ in found]
        lows = np.concatenate([np.empty(0, np.int64), *(a for a, _ in found)]).astype(np.int64)
        highs = np.concatenate([np.empty(0, np.int64), *(b for _, b in found)]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), n)),
                pa.array(np.repeat(np.array([r[1] for r in rows], np.int64), n)),
                pa.array(lows),
                pa.array(highs),
            ],
            names=["key", "seg", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[0] != rows[-1][0]:
                    yield result(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield result(rows)

    return dealt.select("key", "seg", "content", "often").mapInArrow(tidy(run), "key long, seg long, lo long, hi long")


def _compare_hot(contents: DataFrame, least: int) -> DataFrame:
    """As ``_compare``, but windows meet by a digest of their content, so a key's runs need not be in one task."""
    distinct = contents.groupBy("key", "seg").agg(F.first("content").alias("content"), (F.count("*") > 1).alias("often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, seg, content, often in zip(*batch.columns, strict=True):
                data = content.as_py()
                n = len(data) - least + 1
                for at in range(0, n, WINDOWS):
                    places = np.arange(at, min(n, at + WINDOWS))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array([x.as_py()] * len(places), kind) for x, kind in ((key, pa.int64()), (seg, pa.int64()), (often, pa.bool_()))),
                            pa.array(places, pa.int64()),
                            pa.array([blake2b(data[i : i + least], digest_size=16).digest() for i in places], pa.binary()),
                        ],
                        names=["key", "seg", "often", "at", "window"],
                    )

    windows = staged(distinct, "hot").mapInArrow(tidy(run), "key long, seg long, often boolean, at long, window binary")
    repeated = windows.groupBy("key", "window").agg(F.count("*").alias("n"), F.max("often").alias("often")).where("n > 1 or often")
    found = windows.drop("often").join(repeated.select("key", "window"), ["key", "window"])
    row = F.col("at") - F.row_number().over(Window.partitionBy("key", "seg").orderBy("at"))
    ranges = found.select("key", "seg", "at").withColumn("row", row).groupBy("key", "seg", "row")
    return ranges.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).drop("row")


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(node, spans): byte ranges [lo, hi) that go, for each text that has some."""
    found = _all_runs(docs, least)
    keys = found.groupBy("key").agg(
        F.count("*").alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.max("inner").alias("inner"),
        F.sum(F.col("windows") + (least - 1)).alias("bytes"),
    )
    classes = keys.where("n > 1 or inner = 1").select(
        "key", (F.expr("s0 = s1 and inner = 0")).alias("equal"), (F.col("bytes") > hot).alias("hot")
    )
    marks = staged(found.drop("inner").join(classes, "key"), "marks")
    mixed = marks.where("not equal")
    compared = _compare(_contents(docs, mixed.where("not hot"), least), least)
    if not mixed.where("hot").isEmpty():
        compared = compared.union(_compare_hot(_contents(docs, mixed.where("hot"), least), least))
    compared = staged(compared, "repeats")
    plain = marks.where("equal").select(
        "node", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + (least - 1)).alias("hi")
    )
    sorted_out = mixed.join(compared, ["key", "seg"]).select(
        "node", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + least).alias("hi")
    )
    spans = plain.union(sorted_out).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return staged(spans, "spans")


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, number of maximal removed ranges; ``spans`` sorted."""
    kept, at, removed, ranges, last = [], 0, 0, 0, -1
    for lo, hi in spans:
        if lo > last:
            ranges += 1
        if hi > at:
            kept.append(text[at : max(lo, at)])
            removed += hi - max(lo, at)
            at = hi
        last = max(last, hi)
    kept.append(text[at:])
    return b"".join(kept), removed, ranges


def _with_spans(docs: DataFrame, own: list[str], least: int, hot: int) -> DataFrame:
    """The columns ``own`` with ``_spans``, the ranges that go."""
    spans = repeated_spans(docs, least, hot).select(F.col("node").alias("_node"), F.col("spans").alias("_spans"))
    keyed = docs.select(*(F.col(f"`{c}`") for c in own), digest16(text_or_empty()).alias("_node"))
    return keyed.join(spans, "_node", "left").drop("_node")


def _to_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[bytes, list]]]]:
    """Some rows at a time, without ``_spans``; and the text and the ranges that go of each."""
    for few in few_rows(batches):
        texts, found = (few.column(few.schema.get_field_index(name)) for name in ("text", "_spans"))
        rest = few.select([c for c in few.schema.names if c != "_spans"])
        yield rest, (
            ((t.as_py() or "").encode(), [(x["lo"], x["hi"]) for x in s.as_py() or []]) for t, s in zip(texts, found, strict=True)
        )


def remove_repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """``docs`` with ``rest`` (bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Null texts are empty; texts shorter than ``least`` stay.  Columns of these names are replaced.
    """
    extra = ("rest", "n_bytes", "n_removed", "n_spans")
    joined = _with_spans(docs, [c for c in docs.columns if c not in (*extra, *HELPERS)], least, hot)
    schema = joined.drop("_spans")
    for name, kind in zip(extra, ("binary", "long", "long", "long"), strict=True):
        schema = schema.withColumn(name, F.lit(None).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in _to_cut(batches):
            made = [(len(data), cut(data, spans)) for data, spans in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest.columns,
                    pa.array([m[0] for _, m in made], pa.binary()),
                    pa.array([n for n, _ in made], pa.int64()),
                    pa.array([m[1] for _, m in made], pa.int64()),
                    pa.array([m[2] for _, m in made], pa.int64()),
                ],
                names=[*rest.schema.names, *extra],
            )

    return joined.mapInArrow(tidy(run), schema.schema)


def cut_texts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; bytes of a character that was cut in two go with it.

    Texts without repeats, null ones included, stay as they are.
    """
    own = [c for c in docs.columns if c not in ("rest", "n_bytes", "n_removed", "n_spans", *HELPERS)]
    joined = _with_spans(docs, own, least, HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in _to_cut(batches):
            at = rest.schema.get_field_index("text")
            kept = [
                cut(data, spans)[0].decode("utf-8", "ignore") if spans else old.as_py()
                for old, (data, spans) in zip(rest.column(at), texts, strict=True)
            ]
            yield rest.set_column(at, rest.schema.field(at), pa.array(kept, rest.schema.field(at).type))

    return joined.mapInArrow(tidy(run), joined.drop("_spans").schema)


def removal_report(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    return remove_repeats(docs.select("doc_id", "text"), least, hot).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256")
    )
