"""Near-duplicates with SetSketch registers (operator 8).

A text's set of word shingles is sketched in registers: the minimum of exponential
variables over the set, kept as a whole number on an exponential scale and truncated
to a range.  Registers of a union are the minima's counterpart, so sketches merge; two
sets agree in a register with a probability near their similarity.  Bands of registers
are bucket keys.  Pairs from buckets are estimated jointly, by the likelihood of how
many registers are larger, smaller and equal given both set sizes, and those not
clearly below the threshold are confirmed on full sets.

Only links that can join something are looked at, never all pairs of a bucket.  In
rounds, the members of a bucket meet its most central one, the text that shares most
buckets with others (of a group of copies, mostly the one they were made from).  Then
the components that still share buckets meet in blocks, on full sets: pairs are cells
of a matrix inside a task, never rows.  Exact copies of a text are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, digest16, partitions, staged, text_or_empty, tidy

U = np.uint64
#: Odd multipliers of the 64-bit mixing steps (fixed values of the splitmix64 generator).
MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Settings:
    """``words`` a shingle, ``percent``: least similarity; ``rows`` registers a band, ``bands`` of them.

    At 0.8 a pair is missed with a probability of 1.5e-5, at 0.85 of 7e-8.  ``base``,
    ``rate`` and ``top`` are the sketch's scale, rate and largest register value.
    ``rounds``: how often members meet a bucket's most central member before the rest meet in blocks
    of about ``block`` texts, fewer if they have more than ``long`` shingles on average.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 28
    base: float = 1.001
    rate: float = 20.0
    top: int = 65_534
    rounds: int = 2
    block: int = 256
    long: int = 2_000

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * MIX[0]
    x ^= x >> U(27)
    x *= MIX[1]
    x ^= x >> U(31)
    return x


_STEP = U(0xD1342543DE82EF95)
_BACK = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=U) * MIX[2])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, step in (("up", _STEP), ("down", _BACK)):
                steps = np.full(size, step, U)
                steps[0] = 1
                _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[data] * up[: len(data)], dtype=U)))
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
    k = min(words, len(word))
    n = len(word) - k + 1
    code = np.full(n, U(k), U)
    for i in range(k):
        code = mix(code * MIX[2] + word[i : i + n])
    return np.unique(code)


def sketch(codes: np.ndarray, settings: Settings) -> np.ndarray:
    """Registers of a set of hashes; all zero for the empty set."""
    m = settings.registers
    if not len(codes):
        return np.zeros(m, np.uint16)
    salts = mix(np.arange(1, m + 1, dtype=U) * MIX[2]) | U(1)
    low = np.full(m, ~U(0), U)
    for at in range(0, len(codes), 1024):
        part = codes[at : at + 1024, None] * salts[None, :]
        part ^= part >> U(32)
        part *= MIX[0]
        low = np.minimum(low, part.min(axis=0))
    uniform = (low.astype(np.float64) + 1) / 2.0**64
    least = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / settings.rate
    value = np.floor(1 - np.log(least) / np.log(settings.base))
    return np.clip(value, 0, settings.top).astype(np.uint16)


def merged(sketches: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets whose registers are the rows: the largest of each, as registers grow when minima fall."""
    return np.max(sketches, axis=0)


def band_keys(registers: np.ndarray, settings: Settings) -> np.ndarray:
    bands = registers.reshape(settings.bands, settings.rows).astype(U)
    key = mix(np.arange(1, settings.bands + 1, dtype=U) * MIX[2])
    for i in range(settings.rows):
        key = mix(key * MIX[2] + bands[:, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, settings: Settings) -> np.ndarray:
    """Most likely similarity of each row of register matrices, given the sets' sizes."""
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = settings.registers - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most
    step = (settings.base - 1) / settings.base
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * step) / np.log(settings.base)
    up, down = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    like = (
        more * np.log(np.maximum(down, tiny))
        + less * np.log(np.maximum(up, tiny))
        + same * np.log(np.maximum(1 - up - down, tiny))
    )
    return np.take_along_axis(grid, like.argmax(axis=1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, node, n_shingles, registers, keys): ``node`` stands for the text, copies share it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, regs, keys = [], [], []
            for text in batch.column(2):
                codes = shingles(text.as_py(), settings.words)
                registers = sketch(codes, settings)
                sizes.append(len(codes))
                regs.append(registers.tobytes())
                keys.append(band_keys(registers, settings) if len(codes) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "registers", "keys"],
            )

    text = text_or_empty()
    return docs.select("doc_id", digest16(text).alias("node"), text.cast("binary").alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, node binary, n_shingles long, registers binary, keys array<bigint>"
    )


def _likely(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that the registers do not place clearly (five deviations) below the threshold."""
    least = settings.percent / 100
    bound = least - 5 * (least * (1 - least) / settings.registers) ** 0.5
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * settings.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(col[r].to_pylist()), np.uint16).reshape(-1, settings.registers) for r in ("ra", "rb")]
            sizes = [col[n].to_numpy().astype(float) for n in ("na", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array(estimate(*regs, *sizes, settings) >= bound))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose full sets have the similarity asked for; texts are (node, text), one row a node."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            good = []
            for ta, tb in zip(col["ta"], col["tb"], strict=True):
                if (text := ta.as_py()) != last:
                    last, have = text, shingles(text, settings.words)
                other = shingles(tb.as_py(), settings.words)
                common = len(np.intersect1d(have, other, assume_unique=True))
                good.append(100 * common >= settings.percent * (len(have) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(tidy(run), "a binary, b binary")


def _candidates(rows: DataFrame, docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, n_shingles, registers, text) of the texts that share a bucket, one row each.

    Copies of a text are merged before the shuffle, which is the only one of all texts.
    """
    text = text_or_empty()
    texts = docs.select(digest16(text).alias("node"), text.cast("binary").alias("text")).dropDuplicates(["node"])
    known = rows.select("node", "n_shingles", "registers").dropDuplicates(["node"])
    return texts.join(known.join(buckets.select("node"), "node", "left_semi"), "node")


def links(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, components): sketched rows of all documents, and (node, root) of linked texts."""
    rows = staged(sketches(docs, settings), "sketches")
    spread = rows.select("node", F.col("n_shingles").alias("size"), "keys").dropDuplicates(["node"])
    spread = spread.select("node", "size", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = staged(spread.join(shared, "key"), "buckets")
    central = buckets.groupBy("node").agg(F.sum("n").alias("rank"))
    buckets = staged(buckets.drop("n").join(central, "node"), "ranked")
    nodes = staged(_candidates(rows, docs, buckets), "candidates")
    member = buckets.withColumn("root", F.col("node"))
    tried, found, roots = None, None, None
    for _ in range(settings.rounds):
        top = member.groupBy("key").agg(F.max(F.struct("rank", "node", "root", "size")).alias("top"))
        pairs = member.join(top, "key").where((F.col("root") != F.col("top.root")) & _near("size", "top.size", settings))
        pairs = pairs.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "hub-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        more = _verify(pairs, nodes, settings)
        found = more if found is None else found.union(more)
        roots = components(found)
        member = _mixed(buckets, roots)
    return rows, components(found.union(staged(_met_in_blocks(member, nodes, settings), "rest")))


def _near(a: str, b: str, settings: Settings) -> Column:
    """Whether sets of these sizes can be as similar as asked for."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * settings.percent


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component's root."""
    member = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return staged(member.join(mixed.select("key"), "key"), "mixed")


def _met_in_blocks(member: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that join the components which still share buckets; members are (key, node, root, size).

    Components that buckets connect form a group.  Its largest component is the core, whose members need
    not meet each other.  All other members are dealt to blocks, bounded in texts and in shingles, that meet
    each other and the core's blocks.  A tile of two blocks compares full sets by counting common shingles
    and returns no more links than it has texts.
    """
    first = member.groupBy("key").agg(F.min("root").alias("b"))
    tied = member.join(first, "key").select(F.col("root").alias("a"), "b").distinct()
    groups = components(tied).select(F.col("node").alias("root"), F.col("root").alias("group"))
    people = staged(member.select("node", "root", "size").distinct().join(groups, "root"), "people")
    weight = F.greatest(F.count("*") / settings.block, F.sum("size") / (settings.block * settings.long))
    sums = people.groupBy("group", "root").agg(F.count("*").alias("n"), weight.alias("weight"))
    core = sums.groupBy("group").agg(F.max(F.struct("n", "root", "weight")).alias("core"), F.sum("weight").alias("weight"))
    core = core.select(
        "group",
        F.col("core.root").alias("core"),
        F.ceil(F.col("core.weight")).cast("int").alias("cores"),
        F.ceil(F.greatest(F.col("weight") - F.col("core.weight"), F.lit(1e-9))).cast("int").alias("others"),
    )
    dealt = people.join(core, "group").withColumn("hash", F.xxhash64("node"))
    inner = F.col("root") == F.col("core")
    dealt = dealt.withColumn("own", F.when(inner, F.col("others") + F.pmod("hash", "cores")).otherwise(F.pmod("hash", "others")).cast("int"))
    last = F.when(inner, F.col("others")).otherwise(F.col("others") + F.col("cores")) - 1
    tiles = (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .join(nodes.select("node", "text"), "node")
        .select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "text")
    )
    keys = ["group", "i", "j"]
    tiles = tiles.repartition(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list[tuple] = []

        def meet() -> tuple[list, list]:
            _, i, j = tile[0][0]
            left = [t for t in tile if t[1] == i]
            right = [t for t in tile if t[1] == j]
            found = _forest(_alike([t[4] for t in left], [t[4] for t in right], settings) & _apart(left, right))
            return [left[x][2] for x, _ in found], [right[y][2] for _, y in found]

        for batch in batches:
            a, b = [], []
            for group, i, j, own, node, root, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile and tile[0][0] != (group, i, j):
                    for out, more in zip((a, b), meet(), strict=True):
                        out += more
                    tile = []
                tile.append(((group, i, j), own, node, root, shingles(data, settings.words)))
            yield _pairs(a, b)
        if tile:
            yield _pairs(*meet())

    return tiles.mapInArrow(tidy(run), "a binary, b binary")


def _pairs(a: list[bytes], b: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _apart(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Which texts of two blocks are in different components."""
    number = {root: k for k, root in enumerate({t[3] for t in left + right})}
    a, b = (np.array([number[t[3]] for t in side], np.int64) for side in (left, right))
    return a[:, None] != b[None, :]


def _alike(left: list[np.ndarray], right: list[np.ndarray], settings: Settings) -> np.ndarray:
    """Which sets of the two sides are as similar as asked for, by their full intersections."""
    na, nb = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    common = np.zeros((len(left), len(right)), np.float64)
    sides = [np.concatenate([*side, np.empty(0, U)]) for side in (left, right)]
    shared = np.intersect1d(*(np.unique(x) for x in sides), assume_unique=True)
    rows, cols = [], []
    for values, counts in zip(sides, (na, nb), strict=True):
        at = np.searchsorted(shared, values)
        inside = at < len(shared)
        inside[inside] = shared[at[inside]] == values[inside]
        order = np.argsort(at[inside], kind="stable")
        rows.append(np.repeat(np.arange(len(counts)), counts)[inside][order])
        cols.append(at[inside][order])
    step = 2048
    for start in range(0, len(shared), step):
        part = []
        for row, col, n in zip(rows, cols, (len(left), len(right)), strict=True):
            lo, hi = np.searchsorted(col, (start, start + step))
            has = np.zeros((n, step), np.float32)
            has[row[lo:hi], col[lo:hi] - start] = 1
            part.append(has)
        common += part[0] @ part[1].T
    union = na[:, None] + nb[None, :] - common
    return (100 * common >= settings.percent * union) & (common > 0)


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what all true cells connect, one less than the members of each component at most."""
    rows, cols = (np.ones(n, bool) for n in close.shape)
    found: list[tuple[int, int]] = []
    for start in np.flatnonzero(close.any(axis=1)):
        front = [(True, start)] if rows[start] else []
        rows[start] = False
        while front:
            is_row, at = front.pop()
            new = np.flatnonzero((close[at] & cols) if is_row else (close[:, at] & rows))
            (cols if is_row else rows)[new] = False
            found += [(at, x) if is_row else (x, at) for x in new.tolist()]
            front += [(not is_row, x) for x in new.tolist()]
    return [(int(x), int(y)) for x, y in found]


def _verify(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    likely = staged(_likely(pairs, nodes, settings), "likely")
    return staged(_confirmed(likely, nodes, settings), "links")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A component's id is the smallest doc_id in it; texts without words are linked with
    nothing, null ids never name a component they share with others.  Rows that share
    a doc_id all count; equal ids are kept together.
    """
    rows, roots = links(docs, settings)
    empty = F.col("n_shingles") == 0
    named = rows.select("doc_id", "node", "n_shingles").join(roots, "node", "left")
    group = F.coalesce("root", "node")
    named = named.select("doc_id", "n_shingles", group.alias("root"))
    ids = named.where(~empty).groupBy("root").agg(F.min("doc_id").alias("lowest"))
    out = named.join(ids, "root", "left").select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of every group of near-duplicates.

    Rows of equal id in a group, as well as groups without any id, leave one row: the first by id and text.
    """
    text = text_or_empty()
    _, roots = links(docs, settings)
    # The rows are one column, so that no name of theirs meets a name used here.
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").alias("id"),
        digest16(text).alias("node"),
        (F.trim(F.regexp_replace(text, r"\s+", " ")) == "").alias("empty"),
    )
    best = keyed.select("node", "empty", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("node").alias("t"))
    first = best.where(~F.col("empty")).groupBy("root").agg(F.min(order).alias("o"))
    chosen = first.select(F.col("o.i").alias("first_id"), F.col("o.t").alias("first_node"))
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node"))
    kept = keyed.where(~F.col("empty")).join(chosen, same, "left_semi")
    once = kept.dropDuplicates(["id", "node"]).select("row")
    return once.unionByName(keyed.where("empty").select("row")).select("row.*")
