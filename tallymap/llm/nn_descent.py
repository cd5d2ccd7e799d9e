"""Near-duplicate vectors by NN-descent (operator 1).

Equal vectors of a label are one node.  The first neighbour lists come from random
projection trees: vectors are sorted by label, by the sides of some random hyperplanes
and by a random projection, and blocks of that order are compared.  Then lists are
refined in rounds: the neighbours of a node are compared with each other, and pairs
better than what their lists end with are added.  A list whose entries all reach the
threshold is saturated and has to grow.  It does so without its length: wherever vectors
are compared, links that connect all linked ones (a spanning forest) are kept besides the
lists, and while lists are saturated further trees follow whose lists leave out what is in
a node's component already.  Then components meet in blocks, so that all links of large
groups are counted without a pair becoming a row.  An audit compares sampled nodes with all
others, more of them until enough links are seen; below the wanted recall further trees
follow, and if that does not help, all vectors of a label meet in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, partitions, staged


@dataclass(frozen=True)
class Settings:
    """``floor``: neighbours below it are not followed.  ``audited``: nodes first compared with all others;
    twice as many each time follow, ``audit_steps`` times at most, until ``evidence`` links are seen."""

    least: float = 0.98
    neighbours: int = 8
    trees: int = 6
    block: int = 1024
    rounds: int = 2
    floor: float = 0.7
    audited: int = 512
    recall: float = 0.995
    tries: int = 4
    evidence: int = 400
    audit_steps: int = 5


def unit(vector: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, zero or not finite."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64) + 0.0
    if not len(v) or not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, node, unit): node and unit are null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units = [], []
            for vector, label in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = None if label is None else unit(vector)
                raw = None if u is None else np.asarray(vector, np.float64) + 0.0
                nodes.append(None if u is None else hashlib.blake2b(repr(label).encode() + raw.tobytes(), digest_size=16).digest())
                units.append(None if u is None else u.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())],
                names=["vec_id", "label", "node", "unit"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, node binary, unit binary"
    )


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _edges(found: list[tuple]) -> pa.RecordBatch:
    a, b, sim = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sim, pa.float64())], names=["a", "b", "sim"]
    )


def _trees(nodes: DataFrame, seed: int, settings: Settings, splits: int) -> DataFrame:
    """Edges (a, b, sim): in its blocks of each tree, each node's best neighbours outside its root, and a forest of links."""
    label = nodes.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = [len(u) for u in batch.column(2).to_pylist()]
            made = {"tree": [], "side": [], "at": []}
            for raw in batch.column(2):
                u = np.frombuffer(raw.as_py(), np.float64)
                if len(u) not in planes:
                    rng = np.random.default_rng([seed, len(u)])
                    planes[len(u)] = rng.standard_normal((settings.trees, splits + 1, len(u)))
                value = planes[len(u)] @ u
                sides = ((value[:, :splits] > 0) << np.arange(splits)).sum(axis=1)
                made["tree"] += range(settings.trees)
                made["side"] += sides.tolist()
                made["at"] += value[:, splits].tolist()
            take = pa.array(np.repeat(np.arange(len(sizes)), settings.trees))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made["tree"], pa.int64()), pa.array(made["side"], pa.int64()), pa.array(made["at"], pa.float64())]
                + [batch.column(i).take(take) for i in range(4)],
                names=["tree", "side", "at", "node", "label", "unit", "root"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (len(rows) >= settings.block or (row[0], row[1], len(row[3])) != (rows[-1][0], rows[-1][1], len(rows[-1][3]))):
                    yield _best(before, rows, settings)
                    same = (row[0], row[1], len(row[3])) == (rows[-1][0], rows[-1][1], len(rows[-1][3]))
                    before, rows = (rows if same else []), []
                rows.append(row)
        if rows:
            yield _best(before, rows, settings)

    placed = nodes.select("node", "label", "unit", "root").mapInArrow(
        place, f"tree long, side long, at double, node binary, label {label}, unit binary, root binary"
    )
    order = ["tree", "label", "side", "at", "node"]
    dealt = placed.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("tree", "label", "node", "unit", "root").mapInArrow(compare, "a binary, b binary, sim double")


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that connect whatever its links connect."""
    seen = np.zeros(len(close), bool)
    found = []
    for start in np.flatnonzero(close.any(axis=1)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(close[at] & ~seen)
            seen[new] = True
            found += [(at, to) for to in new]
            todo += new.tolist()
    return found


def _best(before: list[tuple], rows: list[tuple], settings: Settings) -> pa.RecordBatch:
    """Best neighbours, outside their roots, of a block's rows among themselves and the block before, in
    both directions; and links that connect all linked ones, whatever the lists hold."""
    x = _matrix([r[3] for r in rows])
    others = before + rows
    y = _matrix([r[3] for r in others])
    found: list[tuple] = []
    sim = x @ y.T
    roots = np.unique(np.array([r[4] for r in others], object), return_inverse=True)[1]
    sim[roots[len(before) :, None] == roots[None, :]] = -2
    close = np.zeros((len(others), len(others)), bool)
    close[len(before) :] = sim >= settings.least
    close |= close.T
    for i, j in _forest(close):
        low, high = min(i, j) - len(before), max(i, j)
        found.append((others[i][2], others[j][2], float(sim[high - len(before), low + len(before)])))
    k = min(settings.neighbours, len(others) - 1)
    if k > 0:
        for matrix, left, right in ((sim, rows, others), (sim[:, : len(before)].T, before, rows)):
            if not len(left):
                continue
            m = min(k, matrix.shape[1])
            top = np.argpartition(-matrix, m - 1, axis=1)[:, :m]
            for i, js in enumerate(top):
                for j in js:
                    if matrix[i, j] >= settings.floor:
                        found.append((left[i][2], right[j][2], float(matrix[i, j])))
    return _edges(found)


def _lists(edges: DataFrame, settings: Settings) -> DataFrame:
    """The best neighbours of each node, once each."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(
        F.col("rank") <= settings.neighbours
    )


def _saturated(edges: DataFrame, settings: Settings) -> bool:
    """Whether some list is full of links, so that more may be left out."""
    links = edges.where(F.col("sim") >= settings.least).groupBy("a").agg(F.count_distinct("b").alias("n"))
    return not links.where(F.col("n") >= settings.neighbours).isEmpty()


def _across(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between different roots."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    return edges.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select("a", "b", "sim")


def _refine(graph: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Edges between neighbours of a node, of other roots, that are better than the worst entry of a full
    list of either; and links that connect all linked ones."""
    worst = graph.groupBy("a").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("a").alias("b"), F.when(F.col("n") >= settings.neighbours, F.col("worst")).otherwise(F.lit(settings.floor)).alias("worst"))
    both = graph.select("a", "b", "sim").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).distinct()
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    near = both.withColumn("rank", rank).where(F.col("rank") <= 2 * settings.neighbours).drop("rank", "sim")
    units = nodes.select(F.col("node").alias("b"), "unit", "root")
    full = near.join(worst, "b", "left").join(units, "b")
    dealt = full.repartition(partitions(nodes.sparkSession), "a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def join() -> list[tuple]:
            x = _matrix([g[3] for g in group])
            sim = x @ x.T
            ends = np.array([settings.floor if g[2] is None else g[2] for g in group])
            roots = np.unique(np.array([g[4] for g in group], object), return_inverse=True)[1]
            other = roots[:, None] != roots[None, :]
            pairs = [*zip(*np.nonzero((sim > ends[:, None]) & other), strict=True), *_forest((sim >= settings.least) & other)]
            return [(group[i][1], group[j][1], float(sim[i, j])) for i, j in pairs]

        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    found += join()
                    group = []
                group.append(row)
            yield _edges(found)
        if group:
            yield _edges(join())

    return dealt.select("a", "b", "worst", "unit", "root").mapInArrow(run, "a binary, b binary, sim double")


def _joined(roots: DataFrame, edges: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """``roots`` (node, root) with the roots that links connect made one, and how many roots that were."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    links = edges.where(F.col("sim") >= settings.least).select("a", "b").distinct()
    across = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    new = staged(components(across).select(F.col("node").alias("root"), F.col("root").alias("to")), "joined")
    merged = new.count()
    if not merged:
        return roots, 0
    return staged(roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"), merged


def _counts(nodes: DataFrame, roots: DataFrame, settings: Settings) -> DataFrame:
    """(node, links): vectors linked with each node of a component, all blocks of it against all."""

    def links_of(left: list[tuple], right: list[tuple], close: np.ndarray, same: bool) -> pa.RecordBatch:
        names = [g[4] for g in left]
        links = (close @ np.array([g[5] for g in right])).tolist()
        if not same:
            names += [g[4] for g in right]
            links += (np.array([g[5] for g in left]) @ close).tolist()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(links, pa.int64())], names=["node", "links"])

    found = _meet(nodes, roots, settings, links_of, "node binary, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _every_link(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Edges (a, b, sim) that connect all linked vectors, from comparing all of a label in blocks."""

    def forest_of(left: list[tuple], right: list[tuple], close: np.ndarray, same: bool) -> pa.RecordBatch:
        both = left if same else left + right
        whole = close if same else np.zeros((len(both), len(both)), bool)
        if not same:
            whole[: len(left), len(left) :] = close
            whole |= whole.T
        return _edges([(both[i][4], both[j][4], 1.0) for i, j in _forest(whole)])

    kinds = F.concat_ws(" ", F.col("label").cast("string"), F.length("unit").cast("string"))
    whole = nodes.select("node", kinds.cast("binary").alias("root"))
    return _meet(nodes, whole, settings, forest_of, "a binary, b binary, sim double")


def _meet(nodes: DataFrame, roots: DataFrame, settings: Settings, of: Callable, schema: str) -> DataFrame:
    """What ``of`` says of two blocks and the matrix of their links, for all blocks of nodes with one root."""
    half = settings.block // 2
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / half).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    member = (
        roots.join(sizes.withColumn("blocks", blocks), "root")
        .withColumn("own", own)
        .join(nodes.select("node", "unit", "n"), "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "unit")
    )
    keys = ["root", "i", "j"]
    dealt = member.repartition(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def meet() -> pa.RecordBatch | None:
            i, j = group[0][1], group[0][2]
            left = [g for g in group if g[3] == i]
            right = [g for g in group if g[3] == j]
            if not left or not right:
                return None
            close = _matrix([g[6] for g in left]) @ _matrix([g[6] for g in right]).T >= settings.least
            if i == j:
                np.fill_diagonal(close, False)
            return of(left, right, close, i == j)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if (made := meet()) is not None:
                        yield made
                    group = []
                group.append(row)
        if group and (made := meet()) is not None:
            yield made

    return dealt.mapInArrow(run, schema)


def _audit(nodes: DataFrame, roots: DataFrame, edges: DataFrame, total: int, settings: Settings) -> float | None:
    """Share of the true links of sampled nodes whose ends are in one component; None if none was seen.

    Half of the nodes are drawn from all, half from those with a neighbour above the floor.  More
    are drawn until ``evidence`` links are seen, every node is audited or the steps are used up.
    """
    near = nodes.join(edges.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node")
    near = staged(near, "near")
    some = near.count()
    place = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    links = kept = low = 0
    for step in range(settings.audit_steps + 1):
        high = low + settings.audited * 2**step // 2
        part = lambda n, salt: (place(salt) >= low / max(1, n)) & (place(salt) < high / max(1, n))  # noqa: B023, E731
        drawn = nodes.where(part(total, 1)).select("node").union(near.where(part(some, 2))).distinct()
        more, found = _audit_of(nodes, drawn, roots, settings)
        links, kept, low = links + more, kept + found, high
        if links >= settings.evidence or high >= total:
            break
    return kept / links if links else None


def _audit_of(nodes: DataFrame, drawn: DataFrame, roots: DataFrame, settings: Settings) -> tuple[int, int]:
    """True links of the drawn nodes, and those whose ends are in one component."""
    spark = nodes.sparkSession
    sample = nodes.join(drawn, "node", "left_semi").select("node", "label", "unit").collect()
    if not sample:
        return 0, 0
    asked = spark.sparkContext.broadcast([(bytes(r.node), r.label, bytes(r.unit)) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            cols = [c.to_pylist() for c in batch.columns]
            for size in {len(u) for u in cols[2]}:
                rows = [r for r in zip(*cols, strict=True) if len(r[2]) == size]
                queries = [q for q in asked.value if len(q[2]) == size]
                if queries:
                    sim = _matrix([q[2] for q in queries]) @ _matrix([r[2] for r in rows]).T
                    for i, j in zip(*np.nonzero(sim >= settings.least), strict=True):
                        if queries[i][0] != rows[j][0] and queries[i][1] == rows[j][1]:
                            found.append((queries[i][0], rows[j][0], float(sim[i, j])))
            yield _edges(found)

    true = nodes.select("node", "label", "unit").mapInArrow(run, "a binary, b binary, sim double")
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    got = true.join(side("a"), "a", "left").join(side("b"), "b", "left").agg(
        F.count("*"), F.sum(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).cast("long"))
    )
    total, kept = got.first()
    return total, kept or 0


def near_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row of (vec_id, embedding, label).

    Vectors link when labels are equal and not null and the cosine reaches ``least``; equal
    vectors always do.  Null, zero and non-finite vectors link with nothing and are their own
    component.  Vectors of different lengths never link; null ids name no component of others.
    ``audit_recall`` is null where the audit saw no link.
    """
    rows = staged(_rows(vectors), "vectors")
    valid = rows.where("node is not null")
    nodes = staged(
        valid.groupBy("node").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n")), "nodes"
    )
    total, labels = nodes.agg(F.count("*"), F.count_distinct("label")).first()
    splits = max(0, math.ceil(math.log2(max(1, total / max(1, labels) / settings.block)))) + 1
    roots = nodes.select("node", F.col("node").alias("root"))
    edges, recall, attempt, lacking = None, None, 0, 0
    while total:
        known = nodes.join(roots, "node") if attempt else nodes.withColumn("root", F.col("node"))
        known = staged(known, "known") if attempt else known
        more = _trees(known, attempt, settings, splits)
        edges = staged(more if not lacking else _across(edges, roots).union(more), "edges")
        for _ in range(settings.rounds):
            graph = staged(_lists(edges, settings).drop("rank"), "lists")
            edges = edges.union(staged(_refine(graph, known, settings), "better"))
        attempt += 1
        full = _saturated(edges, settings)
        roots, merged = _joined(roots, edges, settings)
        if merged and full:
            continue  # what the saturated lists had no place for is met by further trees
        recall = _audit(nodes, roots, edges, total, settings)
        if recall is None or recall >= settings.recall:
            break
        lacking += 1
        if lacking == settings.tries:
            roots, _ = _joined(roots, staged(_every_link(nodes, settings), "every"), settings)
            recall = _audit(nodes, roots, edges, total, settings)
            break
    counts = _counts(nodes, roots, settings)
    per_node = (
        nodes.select("node", "n").join(counts, "node", "left").join(roots, "node", "left")
        .select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    lowest = valid.select("node", "vec_id").join(per_node, "node").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = per_node.join(lowest, "root").select("node", "n_links", "component_id")
    linked = valid.select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
    )
