"""Fill-in-middle transformation over an index of text blocks (operator 11).

A text's UTF-8 bytes are cut into blocks of a fixed size.  Two Fenwick trees over the
blocks count the units and the code points that begin in each.  A cut after k units is
found by a binary-lifting descent, which gives the block that holds unit number k and what
stands before it, and then within that block alone.  Units are code points, words (each
with the white space after it) or lines.

Every row is a unit of work of its own: nothing is shuffled, and a lost task is computed
again with the same draws, which come from the id.

A null text is an empty one and stays plain; a null id draws like an empty id; repeated
rows give repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    """``plain_percent`` of the texts stay as they are, ``spm_percent`` of the others begin with the suffix."""

    unit: str = "code_point"
    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"
    block: int = 2048


def unit_starts(codes: np.ndarray, unit: str) -> np.ndarray:
    """For each byte of a UTF-8 text, whether a unit begins there."""
    if unit == "code_point":
        return (codes & 0xC0) != 0x80
    starts = np.zeros(len(codes), bool)
    starts[:1] = True
    if unit == "line":
        starts[1:] = codes[:-1] == 10
    elif unit == "word":  # a blank before the first word belongs to it
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        words = ~blank[1:] & blank[:-1]
        starts[1:] = words
        if len(codes) and blank[0] and words.any():
            starts[1 + int(words.argmax())] = False
    else:
        raise ValueError(f"no unit named {unit}")
    return starts


def fenwick(counts: np.ndarray) -> list[int]:
    """Tree whose entry i (from 1) is the sum of the last i & -i counts up to i."""
    tree = [0, *counts.tolist()]
    for i in range(1, len(tree)):
        above = i + (i & -i)
        if above < len(tree):
            tree[above] += tree[i]
    return tree


class TextIndex:
    """Where the units and code points of a text begin, by blocks."""

    def __init__(self, data: bytes, settings: Settings = Settings()) -> None:
        codes = np.frombuffer(data, np.uint8)
        self.size, self.block = len(data), settings.block
        self.heads = (codes & 0xC0) != 0x80
        self.starts = self.heads if settings.unit == "code_point" else unit_starts(codes, settings.unit)
        edges = np.arange(0, self.size, self.block)
        count = lambda marks: np.add.reduceat(marks, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
        units, points = count(self.starts), count(self.heads)
        self.n, self.n_points = int(units.sum()), int(points.sum())
        self.units, self.points = fenwick(units), fenwick(points)

    def cut(self, k: int) -> tuple[int, int]:
        """(byte offset, code points before it) of the place after the first ``k`` units."""
        if k >= self.n:
            return self.size, self.n_points
        at, left, points = 0, k, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            to = at + step
            if to < len(self.units) and self.units[to] <= left:
                at, left, points = to, left - self.units[to], points + self.points[to]
            step >>= 1
        begin = at * self.block
        offset = begin + int(np.flatnonzero(self.starts[begin : begin + self.block])[left])
        return offset, points + int(np.count_nonzero(self.heads[begin:offset]))


def rearrange(key: str, data: bytes, settings: Settings) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    index = TextIndex(data, settings)
    digest = hashlib.sha256((settings.salt + key).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    marked = any(m.encode() in data for m in (PREFIX, SUFFIX, MIDDLE))
    if not data or marked or h3 % 100 >= 100 - settings.plain_percent:
        return index.n, "plain", None, None, data
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, before), (b, upto) = index.cut(first), index.cut(second)
    p, m, s = PREFIX.encode() + data[:a], MIDDLE.encode() + data[a:b], SUFFIX.encode() + data[b:]
    form = "spm" if h4 % 100 < settings.spm_percent else "psm"
    return index.n, form, before, upto - before, s + p + m if form == "spm" else p + s + m


def fill_in_middle(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of (doc_id, text).

    ``n`` counts units.  Texts that hold a mark stay plain, so that outputs can be taken apart again.
    """
    unit_starts(np.zeros(0, np.uint8), settings.unit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearrange(k.as_py(), t.as_py(), settings) for k, t in zip(batch.column(1), batch.column(2), strict=True)]
            n, form, before, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(before, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(output, pa.binary()).view(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", key.alias("key"), text_or_empty().cast("binary").alias("text")).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from: parts are told apart by the first mark of each kind."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    upto = lambda part, mark: F.substring_index(part, mark, 1)
    after = lambda part, mark: F.substr(part, F.length(upto(part, mark)) + len(mark) + 1)
    second = F.when(form == "psm", after(body, SUFFIX)).otherwise(after(body, PREFIX))
    first = F.when(form == "psm", upto(body, SUFFIX)).otherwise(upto(body, PREFIX))
    other, middle = upto(second, MIDDLE), after(second, MIDDLE)
    return (
        F.when(form == "psm", F.concat(first, middle, other))
        .when(form == "spm", F.concat(other, middle, first))
        .otherwise(output)
    )


def fill_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The transformation's numbers and digests of its outputs and of the texts rebuilt from them."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(docs, settings).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same for code points in SQL.
SQL = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
draws AS (
    SELECT doc_id, text, n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM texts),
parts AS (
    SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, substr(text, 1, least(c1, c2)) AS p,
           substr(text, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS m, substr(text, greatest(c1, c2) + 1) AS s
    FROM draws)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
