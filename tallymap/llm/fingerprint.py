"""Document fingerprints by one-permutation MinHash (operator 6), in DataFrame functions only.

A text's word shingles are hashed once.  The leading bits of a hash choose one of the
bins, a bin keeps its smallest hash.  An empty bin takes the value of a full one found by
a random order of its own, the same for all texts (optimal densification): some probes
first, then the best of the full bins.  The low four bits of each bin, as a hexadecimal
digit, are the fingerprint.  Digits agree by chance once in sixteen, which the likeness
of two fingerprints corrects for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty

BINS = 256
WORDS = 5
DIGITS = "0123456789abcdef"
PROBES = 12
CHANCE = 1 / 16
#: Rows between two cut points of the ids.
RUN_ROWS = 20_000


def bin_minima(text: Column, words: int = WORDS) -> Column:
    """Smallest shingle hash of each full bin, in order of bins (a signed hash's eight top bits)."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    codes = F.transform(tokens, lambda w: F.xxhash64(w))

    def shingle(i: Column, codes: Column) -> Column:
        return F.xxhash64(*(F.get(codes, i + k) for k in range(words)))

    def hashed(c: Column) -> Column:
        size = F.size(c)
        return F.when(
            size >= words, F.transform(F.sequence(F.lit(0), size - words), lambda i: shingle(i, c))
        ).when(size > 0, F.array(F.xxhash64(c)))

    ordered = F.sort_array(_let(codes, hashed))
    first = lambda a: F.filter(
        a, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(a, i - 1), 56))
    )
    return _let(ordered, first)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables hold it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def densified(minima: Column) -> Column:
    """The bins' values, empty ones filled; null for a text without words."""

    def fill(a: Column) -> Column:
        bins = F.transform(a, lambda x: F.shiftright(x, 56).cast("int") + BINS // 2)
        spread = lambda b: F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)),
            lambda i: F.get(a, F.array_position(b, i).cast("int") - 1),
        )
        return _let(_let(bins, spread), lambda full: F.transform(full, lambda x, i: F.coalesce(x, *probes(full, i), rest(a, i))))

    def probes(full: Column, i: Column) -> list[Column]:
        return [F.get(full, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]

    def rest(a: Column, i: Column) -> Column:
        """The full bin that comes first in an order by a hash of both bins."""
        best = F.array_min(F.transform(a, lambda x: F.struct(F.xxhash64(i, F.shiftright(x, 56)).alias("h"), x.alias("x"))))
        return best["x"]

    return F.when(F.size(minima) > 0, _let(minima, fill))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """256 hexadecimal digits; empty for a text without words."""
    digits = F.transform(
        densified(bin_minima(text, words)),
        lambda x: F.substring(F.lit(DIGITS), x.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)),
    )
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints' shingle sets; two empty ones are alike."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0))
    same = F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    corrected = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - CHANCE) / (1 - CHANCE)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(corrected)


def with_next(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): the next row in descending doc_id, after the last one the first.

    Equal ids are ordered by text, null ids come last.  Ids are cut into runs at quantiles
    and a window goes over each run; a copy of the next run's first rows closes a run.
    A single row's next one is itself.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", text.alias("text"))
    total = rows.count()
    parts = max(1, total // run_rows)
    steps = [k / parts for k in range(1, parts)]
    cuts = []
    if steps:
        found = rows.agg(F.percentile_approx("doc_id", steps, min(10_000, 20 * parts))).first()[0]
        cuts = sorted({int(x) for x in found or []})
    # Run 0 holds the largest ids; a run ends with the row before the next smaller cut.
    place = lambda c: F.when(c.isNull(), len(cuts)).otherwise(
        F.lit(len(cuts)) - F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)
    )
    placed = rows.withColumn("run", place(F.col("doc_id")).cast("int"))
    tops = placed.groupBy("run").agg(F.max("doc_id").alias("top")).collect()  # a row a run
    order = sorted((r.run, r.top) for r in tops)
    if not order:
        marked = rows.withColumn("fingerprint", fingerprint(F.col("text")))
        return marked.withColumns({"next_text": F.col("text"), "next_fingerprint": F.col("fingerprint")})
    sends = [(top, order[at - 1][0]) for at, (_, top) in enumerate(order)]
    ids = [top for top, _ in sends if top is not None]
    first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(top is None for top, _ in sends):
        first = F.coalesce(first, F.lit(False)) | F.col("doc_id").isNull()
    target = F.coalesce(
        *(F.when(F.col("doc_id").eqNullSafe(F.lit(top)), F.lit(run)) for top, run in sends)
    )
    heads = placed.where(first).withColumn("run", target.cast("int")).withColumn("ghost", F.lit(True))
    both = placed.withColumn("ghost", F.lit(False)).unionByName(heads)
    both = both.withColumn("fingerprint", fingerprint(F.col("text")))
    window = Window.partitionBy("run").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    following = {f"next_{c}": F.lead(c).over(window) for c in ("text", "fingerprint")}
    return both.withColumns(following).where(~F.col("ghost")).drop("ghost", "run")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of the next one, and of the text with its last third replaced."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    edited = F.concat(kept, F.substring("next_text", F.lit(1), third))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(edited).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
