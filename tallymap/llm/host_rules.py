r"""Quality rules judged by host (operator 13), in DataFrame functions only.

Every whole text is measured once, and the numbers, without the text, are a table in the
shared folder.  Failures of each rule are counted by host (combined before the shuffle).  A
beta prior for each rule is fitted to all hosts by moments: its mean is the rate over all documents, its
strength follows from how much more the hosts' rates vary than chance would make them.  A
host's rate is shrunk towards that mean, the more the fewer documents it has, and a host with a
shrunk rate above ``most`` for any rule is rejected with all its documents.  The verdicts, one
row per host, are joined back; the sizes of both sides decide how, and a host with
a third of all documents is split by adaptive execution.  A document is kept if it passes
every rule itself and its host is not rejected.

Words are runs of characters other than the six ASCII blanks.  A null text has no words and so fails the base rules;
a document with a null host gets no verdict from a host.  Repeated rows count as often as
they occur, each keeps its row; an empty table gives an empty one.  Other columns are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Settings:
    """``most``: shrunk failure rate of a rule above which a host is rejected."""

    most: float = 0.5


#: Rules over a text's numbers; each is true for a text that fails it.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
}
BASE = ("few_words", "repeated_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in windows of ``width`` words that occur twice or more.

    Windows are sorted by a hash, equal neighbours are compared word by word.
    """

    def hashes(w: Column) -> Column:
        codes = F.transform(w, lambda x: F.xxhash64(x))
        window = lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - width), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(width)))
        )
        return _let(codes, window)

    def repeated_at(w: Column, h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        same = lambda a, b: F.coalesce(
            (a["h"] == b["h"]) & (F.slice(w, a["at"] + 1, width) == F.slice(w, b["at"] + 1, width)), F.lit(False)
        )
        marked = lambda p: F.filter(p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1)))
        return F.sort_array(F.transform(_let(placed, marked), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    some = lambda w, h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), _let(repeated_at(w, h), covered)
    ).otherwise(0)
    return _let(words, lambda w: F.when(F.size(w) > width, _let(hashes(w), lambda h: some(w, h))).otherwise(0))


def measured(docs: DataFrame, host: Column) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), a row per document."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    counts = _let(
        words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    )
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    found = docs.select(
        "doc_id",
        host.alias("host"),
        counts.alias("words"),
        by_line.alias("lines"),
        without(" \t\n\x0b\x0c\r").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).alias("n_symbols"),
    )
    return found.select(
        "doc_id",
        "host",
        F.col("words.n_words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.col("lines.n").cast("long").alias("n_lines"),
        (F.col("lines.n") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"),
        F.col("words.n_repeat_words").cast("long").alias("n_repeat_words"),
    )


def prior(hosts: DataFrame, rule: str) -> Column:
    """struct(mean, strength) of a rule's beta prior over (n_docs, failures) of all hosts.

    The strength is null where hosts do not vary more than chance makes them: every rate is then the mean.
    """
    n, k = F.sum("n_docs").cast("double"), F.sum(rule).cast("double")
    mean = k / n
    # Sums over hosts: n (k/n - mean)^2 = k^2/n - n mean^2 in total, of which chance makes mean (1 - mean) a host.
    spread = F.sum(F.col(rule).cast("double") * F.col(rule) / F.col("n_docs")) - n * mean * mean
    noise = F.count(F.lit(1)) * mean * (1 - mean)
    between = (spread - noise) / n
    strength = F.when(between > 1e-12, F.greatest(F.lit(0.0), mean * (1 - mean) / between - 1))
    return F.struct(mean.alias("mean"), strength.alias("strength"))


def host_verdicts(stats: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, n_docs, a shrunk rate for each rule, rejected) per host of the measured documents."""
    failures = [F.sum(rule().cast("long")).alias(name) for name, rule in RULES.items()]
    counted = stats.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *failures)
    hosts = staged(counted, "hosts")
    fitted = hosts.agg(*(prior(hosts, name).alias(name) for name in RULES)).first()  # two numbers a rule
    rates = {}
    for name in RULES:
        mean, strength = fitted[name]
        rate = F.lit(mean)
        if strength is not None:
            rate = (F.col(name) + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
        rates[name] = rate.cast("double")
    rejected = reduce(or_, (rate > settings.most for rate in rates.values()))
    return hosts.select(
        "host", "n_docs", *(r.alias(f"{n}_rate") for n, r in rates.items()), F.coalesce(rejected, F.lit(False)).alias("rejected")
    )


def host_rules(docs: DataFrame, host: Column, settings: Settings = Settings()) -> DataFrame:
    """The measured numbers of every document with base_failed, rule_failed, host_rejected and kept.

    ``docs`` has doc_id and text; ``host`` is taken as it is, ``host_of`` reads it from an address.
    """
    texts = docs.select("doc_id", host.cast("string").alias("host"), text_or_empty().alias("text"))
    stats = staged(measured(texts, F.col("host")), "rule-counts")
    verdicts = host_verdicts(stats, settings).select("host", F.col("rejected").alias("host_rejected"))
    fails = lambda names: reduce(or_, (RULES[name]() for name in names))
    joined = stats.join(verdicts, "host", "left").withColumns(
        {
            "base_failed": fails(BASE),
            "rule_failed": fails(RULES),
            "host_rejected": F.coalesce("host_rejected", F.lit(False)),
        }
    )
    return joined.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_rejected"))


def host_of(url: Column) -> Column:
    """The host of an address in lower case without a leading www; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def rules_report(docs: DataFrame) -> DataFrame:
    """Counts and verdicts of every document; its source is its host."""
    return host_rules(docs, F.col("source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    fails = {
        "few_words": "n_words < 10",
        "repeated_words": "100 * n_repeat_words > 20 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
        "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    }
    counted = ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) AS {r}" for r, c in fails.items())
    moments = ", ".join(f"sum({r}) / sum(n) AS {r}_m, sum({r} * {r} / n) AS {r}_q" for r in fails)
    between = lambda r: f"(({r}_q - d * {r}_m * {r}_m - h * {r}_m * (1 - {r}_m)) / d)"
    strength = ", ".join(
        f"CASE WHEN {between(r)} > 1e-12 THEN greatest(0, {r}_m * (1 - {r}_m) / {between(r)} - 1) END AS {r}_s" for r in fails
    )
    high = " OR ".join(f"coalesce(({r} + {r}_m * {r}_s) / (n + {r}_s), {r}_m) > 0.5" for r in fails)
    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM texts),
windows AS (
    SELECT row, i, words[i:i + 4] AS w FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
twice AS (
    SELECT row, i, least(5, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 5)) AS reach
    FROM (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, w) > 1)),
again AS (SELECT row, CAST(sum(reach) AS BIGINT) AS n_repeat_words FROM twice GROUP BY row),
counts AS (
    SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split LEFT JOIN again USING (row)),
hosts AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {counted} FROM counts WHERE host IS NOT NULL GROUP BY host),
moments AS (SELECT sum(n) AS d, count(*) AS h, {moments} FROM hosts),
priors AS (SELECT *, {strength} FROM moments),
verdicts AS (SELECT host, {high} AS rejected FROM hosts, priors)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT ({" OR ".join(fails.values())}) AND NOT coalesce(rejected, FALSE) AS kept
FROM counts LEFT JOIN verdicts USING (host)"""


SQL = _sql()
