import re

import pytest
from pyspark.sql import functions as F

from tallymap.llm import host_rules

SCHEMA = "doc_id long, text string, source string, host string, n_words int, rejected boolean, h int"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
ODD = [
    None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a b c d e f " * 3, "x " * 40, "x\x0by\x0cz w",
    "line one\nline one\n \n\nline two\nline one", "# * $ % & | < > #word", "é漢 😀 ü " * 9, "a b c d e x a b c d e y b c d e x",
    " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(300, 420)), "p q\r\np q\r\np q",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    marked = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 4 == 0 else "h", "x", 1, True, 5) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, *rows[-3:]], SCHEMA)


def test_numbers(odd):
    rows = host_rules.rules_report(odd).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        n_words, chars, symbols, lines, repeated = plain(ODD[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, lines, repeated)
        assert r.base_failed == (n_words < 10 or 100 * repeated > 20 * n_words)
        assert not (r.kept and r.base_failed)


def test_empty_table(spark):
    assert host_rules.rules_report(spark.createDataFrame([], SCHEMA)).count() == 0


GOOD = " ".join(f"good{i} text{i}" for i in range(20))
BAD = "spam### " * 4 + GOOD.replace(" ", "### ")


def hosts(spark):
    """Large clean hosts, a large bad one with some clean texts, a small one whose only text is bad."""
    rows = [(f"clean{h}", GOOD if i % 50 else BAD) for h in range(8) for i in range(200)]
    rows += [("bad", BAD if i % 10 else GOOD) for i in range(200)]
    rows += [("tiny", BAD), ("tiny", GOOD), (None, GOOD), (None, BAD)]
    return spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")


def test_hosts(spark):
    docs = hosts(spark)
    found = host_rules.host_rules(docs, F.col("source"))
    kept = {(r.host, r.rule_failed): (r.kept, r["count"]) for r in found.groupBy("host", "rule_failed", "kept").count().collect()}
    assert kept[("bad", False)] == (False, 20)  # clean texts of a rejected host
    assert kept[("bad", True)][0] is False
    assert kept[("clean3", False)] == (True, 196)
    assert kept[("clean3", True)] == (False, 4)
    assert kept[("tiny", False)] == (True, 1)  # one bad text of two does not condemn a host
    assert kept[(None, False)] == (True, 1)
    assert kept[(None, True)] == (False, 1)


def test_rates_are_shrunk_by_moments(spark):
    stats = host_rules.measured(hosts(spark).select("doc_id", "source", "text"), F.col("source"))
    rates = {r.host: r for r in host_rules.host_verdicts(stats).collect()}
    counts = {f"clean{h}": (200, 4) for h in range(8)} | {"bad": (200, 180), "tiny": (2, 1)}
    n, k = (sum(c[i] for c in counts.values()) for i in (0, 1))
    mean = k / n
    between = (sum(b * b / a for a, b in counts.values()) - n * mean**2 - len(counts) * mean * (1 - mean)) / n
    strength = mean * (1 - mean) / between - 1
    for host, (a, b) in counts.items():
        assert rates[host].symbols_rate == pytest.approx((b + mean * strength) / (a + strength))
        assert rates[host].few_words_rate == 0.0
        assert rates[host].rejected == (host == "bad")
    assert counts["tiny"][1] / 2 > rates["tiny"].symbols_rate > mean


def test_host_of(spark):
    urls = ["http://www.A.org/x?y", "https://b.com:80", "no address", None, "http:///x"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in frame.select(host_rules.host_of(F.col("u"))).collect()] == ["a.org", "b.com", None, None, None]
