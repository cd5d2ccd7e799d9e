import hashlib
import random
import re

import numpy as np
import pytest

from tallymap.llm import fill_middle
from tallymap.llm.fill_middle import Settings, TextIndex

LONG = "Zeile é 漢字 😀\n" * 9000
ODD = [
    (1, None), (2, ""), (3, "x"), (4, "é"), (5, "a<P>b"), (6, "<S"), (7, "no <M> here"), (8, "< M > 漢字😀" * 7),
    (9, LONG), (9, LONG), (None, "kein Schlüssel"), (10, "\n \n"), (11, "<<P" * 40), (12, "P>" * 30),
] + [(100 + i, f"Text {i} mit ünf Wörtern " * (i % 9)) for i in range(200)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, n int, key string")


def plain(key, text):
    """The same by slicing code points."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [3, 2048])
def test_against_slices(odd, block):
    rows = fill_middle.fill_in_middle(odd, Settings(block=block)).collect()
    got = sorted((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(((i or -1, *plain(i, t)) for i, t in ODD), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back(spark, odd):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = fill_middle.fill_report(odd).collect()
    assert sorted(r.restored_sha256 for r in rows) == sorted(digest(t or "") for _, t in ODD)
    # A text of no row stands for the outputs: what is taken apart is the output alone.
    forms = spark.createDataFrame([("<P>a<S><S<M>b>", "psm"), ("<S>x<<P><P<M>", "spm"), ("<P>", "plain")], "o string, f string")
    assert [r[0] for r in forms.select(fill_middle.restored(forms.o, forms.f)).collect()] == ["ab><S", "<Px<", "<P>"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert fill_middle.fill_report(none).count() == 0
    assert fill_middle.fill_in_middle(none).schema["doc_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize(
    ("unit", "pattern"),
    [("code_point", r"(?s)."), ("line", r"[^\n]*\n|[^\n]+"), ("word", r"(?a)^\s*\S+\s*|^\s+|\S+\s*")],
)
def test_cuts_by_units(unit, pattern):
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice("ab é漢\n \t😀") for _ in range(draw.randrange(60)))
        units = re.findall(pattern, text)
        assert "".join(units) == text
        index = TextIndex(text.encode(), Settings(unit=unit, block=draw.choice([1, 4, 16])))
        assert index.n == len(units)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_tree_sums():
    counts = np.arange(1, 38)
    tree = fill_middle.fenwick(counts)
    assert all(tree[i] == counts[i - (i & -i) : i].sum() for i in range(1, len(tree)))


def test_unknown_unit(odd):
    with pytest.raises(ValueError, match="no unit"):
        fill_middle.fill_in_middle(odd, Settings(unit="page"))
