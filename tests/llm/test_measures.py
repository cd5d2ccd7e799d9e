import re

import numpy as np
import pytest

from tallymap.llm import mixing

ODD = [
    "", " ", "\t\n", "a\x1cb c", "　x  y", "\x85", "İSTANBUL ΣΑΣ .,x.,", "...", "!(a)[b]!", "x" * 24, "x" * 25, "é" * 24,
    "é" * 25, "日本語" * 20 + " a " + "b" * 30 + ".", "." * 30, "a\xa0b", "😀" * 25 + " 😀", "a  b\r\nc\x0bd\x0ce", "ab." * 40, "\x00 a\x00",
]


@pytest.mark.parametrize("letters", ["ab.,(]é日😀 \t\x1c　İΣ", "ab.é日", "ab "])
def test_many_texts_at_once_are_measured_as_one_by_one(letters):
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list(letters), int(n))) for n in rng.integers(0, 150, 300)]
    buckets = mixing._Buckets()
    tokens, found, sizes = mixing.measure(texts)
    ends = np.cumsum(sizes)
    for text, n, size, end in zip(texts, tokens, sizes, ends, strict=True):
        assert n == len(re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").split(" ")), repr(text)
        counts = mixing.word_counts(text, buckets)
        entries = found[end - size : end]
        assert entries["at"].tolist() == np.flatnonzero(counts).tolist(), repr(text)
        assert np.array_equal(entries["log"], np.log1p(counts[entries["at"]]).astype(np.float32))


def test_no_texts():
    assert [len(x) for x in mixing.measure([])] == [0, 0, 0]
