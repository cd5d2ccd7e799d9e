import numpy as np

from tallymap.llm import suffix_dedup

from . import brute


def test_hot_keys_are_dealt_on_by_window(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), size=n))
    passage = word(300)
    texts = [word(60) + passage + word(60) for _ in range(40)]
    texts += [texts[0], texts[0][:200], word(150), "ab" * 100, passage[:120] * 2]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, 4000, 1 << 22):
        got = [tuple(r)[1:] for r in suffix_dedup.removal_report(frame, 60, hot).orderBy("doc_id").collect()]
        assert got == brute.repeats(texts, 60)
