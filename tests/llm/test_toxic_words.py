from collections import Counter

import numpy as np

from tallymap.llm import toxicity


def test_training_reads_whole_texts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["an", "the", "ing", "or", "es"], 3000), rng.choice(["lyest", "edward", "stone", "output"], 3000), strict=True)]
        bad = [str(rng.choice(["horridword", "nastyterm", "vileinsult"])) for _ in range(8)] if i % 2 else []
        rows.append((i, " ".join(words + bad), i % 2))
    assert min(len(t) - 8 * 11 for _, t, _ in rows) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()
    held = [r.predicted == rows[r.doc_id][2] for r in got if r.held_out]
    assert len(held) > 40 and sum(held) >= 0.95 * len(held)


def test_class_words_go_by_rates():
    words = {0: Counter({b"the": 3000, b"quoted": 1, b"few": 2}), 1: Counter({b"the": 3000, b"quoted": 1000, b"bad": 9, b"few": 2})}
    found = toxicity.class_words(words, Counter({0: 3000, 1: 3000}), 1, toxicity.Settings().excess)
    assert found == {b"quoted", b"bad"}
    toxic, ordinary = toxicity._dictionaries(words, Counter({0: 3000, 1: 3000}), toxicity.Settings())
    assert b"quoted" in toxic and b"quoted" not in ordinary


def test_pieces_of_long_tokens_overlap():
    for at in range(300):
        token = b"x" * at + b"horridword" + b"y" * (300 - at)
        assert any(b"horridword" in w for w in toxicity.windows(token))
        assert token.startswith(toxicity.windows(token)[0]) and token.endswith(toxicity.windows(token)[-1])


def test_clearest_class_words_are_known_whole():
    rng = np.random.default_rng(4)
    parts = ["an", "the", "ing", "or", "es", "ly", "tion", "er", "wh", "st"]
    weak = {"".join(rng.choice(parts, 4)).encode() for _ in range(4000)}
    clear = b"idiot worthless moron clown trash pathetic disgusting stupid loser".split()
    words = {0: Counter({b"the": 9000, b"of": 8000}), 1: Counter({b"the": 1000, b"of": 900} | dict.fromkeys(weak, 6) | dict.fromkeys(clear, 300))}
    toxic, ordinary = toxicity._dictionaries(words, Counter({0: 9000, 1: 1000}), toxicity.Settings())
    assert sum(map(len, weak)) > toxicity.Settings().class_bytes
    assert all(toxicity.START + w + toxicity.START in toxic and w not in ordinary for w in clear)
    distance = toxicity.Distance(toxicity.Model(toxic, ordinary, (), toxicity.Settings().level))
    assert all(distance[w] > 0 for w in clear) and distance[b"the"] == 0
