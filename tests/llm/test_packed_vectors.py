import numpy as np

from tallymap.llm import mixing


def test_packed_vectors_are_small_and_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{rng.integers(200)}" for _ in range(100))) for i in range(300)]
    rows += [rows[3], rows[3], (None, None), (None, ""), (300, " ".join(f"v{k} " * k for k in range(1, 320)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    measured = mixing._measured(docs, 0).select("mix_row", "mix_words")
    packed = mixing._packed(mixing._once(measured)).toArrow()
    vectors = {r.mix_row: np.frombuffer(r.mix_words, mixing.WORDS) for r in measured.collect()}
    entries = sum(map(len, vectors.values()))
    assert sum(len(cell.as_py()) for name in ("at", "code") for cell in packed[name]) < 3.5 * entries
    rarity = rng.random(mixing.BUCKETS)
    seen = []
    for hashes, row, at, weight in mixing._unpacked(packed.to_batches(), rarity):
        seen += hashes.tolist()
        for k, h in enumerate(hashes.tolist()):
            found = vectors[h]
            want = found["log"] * rarity[found["at"]]
            assert at[row == k].tolist() == found["at"].tolist()
            assert np.allclose(weight[row == k], mixing.ONE * want / (np.linalg.norm(want) or 1), rtol=0, atol=0.51)
    assert sorted(seen) == sorted(vectors) and len(seen) == 302  # equal rows once
