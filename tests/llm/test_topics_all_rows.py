import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"


def kinds(spark, n):
    """Texts of six kinds with words of their own, null, empty and repeated ones."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"k{i % 6}x{rng.integers(30)}" for _ in range(12)), "en", "s") for i in range(n)]
    rows += [(None, None, "en", "s"), (n, "", None, None), (n, " \n", "en", "s"), rows[3], rows[3], (n + 1, "long" * 12, "en", "s")]
    return spark.createDataFrame(rows, DOCS)


def vectors(texts):
    """Counts by class of words, plainly."""
    counts = np.zeros((len(texts), mixing.BUCKETS))
    buckets = mixing._Buckets()
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            for part in [word] if len(word) <= mixing.LONGEST else (word[k : k + 2] for k in range(len(word) - 1)):
                counts[i, buckets[part]] += 1
    return counts


def test_rarity_and_centres_come_from_all_rows(spark):
    docs = kinds(spark, 5000)
    topics = mixing.fit_topics(mixing._measured(docs, 0))
    counts = vectors([r.text for r in docs.distinct().orderBy(F.col("doc_id").asc_nulls_last()).collect()])
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0)))
    assert topics.rarity == pytest.approx(rarity, rel=1e-9)
    x = np.log1p(counts) * rarity
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(length > 0, length, 1)
    centres = topics.centres / np.linalg.norm(topics.centres, axis=1, keepdims=True)
    nearest = np.argmax(np.round(x @ centres.T, 9), axis=1)
    before = (x * centres[nearest]).sum()
    sums = np.array([x[nearest == k].sum(axis=0) for k in range(len(centres))])
    assert np.linalg.norm(sums, axis=1).sum() == pytest.approx(before, rel=2e-3)  # a further round gains next to nothing
    of_kind = [set(nearest[k:5000:6]) for k in range(6)]
    assert sum(map(len, of_kind)) == len(set().union(*of_kind)) and all(of_kind)
    words = F.col("mix_words")
    placed = mixing._measured(docs, 0).select(mixing.topic_of(words, topics).alias("topic"), "doc_id").where("doc_id < 5000").collect()
    assert {(r.doc_id % 6, r.topic) for r in placed} == {(k, t) for k in range(6) for t in of_kind[k]}


def test_a_fit_does_not_depend_on_how_rows_are_dealt(spark):
    docs = kinds(spark, 300)
    one, other = (mixing.fit_topics(mixing._measured(d, 0)) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)))
    assert np.array_equal(one.centres, other.centres) and np.array_equal(one.rarity, other.rarity)


@pytest.mark.parametrize("texts", [[], [None], ["", " "], ["same words"] * 3])
def test_few_texts(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    assert {r.topic for r in mixing._placed(mixing._measured(docs, 0)).collect()} == ({0} if texts else set())
