import numpy as np

from tallymap.llm import mixing


def test_topics_come_from_whole_texts(spark):
    rng = np.random.default_rng(7)
    words = {k: [f"{k}{i}" for i in range(60)] for k in ("ship", "leaf")}
    rows = []
    for i in range(120):
        kind = "ship" if i % 2 else "leaf"
        opening = "Printed from the archive." if i < 60 else f"Opening{rng.integers(10**6)} line."
        rows.append((i, f"{opening}\n" + " ".join(rng.choice(words[kind], 80)), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    topics = {r.doc_id: r.topic for r in mixing.mixing_report(docs).collect()}
    ships, leaves = ({t for i, t in topics.items() if i % 2 == k} for k in (1, 0))
    assert ships and leaves and not ships & leaves
