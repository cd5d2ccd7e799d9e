import numpy as np

from tallymap.llm import shared, suffix_dedup

from . import brute


def test_texts_are_cut_in_one_step_some_rows_at_a_time(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), size=n))
    passages = [word(90) for _ in range(3)]
    texts = [word(30) + passages[i % 3] + word(30) if i % 4 else word(50) for i in range(300)]
    frame = spark.createDataFrame([*enumerate(texts), (300, None)], "doc_id long, text string").coalesce(1)
    cut = suffix_dedup.cut_texts(frame, 60)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a second worker for each task would hold the same texts again
    report = [tuple(r)[1:] for r in suffix_dedup.removal_report(frame, 60).orderBy("doc_id").collect()]
    assert report == brute.repeats([*texts, ""], 60)
    got = {r.doc_id: r.text for r in cut.collect()}
    spans = {i: r for i, r in enumerate(report)}
    assert got[300] is None and all((got[i] == t) == (spans[i][1] == 0) for i, t in enumerate(texts))
    assert all(len(got[i].encode()) <= spans[i][0] - spans[i][1] for i in range(300))


def test_pieces_have_every_row_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 5, 300)]
    pieces = list(shared.few_rows(iter(batches), 128))
    assert [x for p in pieces for x in p.column(0).to_pylist()] == [*range(5), *range(300)]
    assert max(p.num_rows for p in pieces) == 128
