import numpy as np

from tallymap.llm import setsketch


def test_registers_of_a_union_are_the_merge():
    settings = setsketch.Settings()
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 40, 3000)]
    sets += [np.concatenate((sets[1][:20], sets[2][:100])), np.empty(0, np.uint64)]
    registers = np.array([setsketch.sketch(np.unique(s), settings) for s in sets])
    union = setsketch.sketch(np.unique(np.concatenate(sets)), settings)
    assert (setsketch.merged(registers) == union).all()
    assert (setsketch.merged(registers[::-1][:3]) == setsketch.merged(registers[2:])).all()


def test_a_callers_columns_stay(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "a", "b", "c", 1), (2, text + " more", "d", "e", "f", 2), (3, "", "g", "h", "i", 3), (4, None, "j", "k", "l", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node string, _root string, row string, id int")
    kept = setsketch.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3]]
