"""Rows picked by number, of which only the smaller part is shuffled."""

import pytest

from meterlake.llm import minhash
from meterlake.llm.common import Stored, drop_stored


@pytest.mark.parametrize("words", [1, minhash.FILTER_WORDS])
@pytest.mark.parametrize("which", [lambda i: False, lambda i: i == 3, lambda i: i % 3 == 0, lambda i: i % 3 > 0, lambda i: True])
def test_some_of_all(spark, monkeypatch, words, which):
    monkeypatch.setattr(minhash, "FILTER_WORDS", words)
    before = len(Stored.kept)
    rows = [(i << 33 | i % 7, f"text {i}", f"w{i}", None) for i in range(200)]
    table = Stored(spark.createDataFrame(rows, "`row.number` long, n string, Filter_Word string, bits string"), "table").df
    every = spark.createDataFrame([r[:1] for r in rows], "row long")
    some = spark.createDataFrame([(r[0],) for i, r in enumerate(rows) if which(i)], "row long")
    out = minhash.picked(table, "row.number", some, every)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.collect())) == sorted(r for i, r in enumerate(rows) if which(i))
    drop_stored_since(before)


def drop_stored_since(before):
    for table in Stored.kept[before:]:
        table.drop()


def test_texts_that_stay_are_not_shuffled(spark):
    texts = [(i, " ".join(f"{i}x{k}" for k in range(30))) for i in range(60)]
    out = minhash.one_of_each(spark.createDataFrame([*texts, (99, texts[5][1])], "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("LeftAnti") == 1 and "LeftSemi" not in plan, plan
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))
    drop_stored()
