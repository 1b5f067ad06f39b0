"""Labels by the thousand, of which a nested condition and a dense filter would be too deep and too wide."""

import random

import numpy as np

from meterlake.llm import langid


def test_many_labels(spark):
    own = lambda i: "".join(chr(0x4E00 + 8 * i + (j * j) % 8) for j in range(24))  # noqa: E731  letters of this label alone
    rows = [(i, own(i // 2), f"l{i // 2:04d}") for i in range(3000)] + [(-1, own(0), None), (-2, None, "l0000"), (-3, "123", "l0001")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert len(model.languages) == 1500 and len(model.slots) < 200_000
    found = {r.doc_id: r for r in langid.identified(df, model).collect()}
    assert len(found) == 3003
    assert all(found[i].lang_pred == f"l{i // 2:04d}" and found[i].score > 0.99 for i in range(3000))
    assert found[-1].lang_pred == "l0000" and found[-2].lang_pred == found[-3].lang_pred == "und"


def test_counts_of_few_and_many(spark):
    rnd = random.Random(5)
    for labels in (3, langid.DENSE, langid.DENSE + 9):
        texts = [("".join(rnd.choice("abcdefgh ") for _ in range(300)), f"l{i:02d}") for i in range(labels)]
        model = langid.learn(spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, text string, lang string"))
        assert model.languages == [x for _, x in texts] and (model.row is None) == (labels <= langid.DENSE)
        sets = [np.concatenate([*langid.grams(t)]) for t, _ in texts]
        for (t, _), own in zip(texts, sets):
            count, n = model.counted(t)
            assert n == len(own) and count.tolist() == [np.isin(own, s).sum() for s in sets]


def test_partitions_without_letters(spark):
    """A partition whose texts of a label have no letter has no n-grams of it to give, before others or alone."""
    rows = [(0, "12 34", "a"), (1, "some words here", "b"), (2, "", "b"), (3, "words again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    for part in (df, df.repartitionByRange(4, "doc_id")):
        model = langid.learn(part)
        assert model.languages == ["a", "b"] and model.predict("words again")[0] == "a" and model.predict("some words here")[0] == "b"
    assert langid.learn(df.where("doc_id IN (0, 2)")).predict("some words") == ("a", 0.0)
