"""Near copies with ordinary edits, in the pipeline's stage and in keys with many texts, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from meterlake.llm import minhash


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def survivors(texts):
    """Least place of each component of texts at 0.8."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if jaccard(x, sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def test_stage_drops_edited_copies(spark):
    rng = random.Random(3)
    texts = ["", " \n", "three words only", "Three  words ONLY"]
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        texts += [" ".join(words), " ".join(edited(rng, words, rng.randint(0, len(words) // 25)))]
    want = survivors(texts)
    assert 60 < len(want) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == want


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, words, rng.randint(0, 5))) for _ in range(300)] + [" ".join(edited(rng, words, 150)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(None, texts[7]), (7, texts[7])]
    left = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.doc_id for r in left.collect()) == Counter(survivors(texts))
    assert minhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_keys(spark, monkeypatch):
    """Families with most of their text in common: some nearly equal, some linked in chains, some just too far apart, all in
    keys with more texts than are compared in pairs; the groups are those of brute force."""
    monkeypatch.setattr(minhash, "BUCKET", 6)
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        shared = [f"s{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):  # about 0.65 to each other, each with a near copy
            own = shared + [f"o{rng.randrange(10**6)}" for _ in range(28)]
            texts += [" ".join(own), " ".join(edited(rng, own, 1))]
        chain = list(shared)
        for _ in range(25):  # a chain that leads away
            chain = edited(rng, chain, 2)
            texts.append(" ".join(chain))
        texts += [" ".join(edited(rng, shared, rng.randint(0, 3))) for _ in range(25)]
    rng.shuffle(texts)
    left = minhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = survivors(texts)
    assert {r.doc_id for r in left.collect()} == want and 10 < len(want) < len(texts) - 60
