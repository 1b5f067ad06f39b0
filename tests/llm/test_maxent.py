"""The maximum-entropy model against dense sums over its whole vocabulary."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import maxent as M

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def small(rows=16, seed=1):
    rng = random.Random(seed)
    names = [f"w{i}{rng.choice('abc')}ing" for i in range(900)] + ["x", "The", "é!"]
    texts = [" ".join(rng.choices(names, k=rng.randint(0, 40))) for _ in range(60)] + ["", "x x x"]
    counts = Counter(w for t in texts for w in [*WORD.findall(t.encode().lower()), M.END])
    words = sorted(counts, key=lambda w: (-counts[w], M.word_hash(w)))
    words.remove(M.END)
    own = [M.END, *words[: M.OWN - 1]]
    place = {w: divmod(own.index(w), M.MEMBERS) if w in own else (M.ending_class(w), M.word_hash(w) % M.MEMBERS) for w in counts}
    mass = np.zeros((M.CLASSES, M.MEMBERS))
    for w, c in counts.items():
        mass[place[w]] += c + 0.1
    head = np.array(sorted(M.word_hash(w) for w in counts), np.int64)
    of = {M.word_hash(w): c for w, c in counts.items()}
    v = M.Vocabulary(sum(counts.values()), len(counts), head, np.array([of[h] for h in head.tolist()]), np.array([M.word_hash(w) for w in own], np.int64), mass, rows)
    w = M.start_weights(v)
    w[: 6 * rows] = np.random.default_rng(seed).normal(0, 0.5, (6 * rows, M.MEMBERS))
    return texts, counts, place, v, w


def softmax_at(w, rows, start, at):
    z = [float(w[start, j]) + sum(float(w[r, j]) for r in rows) for j in range(M.MEMBERS)]
    top = max(z)
    return math.exp(z[at] - top) / sum(math.exp(x - top) for x in z)


def dense_probabilities(v, w, counts, place, history):
    """Of every word after a history (hashes of the word before and of the one before that), one at a time."""
    out = {}
    for word, c in counts.items():
        cls, member = place[word]
        h = np.array([*history[::-1], M.word_hash(word)], np.int64)
        rows, start, _ = M.decisions(h, np.array([len(h)]), np.array([0] * (len(h) - 1) + [cls]), np.array([0] * len(h)), v.rows)
        n = len(h)
        p = softmax_at(w, rows[n - 1], start[n - 1], cls) * softmax_at(w, rows[-1], start[-1], member)
        out[word] = p * (c + 0.1) / v.mass[cls, member] * (1 - 0.1 / v.total)
    return out


@pytest.mark.parametrize("history", [[], [5], [5, -7]])
def test_probabilities_add_up(history):
    _, counts, place, v, w = small()
    p = dense_probabilities(v, w, counts, place, history)
    assert sum(p.values()) + 0.1 / v.total == pytest.approx(1, abs=1e-4)


def test_scores_equal_dense_ones():
    texts, counts, place, v, w = small()
    texts = ["never seen w1ing x", texts[3], "", "THE the x"]
    t = M.tokenised(pa.array(texts))
    cls, member, c = (x[t.numbers] for x in M.Lexicon(v).of(t.h, t.ending))
    logs, at = M.token_logs(v, w, t.h[t.numbers], t.sizes, cls, member), 0
    for text in texts:
        words = [*WORD.findall(text.encode().lower()), M.END]
        for i, word in enumerate(words):
            history = [M.word_hash(x) for x in words[max(0, i - 2) : i][::-1]]
            if word in counts:
                want = dense_probabilities(v, w, {word: counts[word]}, place, history)[word]
                assert logs[at + i] + math.log10(counts[word] + 0.1) + v.log_known == pytest.approx(math.log10(want), abs=1e-4)
            else:
                assert c[at + i] == -1
        at += len(words)
    assert at == len(logs)


def test_step_follows_the_gradient():
    """A step equals one written out decision by decision, and lowers the loss."""
    texts, _, _, v, w = small()
    t = M.tokenised(pa.array(texts[:5]))
    cls, member, _ = (x[t.numbers] for x in M.Lexicon(v).of(t.h, t.ending))
    rows, start, chosen = M.decisions(t.h[t.numbers], t.sizes, cls, member, v.rows)
    loss = lambda w: -sum(math.log(softmax_at(w, r, s, c)) for r, s, c in zip(rows, start, chosen))
    gradient, touched = np.zeros(w.shape), Counter()
    for r, s, c in zip(rows, start, chosen):
        p = np.array([softmax_at(w, r, s, j) for j in range(M.MEMBERS)])
        p[c] -= 1
        for k in r:
            gradient[k] += p
            touched[int(k)] += 1
    want, got = w.astype(np.float64), w.copy()
    for k, n in touched.items():
        mean = gradient[k] / math.sqrt(n)
        want[k] -= M.RATE / math.sqrt((mean * mean).sum() + 1e-3) * mean
    seen = np.zeros(6 * v.rows, np.float32)
    M.step(got, seen, np.zeros(6 * v.rows, np.float32), rows, start, chosen)
    assert np.abs(got - want).max() < 1e-4 and {int(k): int(seen[k]) for k in np.flatnonzero(seen)} == dict(touched)
    small_step = w - 0.001 * (w - got)
    assert loss(small_step) < loss(w)


def test_rows_grow():
    assert [M.rows_for(n) for n in (0, 10**6, 7 * 10**7, 10**12)] == [M.LEAST_ROWS, M.LEAST_ROWS, 16384, M.MOST_ROWS]


def test_words_of_texts():
    texts = ["A b\x1cc   É\x0bz", None, "", " \n ", "a"]
    t = M.tokenised(pa.array(texts))
    assert t.sizes.tolist() == [5, 1, 1, 1, 2]
    want = [M.word_hash(w) for t in texts for w in [*WORD.findall((t or "").encode().lower()), M.END]]
    assert t.h[t.numbers].tolist() == want
    assert t.ending[t.numbers[0]] == M.ending_class(b"a") == M.ending_class(b"a,") == zlib.crc32(b"a") % 16 + 16


def test_words_in_stretches(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab. \t\n", k=rng.choice([0, 5, 4000]))) for _ in range(80)]
    want = M.tokenised(pa.array(texts))
    plain = M.slices
    monkeypatch.setattr(M, "slices", lambda d, e: plain(d, e, 50))
    got = M.tokenised(pa.array(texts))
    assert got.sizes.tolist() == want.sizes.tolist() and got.h[got.numbers].tolist() == want.h[want.numbers].tolist()
