"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterlake.llm import bpe, chat, langid, line_dedup, maxent, minhash, packing, pieces, quality, sharding, simhash, telephony
from meterlake.llm import queries as Q

LONG = "word %d and more text here\n" * 3
SCHEMA = "doc_id long, text string, lang string, row string, block int, fp long, cell string, n_tokens int, score string"


def table(spark, rows=None):
    long = "".join(f"Line {i % 97} of a very long text, with words {i}.\n" for i in range(20_000))
    rows = rows if rows is not None else [
        (1, None, None, "a", 1, 1, "c", 1, "s"),
        (None, "no id but some text in it", "en", "a", 1, 1, "c", 1, "s"),
        (2, "", "en", None, None, None, None, None, None),
        (3, " \n\t ", "en", "a", 1, 1, "c", 1, "s"),
        (4, long, "en", "a", 1, 1, "c", 1, "s"),
        (5, "the same text twice over here today", "en", "a", 1, 1, "c", 1, "s"),
        (5, "the same text twice over here today", "en", "a", 1, 1, "c", 1, "s"),
        (6, "the same text twice over here today", "en", "a", 1, 1, "c", 1, "s"),
        (7, "1234 5678 !!", None, "a", 1, 1, "c", 1, "s"),
        (8, "Ünïcode Σίσυφος ΣΑΣ İ ǅ 日本語 \x1c\x1d x\u00a0y e\u0301 <|endoftext|>  two", "de", "a", 1, 1, "c", 1, "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_sharding(spark):
    df = table(spark)
    out = sharding.uniform_shards(df, 3)
    rows = out.collect()
    assert out.columns == [*df.columns, "shard", "slot"] and len(rows) == 10
    assert sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    assert sharding.uniform_shards(table(spark, []), 3).count() == 0


def test_sharding_is_uniform(spark):
    ids = spark.range(0, 30, 1, 5)
    places = [{r.id: (r.shard, r.slot) for r in sharding.uniform_shards(ids, 3, seed=s).collect()} for s in range(12)]
    assert all(len(set(p.values())) == 30 for p in places)
    first = Counter(p[i][0] for p in places for i in range(6))
    assert min(first.values()) >= 10  # 24 expected of 72


def test_matrix():
    for seed in range(5):
        m = np.array(sharding.communication_matrix([5, 0, 17, 8], [10, 10, 10], seed))
        assert m.sum(1).tolist() == [5, 0, 17, 8] and m.sum(0).tolist() == [10, 10, 10] and m.min() >= 0
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 10, 20, 12) for _ in range(4000)]
    assert abs(np.mean(draws) - 4) < 0.1 and abs(np.var(draws) - 12 * (1 / 3) * (2 / 3) * 18 / 29) < 0.15
    chance = [math.comb(10, k) * math.comb(20, 12 - k) / math.comb(30, 12) for k in range(11)]
    assert sum((draws.count(k) - 4000 * p) ** 2 / (4000 * p) for k, p in enumerate(chance) if 4000 * p > 5) < 25
    n = 10**12
    far = [sharding.hypergeometric(rng, n // 4, 3 * n // 4, n // 2) for _ in range(200)]
    assert abs(np.mean(far) - n / 8) < 5 * math.sqrt(n * 3 / 64 / 200)
    big = sharding.communication_matrix([2 * 10**9, 10**9, 7, 0], [10**9 + 7, 10**9, 10**9], 0)
    assert [sum(c) for c in zip(*big)] == [10**9 + 7, 10**9, 10**9] and [sum(r) for r in big] == [2 * 10**9, 10**9, 7, 0]


def test_split_draw_is_the_same_law(monkeypatch):
    """Where the table is split before numpy draws, cells have the means and variances of the one law."""
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 20)
    split = np.array([sharding.communication_matrix([5, 9, 17, 8], [20, 12, 7], s) for s in range(4000)])
    assert (split.sum(2) == [5, 9, 17, 8]).all() and (split.sum(1) == [20, 12, 7]).all()
    for i, n in enumerate([5, 9, 17, 8]):
        for j, c in enumerate([20, 12, 7]):
            mean, variance = n * c / 39, n * (c / 39) * (1 - c / 39) * (39 - n) / 38
            assert abs(split[:, i, j].mean() - mean) < 4 * math.sqrt(variance / 4000)
            assert abs(split[:, i, j].var() / variance - 1) < 0.12


def test_copies_are_dealt_like_any_rows(spark):
    """4,000 rows of four values: every value has its share in every shard."""
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 4).alias("value"))
    found = Counter((r.value, r.shard) for r in sharding.uniform_shards(rows, 8, rows_per_cell=100).collect())
    assert sum((found[v, s] - 125) ** 2 / 125 for v in range(4) for s in range(8)) < 60  # 99.9 % of 21 degrees: 47


def test_line_dedup(spark):
    df = table(spark).withColumnRenamed("row", "n_removed").withColumnRenamed("cell", "lines")
    out = {(r.doc_id, r.text is None): r for r in line_dedup.drop_repeated_windows(df).collect()}
    assert out[(1, True)].n_lines == 0 and out[(2, False)].text == "" and out[(2, False)].n_lines == 1
    assert out[(4, False)].n_removed == 0 and out[(4, False)].lines == "c"
    assert line_dedup.drop_repeated_windows(table(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "a\na\na"), (2, "a\na\na"), (3, "x\na\na\na\ny")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_windows(same).collect()) == [(1, "a"), (2, ""), (2, ""), (3, "x\ny")]


def test_telephony(spark):
    df = table(spark)
    media = telephony.telephony_stored(df)
    out = telephony.telephony_decoded(media).collect()
    assert len(out) == 10 and all(r.rate == 16000 and len(r.pcm) == 4 * r.n_samples for r in out)
    assert telephony.telephony_decoded(telephony.telephony_stored(table(spark, []))).count() == 0
    digest = telephony.telephony_digest(telephony.telephony_decoded(media)).collect()
    assert len(digest) == 10 and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= r.n_bytes for r in digest)


def test_telephony_bad_files(spark):
    """What isn't a mono telephony WAV gives nulls, and a clip without samples an empty PCM; no task dies."""
    good = telephony.write_wav(bytes(range(64)) * 3, "mulaw")
    form = lambda codec, channels=1, rate=8000, block=1, bits=8: struct.pack("<HHIIHH", codec, channels, rate, rate, block, bits)
    wav = lambda form, data: b"RIFF" + struct.pack("<I", 28 + len(form) + len(data)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    bad = [b"RIFF", None, b"", *[good[:n] for n in range(0, len(good), 3)], wav(form(7, channels=2, block=2), b"ab"), wav(form(1, block=2, bits=16), b"ab"), wav(form(7)[:10], b"ab"), wav(form(0x11, block=64, bits=4), b"a" * 65), wav(form(0x11, block=4, bits=4), b"a" * 64)]
    empty = [wav(form(7), b""), wav(form(6), b""), wav(form(0x11, block=64, bits=4), b"")]
    larger = wav(form(0x11, block=256, bits=4), bytes(range(256)) * 2)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, *empty, larger, good])], "i int, media binary")
    rows = sorted(telephony.telephony_decoded(df).collect())
    assert all(r.codec is None and r.pcm is None for r in rows[: len(bad)])
    assert all(r.n_samples == 0 and r.pcm == b"" for r in rows[len(bad) : -2])
    assert rows[-2].n_samples == 2 * 505 and len(rows[-2].pcm) == 4 * 1010 and rows[-1].n_samples == 192
    assert telephony.telephony_digest(telephony.telephony_decoded(df)).count() == len(rows)


def test_telephony_codecs():
    mu, a = telephony.table("mulaw"), telephony.table("alaw")
    assert (mu[0xFF], mu[0x80], mu[0x00], mu[0x7F]) == (0, 32124, -32124, 0)
    assert (a[0xD5], a[0xAA], a[0x2A], a[0x55]) == (8, 32256, -32256, -8)
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    got = telephony.adpcm(blocks)
    for b, row in zip(blocks, got):  # one sample at a time
        value, index, want = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88), []
        want.append(value)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = step >> 3
                for bit, s in ((4, step), (2, step >> 1), (1, step >> 2)):
                    change += s if code & bit else 0
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code & 7])))
                want.append(value)
        assert row.tolist() == want
    tone = (10000 * np.sin(np.arange(4000) * 0.3)).astype(np.int16)
    up = telephony.resampled(tone, 2, 1)
    assert len(up) == 8000 and np.abs(up[::2][10:-10].astype(int) - tone[10:-10]).max() <= 1
    assert np.abs(up[101:7901:2] - 10000 * np.sin((np.arange(50, 3950) + 0.5) * 0.3)).max() < 300
    assert len(telephony.resampled(tone, 3, 2)) == 6000 and len(telephony.resampled(tone[:1], 2, 1)) == 2


def test_telephony_pieces(monkeypatch):
    """A clip that is decoded and resampled piece by piece gives the PCM of the whole."""
    rng = np.random.default_rng(2)
    for codec in telephony.CODECS:
        wav = telephony.read_wav(telephony.write_wav(rng.integers(0, 256, 64 * 150, dtype=np.uint8).tobytes(), codec))
        pcm = np.concatenate(list(telephony.pcm_pieces(wav)))
        monkeypatch.setattr(telephony, "PIECE", 1000)
        for up, down in ((2, 1), (1, 2), (3, 4), (2, 3)):
            got = np.concatenate(list(telephony.resampled_pieces(telephony.pcm_pieces(wav), up, down)))
            assert np.array_equal(got, telephony.resampled(pcm, up, down))
        monkeypatch.undo()


def test_chat(spark):
    nasty = ["\\", "\\\\### ", "</turn>", "\n</turn>\n", "### User: x\n</turn>\n### Assistant: y", "####", "\\</turn>\\", "", "\\### Assistant: </turn> ok", "x\n</turn", "\\\\\\"]
    for a in nasty:
        for b in nasty:
            turns = [("user", a), ("assistant", b), ("tool: 1\n", a), ("", b), ("User", a)]
            assert chat.read_back(chat.formatted(turns)) == turns
    rng = random.Random(3)
    for _ in range(500):
        t = [(rng.choice(["user", "assistant", "x y"]), "".join(rng.choices(["\\", "#", "###", "</turn>", "\n", " ", "a", "/", "<", ": "], k=rng.randint(0, 12)))) for _ in range(rng.randint(0, 5))]
        assert chat.read_back(chat.formatted(t)) == t
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "hi"), (None, 0, "assistant", "a"), (None, 0, "assistant", "b"), (2, None, "assistant", "z")], "conv_id long, turn long, role string, text string")
    rows = chat.chat_digest(chat.chat_format(df)).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in rows) == [(0, 1, 1), (0, 1, 1), (1, 3, 0), (2, 1, 1)]
    assert chat.chat_format(df.limit(0)).count() == 0


def test_simhash(spark):
    df = table(spark)
    rows = simhash.near_duplicate_classes(df).collect()
    assert len(rows) == 10
    c = {r.doc_id: r.component for r in rows}
    assert c[5] == c[6] == 5 and c[1] == c[2] == c[3] == 1
    left = simhash.one_of_each(df)
    assert left.columns == df.columns and Counter(r.doc_id for r in left.collect()) == Counter([1, None, 4, 5, 7, 8])
    assert simhash.near_duplicate_classes(table(spark, [])).count() == 0


def test_golay_loses_no_pair():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 2)):
            b ^= 1 << bit
        keys, owner = simhash.keys_of(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_hot_bucket_and_chain(spark):
    """200 fingerprints in one bucket, in a chain of single bits and in a ball; and a long chain of nodes."""
    rng = random.Random(9)
    base, fps = rng.getrandbits(64), set()
    x = base
    for i in range(150):
        x ^= 1 << rng.randrange(41, 64) if i % 5 else 1 << rng.randrange(0, 20)
        fps.add(x)
    fps |= {base ^ (1 << i) ^ (1 << j) for i in range(18, 30) for j in range(i)}
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    nodes = simhash.stored(spark.createDataFrame([(v,) for v in signed], "fp long"), "nodes")
    roots = {r.node: r.root for r in simhash.components(simhash.linked_pairs(nodes)).collect()}
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                parent[root(a)] = root(b)
    groups = lambda f: {frozenset(v for v in signed if f(v) == r) for r in set(map(f, signed))}
    assert groups(lambda v: roots.get(v, v)) == groups(root)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0, 100}


def test_language(spark):
    df = table(spark)
    model = langid.learn(df)
    rows = {r.doc_id: r for r in langid.identified(df, model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == rows[7].lang_pred == "und" and rows[4].lang_pred == "en"
    assert langid.identified(df, langid.learn(table(spark, []))).where("lang_pred <> 'und'").count() == 0
    assert langid.identified(table(spark, []), model).count() == 0


def test_packing(spark):
    path = Q.tokenizer("byte_bpe_50k.json")
    rows = packing.pack(table(spark), path).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter([1, None, 2, 3, 4, 5, 5, 6, 7, 8])
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows if r.doc_id in (1, 2)}
    assert ids == {1: [1], 2: [1]}
    assert packing.pack(table(spark, []), path).count() == 0
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["a  b", "x <|endoftext|> y<|endoftext|>", " lead", "tail ", "a \n b\n\n c", "a\t b", "", " ", "it's 12½² Ünï ", "a \u00a0b \u2003 c"]
    assert encodings(e, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packed_by_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 500)
    pieces = packing.packed(lengths)
    total = sum(p[2] for p in pieces)
    assert total == lengths.sum() and len({p[3] for p in pieces}) == -(-total // 2048)
    costs = Counter()
    for item, start, n, k, offset in pieces:
        costs[k] += packing.cost(n)
    spread = np.array(list(costs.values()))
    assert spread.std() / spread.mean() < 0.25


def test_bpe(spark, monkeypatch):
    path = Q.tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(path), bpe.word_bpe(path)
    rng = random.Random(2)
    texts = [r.text or "" for r in table(spark).collect()] + ["a" * 3000, "ab" * 1000 + " " + "é" * 500, "<|startoftext|>x<|endoftext|>'LL", "don't WE'LL ½² ﬁ ǅ \u0085x\u2028y \u200b z"]
    texts += ["".join(rng.choices("abé'sS. \t日1½#\u0301\x1c", k=60)) for _ in range(200)]
    for text, got in zip(texts, encodings(b, texts)):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got == ids, text[:80]
        assert b.decode(got) == t.decode(ids, skip_special_tokens=False)
    out = bpe.encoded(table(spark), path)
    assert out.count() == 10 and bpe.encoded(table(spark, []), path).count() == 0
    for n in (1, 2, 22, 126, 127, 128, 129, 130, 300):  # on both sides of the length that the array is for
        for letters in ("ab", "abracdé", "etaoinshrdlu"):
            parts = [b.symbols[x] for x in "".join(rng.choices(letters, k=n)).encode()]
            monkeypatch.setattr(bpe, "SHORT", 10**9)
            by_array = b.merged(parts)
            monkeypatch.undo()
            assert by_array == b._merged_long(parts) == b.merged(parts)


def encodings(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point(name):
    """Ids equal the library's whatever Unicode tables Python follows."""
    from tokenizers import Tokenizer

    path = Q.tokenizer(name)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    encoder = packing.WordIds(path) if name.startswith("byte") else bpe.WordBpe(path)
    points = [chr(c) for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in (0xE0001, 0xE0100, 0xF0000, 0x10FFFD)]
    texts = [f"a{c}b {c}1 {c}{c}'s e{c}\u0301" for c in points]
    assert encodings(encoder, texts) == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stretches_of_a_long_text(monkeypatch, name):
    """However short the stretches that are cut together, the ids are those of the whole."""
    path = Q.tokenizer(name)
    encoder = packing.WordIds(path) if name.startswith("byte") else bpe.WordBpe(path)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abé'sre \t\n1#Ü ", k=rng.choice([0, 3, 50, 3000]))) for _ in range(200)] + ["x" * 5000, ""]
    want = encodings(encoder, texts)
    assert [encodings(encoder, [x])[0] for x in texts] == want
    plain = pieces.slices
    for limit in (7, 100, 1000):
        monkeypatch.setattr(pieces, "slices", lambda d, e, limit=limit: plain(d, e, limit))
        assert encodings(encoder, texts) == want


def test_quality(spark):
    out = quality.judged(table(spark), measures=True)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[4].n_words == 200_000
    assert quality.judged(table(spark, [])).count() == 0
    names = list(quality.RULES)
    a = quality.judged(table(spark), order=names).collect()
    assert a == quality.judged(table(spark), order=names[::-1]).collect()
    assert quality.ordered([("a", 1.0, 5, 9), ("b", 0.1, 1, 9), ("c", 1.0, 0, 9)]) == ["b", "a", "c"]


def test_maxent(spark):
    df = table(spark)
    rows = {r.doc_id: r for r in maxent.maxent_scores(df, F.col("doc_id") != 7).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 1 and rows[7].n_known == 1
    none = maxent.maxent_scores(df, F.lit(False)).collect()
    assert len(none) == 10 and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(r.base_score) for r in none)
    assert maxent.maxent_scores(table(spark, []), F.lit(True)).count() == 0


def test_maxent_tail_join_is_exact(spark, monkeypatch):
    """With hardly any head, all counts come through the join and nothing changes."""
    df = spark.createDataFrame([(i, f"a b c word{i % 7} word{i % 3} a") for i in range(40)] + [(99, "new a")], "doc_id long, text string")
    a = {r.doc_id: r for r in maxent.maxent_scores(df, F.col("doc_id") < 99).collect()}
    monkeypatch.setattr(maxent, "HEAD", 2)
    b = {r.doc_id: r for r in maxent.maxent_scores(df, F.col("doc_id") < 99).collect()}
    for i in a:
        assert a[i].n_known == b[i].n_known and a[i].base_score == pytest.approx(b[i].base_score)


def test_adpcm_together_is_alone(spark):
    rng = np.random.default_rng(4)
    files = [telephony.write_wav(rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes(), "adpcm") for n in (1, 7, 300)]
    got = telephony.adpcm_together([telephony.read_wav(files[0]), None, telephony.read_wav(files[1]), None, telephony.read_wav(files[2])])
    assert sorted(got) == [0, 2, 4]
    for i, f in zip((0, 2, 4), files):
        assert (got[i] == np.concatenate(list(telephony.pcm_pieces(telephony.read_wav(f))))).all()


def test_chat_long_runs():
    """A megabyte of backslashes, and of control strings, in linear time."""
    for text in ("\\" * 10**6, "\\" * 10**6 + "###", "###" * 300_000, "</turn>\n" * 100_000, "\\###" * 200_000):
        turns = [("user", text), ("assistant", text)]
        assert chat.read_back(chat.formatted(turns)) == turns


INSIDE = "n.dot doc_id text id _id th _th at l w h1 h2 first starts covered_id covered_hash n_lines n_removed lines text_hash drop_places fp component row row_number stay_row least_id root node keys k a b start length ids_crc32 doc_tokens sequence_id offset padded_to ids block n_turns formatted loss_spans alone turns tokens known base model tail n_tokens n_known train_tokens base_score score kept lang lang_pred lang_given held_out codec rate n_samples pcm media n_bytes shard slot cell x g s turn role decoded ids_sha256 c0 c1 draw"


def clashing(spark, id_name):
    """Three rows whose extra columns have every name that an operator uses inside, and an id of the given name."""
    names = [id_name, "text", *[x for x in INSIDE.split() if x not in (id_name, "text")]]
    texts = ["one line of some words here\nthe second line\nthird line\nfourth one", "another text of words that are not the same", None]
    return spark.createDataFrame([(i, t, *["extra"] * (len(names) - 2)) for i, t in enumerate(texts)], ", ".join(f"`{n}` {'long' if k == 0 else 'string'}" for k, n in enumerate(names)))


@pytest.mark.parametrize("id_name", ["doc_id", "start", "fp", "row", "n_tokens", "row.id"])
def test_clashing_names(spark, id_name):
    df = clashing(spark, id_name)
    outs = {
        "lines": line_dedup.drop_repeated_windows(df, id_name),
        "packed": packing.pack(df, Q.tokenizer("byte_bpe_50k.json"), id_name),
        "scores": maxent.maxent_scores(df, F.lit(True), id_name),
        "classes": simhash.near_duplicate_classes(df, id_name),
    }
    if id_name == "doc_id":  # the others take no id, or use it alike
        outs |= {
            "shards": sharding.uniform_shards(df, 2),
            "media": telephony.telephony_digest(telephony.telephony_decoded(telephony.telephony_stored(df))),
            "one": simhash.one_of_each(df, id_name),
            "near": minhash.one_of_each(df, id_name),
            "language": langid.identified(df, langid.learn(df, lang_col="lang", id_col=id_name)),
            "encoded": bpe.encoded(df, Q.tokenizer("word_bpe_49k.json")),
            "judged": quality.judged(df, measures=True),
        }
        assert outs["one"].columns == outs["near"].columns == df.columns
        assert set(df.columns) <= set(outs["shards"].columns)
    for name, out in outs.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        assert len(out.collect()) == 3, name
    turns = df.withColumn("turn", F.lit(1)).withColumn("role", F.lit("user"))
    out = chat.chat_format(turns, id_name)
    assert out.count() == 3 and len(set(out.columns)) == 4


def test_clashing_chat_ids(spark):
    for name in ("n_turns", "formatted", "loss_spans", "_conv.id"):
        df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], f"`{name}` long, turn long, role string, text string")
        out = chat.chat_format(df, name)
        assert out.columns[0] == (given := name if name == "_conv.id" else f"_{name}") and chat.chat_digest(out, given).collect()[0].loss_chars == 1


def test_clashing_pipeline_columns(spark):
    import corpus_pipeline

    df = clashing(spark, "doc_id").withColumn("n_chars", F.lit(0).cast("long")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns, name
        assert all(r.kept == r.score == r.stay_row == r.n_lines == r.lang_given == "extra" for r in out.collect()), name
        assert stage(spark, df.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.packing_stage(spark, df, "").count() == 3


def test_language_by_sets(spark):
    """Predictions and scores equal a version with sets of n-grams for each language, where the filter has no false positives."""
    rng = random.Random(8)
    parts = {"aa": "ka ke lo mi", "bb": "tra stu pli ka", "cc": "öx üz ka ñe"}
    rows = [(i, "".join(rng.choices(parts[x].split() + [" ", ". "], k=rng.randint(5, 60))), x) for i, x in enumerate(rng.choices(list(parts), k=150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        out, gap = [], True
        for c in text.lower():
            if c.isalpha():
                out.append(c)
                gap = False
            elif not gap or not out:
                out.append(" ")
                gap = True
        out = [" ", *out, " "]
        squeezed = [c for i, c in enumerate(out) if c != " " or i == 0 or out[i - 1] != " "]
        squeezed += [" "] * (4 - len(squeezed))
        return [g for i in range(len(squeezed) - 3) if (g := "".join(squeezed[i : i + 4])).strip() and " " not in g[1:3]]

    n = Counter(x for _, _, x in rows)
    texts = Counter((x, g) for _, t, x in rows for g in set(grams(t)))
    known = {x: {g for (y, g), k in texts.items() if y == x and k >= max(1, int(langid.MIN_SHARE * n[x]))} for x in sorted(parts)}
    model = langid.learn(df)
    assert model.languages == sorted(parts) and (model.false < 1e-6).all()
    tests = [t for _, t, _ in rows] + ["ka", "k", "xyz wv", "KA KE lo, mi! 123"]
    for t in tests:
        g = grams(t)
        share = {x: sum(a in known[x] for a in g) / max(1, len(g)) for x in known}
        lang, score = model.predict(t)
        assert score == pytest.approx(max(share.values()), abs=1e-5) and share[lang] == max(share.values()), t
    # Bits: every language that has an n-gram is in its mask.
    h = np.unique(np.concatenate([x for t in tests for x in langid.grams(t)]))
    bits = model.masks(h)
    for i, x in enumerate(model.languages):
        own = np.unique(np.concatenate([a for _, t, y in rows if y == x for a in langid.grams(t)]))
        assert (bits[np.isin(h, own), 0] & (1 << i)).all()


def test_language_sample_is_of_rows(spark, monkeypatch):
    """The sample doesn't depend on partitions."""
    monkeypatch.setattr(langid, "SAMPLE", 20)
    df = spark.createDataFrame([(i, f"text number {'abcdefghij'[i % 10] * 5} of {i}", "xy"[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    a, b = langid.learn(df.repartition(1)), langid.learn(df.repartition(7))
    assert (a.slots == b.slots).all() and a.slots.any()
