"""Each query over a whole small table against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from compare import both, connection

from meterlake.llm import chat, line_dedup, telephony
from meterlake.llm import queries as Q

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_op1(spark, docs):
    rows = Q.op1_hypergeometric_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    want = {d[0]: (len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs}
    assert all((r.size, r.text_crc32) == want[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, docs):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in Q.op2_line_windows(spark, SF).collect()}
    seen, want = set(), {}
    for i, text, _ in docs:
        lines, covered = text.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                covered |= {p, p + 1, p + 2}
            seen.add(w)
        want[i] = (len(lines), len(covered), "\n".join(x for p, x in enumerate(lines) if p not in covered))
    assert got == want and any(x[1] for x in want.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert {r[0]: r[1:] for r in con.execute(line_dedup.oracle()).fetchall()} == want


def test_op3(spark, docs):
    text = {d[0]: (d[1] or "").encode() for d in docs}
    features = {}
    for r in Q.op3_telephony(spark, SF).collect():
        data = text[r.doc_id]
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes > len(payload)
        assert features.setdefault(data, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        if len(features) <= 60:  # sample by sample
            codec = r.feature.split(";")[0]
            pcm = [float(x) for x in slow_pcm(codec, payload)]
            twice = [max(-32768, min(32767, slow_between(pcm, i))) for i in range(2 * len(pcm))]
            stored = [int.from_bytes(r.pcm[k : k + 2], "little", signed=True) for k in range(0, len(r.pcm), 2)]
            assert len(stored) == len(twice) and max(abs(a - b) for a, b in zip(stored, twice)) <= 1 and stored[::2] == [int(x) for x in pcm]
            crossings = sum((a >= 0) != (b >= 0) for a, b in zip(stored, stored[1:]))
            rms = math.sqrt(sum(x * x for x in stored) / len(stored))
            assert r.feature == f"{codec};16000;{len(stored)};{rms:.3f};{max(map(abs, stored))};{crossings};{zlib.crc32(r.pcm):08x}"
    assert {f.split(";")[0] for _, f in features.values()} == set(telephony.CODECS)


def slow_pcm(codec, payload):
    """One sample at a time."""
    if codec != "adpcm":
        for b in payload:
            b ^= 0xFF if codec == "mulaw" else 0x55
            exponent, mantissa = b >> 4 & 7, b & 15
            if codec == "mulaw":
                size = ((2 * mantissa + 33) << exponent + 2) - 132
                yield -size if b & 0x80 else size
            else:
                size = (2 * mantissa + 1) * 8 if exponent == 0 else (2 * mantissa + 33) * 8 << exponent - 1
                yield size if b & 0x80 else -size
        return
    for at in range(0, len(payload), 64):
        block = payload[at : at + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        yield value
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + sum(s for bit, s in ((4, step), (2, step >> 1), (1, step >> 2)) if code & bit)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(telephony.INDEX_CHANGE[code & 7])))
                yield value


def slow_between(pcm, at):
    """The sample at a place of twice the rate: a windowed sinc of eight samples, silence outside."""
    whole, half = at // 2, (at % 2) / 2
    taps = [(k, (1.0 if k == half else math.sin(math.pi * (k - half)) / (math.pi * (k - half))) * (0.5 + 0.5 * math.cos(math.pi * max(-1, min(1, (k - half) / 4))))) for k in range(-3, 5)]
    total = sum(h for _, h in taps)
    return round(sum(h / total * pcm[whole + k] for k, h in taps if 0 <= whole + k < len(pcm)))


def test_op4(spark):
    turns = defaultdict(list)
    for c, t, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall():
        turns[c].append((role, text or ""))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = Q.op4_chat_round_trip(spark, SF).collect()
    assert sorted(r.conv_id for r in rows) == sorted(turns)
    for r in rows:
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert r.n_turns == len(t)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.formatted(t))


def brute_fingerprint(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_op5(spark, docs):
    fps = {d[0]: brute_fingerprint(d[1]) for d in docs}
    want = brute_components(fps)
    rows = Q.op5_golay_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want)


def test_op6(spark, docs):
    rows = {r.doc_id: r for r in Q.op6_bloom_language(spark, SF).collect()}
    right = total = 0
    for i, text, lang in docs:
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"
        elif r.held_out:
            total += 1
            right += r.lang_pred == lang
    assert right >= 0.95 * total


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer("byte_bpe_50k.json"))
    ids = {d[0]: t.encode(d[1] or "", add_special_tokens=False).ids + [1] for d in docs}
    rows = Q.op7_balanced_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for x, n in [*((pieces[i], len(ids[i])) for i in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(x):
            assert start == at
            at += length
        assert at == n if n is not None else at <= 2048
    padding = sum(0 if (n := sum(y for _, y in s)) & (n - 1) == 0 else 2048 - n for s in sequences.values())
    assert padding < 2048


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {r.doc_id: r for r in Q.op8_rank_array_bpe(spark, SF).collect()}
    for i, text, _ in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert rows[i].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_op9(spark, docs):
    rows = {r.doc_id: r for r in Q.op9_quality_cascade(spark, SF).collect()}
    for i, text, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(inside), failed)
        assert not (failed and r.kept)
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [rows[i] for i, q in quality.items() if q == 1 and not rows[i].base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_op10(spark, docs):
    tokens = {d[0]: [*WORD.findall(low(d[1])), None] for d in docs}
    out = {d[0]: zlib.crc32(str(d[0]).encode()) % 10 == 0 for d in docs}
    counts = Counter(x for i, t in tokens.items() if not out[i] for x in t)
    n, v = sum(counts.values()), len(counts)
    rows = Q.op10_maxent(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(t), sum(x in counts for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def least_of_near_copies(texts):
    """Least ids of the components of texts whose sets of five-word shingles have a similarity of 0.8 at least."""
    words = {i: WORD.findall(low(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if not sets[a] and not sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in ids}


def test_pipeline(spark, docs):
    """The stages against brute force, one after another; what the tokenizer and the language filter give is taken as it is."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "line dedup", "SimHash near-dedup", "packing"]
    columns = Q.documents(spark, SF).columns
    at, kept = Q.documents(spark, SF), {d[0]: d[1] for d in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, at, SF)
        assert after.columns == columns
        at = spark.createDataFrame(after.toPandas(), after.schema)
        got = {r.doc_id: r.text for r in at.collect()}
        assert len(got) == at.count() and set(got) <= set(kept)
        if k < 2:
            assert all(kept[i] == t for i, t in got.items())
        if k == 2:
            assert set(got) == set(kept)
            assert all(r.n_chars == len(r.text) for r in at.collect())
        if k == 3:
            assert set(got) == least_of_near_copies(kept)
        kept = got
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    """Queries with SQL of their own agree with it, over whole tables."""
    got, want, _, _ = both(spark, connection(SF), Q.QUERIES[name], Q.ORACLE_SQL[name], SF)
    assert got == want and want[1]
