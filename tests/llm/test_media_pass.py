"""Media decoded and digested in one pass, within bounded batches."""

import os

import pyarrow as pa
from meterlake.llm import telephony


def test_media_of_one_pass(spark):
    texts = [None, "", "x", "ab" * 40, "é\n" * 900, "mno" * 100_000] + [f"text {i} " * i for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "x")], "`n.dot` int, text string")
    media = telephony.telephony_stored(df).drop("text").unionByName(spark.createDataFrame([(70, None, None), (71, 3, b"RIFF")], "`n.dot` int, n_bytes long, media binary"))
    want = telephony.telephony_digest(telephony.telephony_decoded(media), with_pcm=True)
    got = telephony.telephony_read(media)
    assert got.columns == want.columns
    rows = lambda out: sorted((repr(tuple(r)) for r in out.collect()))
    assert rows(got) == rows(want) and len(rows(got)) == len(texts) + 3


def test_media_leave_a_worker_in_bounded_batches():
    sizes = [0, 5, telephony.HELD // 2, telephony.HELD // 2, 7, 3 * telephony.HELD, None, 1, telephony.HELD]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else os.urandom(n) for n in sizes], pa.binary())], ["i", "media"])
    parts = list(telephony.slices(batch.slice(1), 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, len(sizes)))
    assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column(1).to_pylist()) <= telephony.HELD for p in parts)
    assert list(telephony.slices(batch.slice(0, 0), 1)) == []
