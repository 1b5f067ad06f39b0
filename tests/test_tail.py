"""A log folder as a stream: appended, rewritten, shortened and unchanged files, over restarts."""

import os
import random

from meterlake.sources import tail


def test_only_unsent_lines(spark, tmp_path):
    tail.register(spark)
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    a, b, c = folder / "a.jsonl", folder / "deep" / "b.jsonl", folder / "c.txt"

    def sent():
        """What a query that starts anew on the checkpoint gives."""
        before = set(os.listdir(tmp_path / "out")) if (tmp_path / "out").exists() else set()
        rows = spark.readStream.format("log_folder").load(str(folder))
        q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        new = [f"{tmp_path}/out/{n}" for n in set(os.listdir(tmp_path / "out")) - before if n.endswith(".parquet")]
        return sorted((os.path.basename(r.file), r.at, r.value) for r in spark.read.parquet(*new).collect()) if new else []

    a.write_text("one\ntwo\n\nhalf")
    b.write_text("é1\né2\n")
    c.write_text("no\n")
    assert sent() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "é1"), ("b.jsonl", 4, "é2")]
    assert sent() == []  # all unchanged
    a.write_text(a.read_text() + " line\nnext\n")
    assert sent() == [("a.jsonl", 9, "half line"), ("a.jsonl", 19, "next")]
    b.write_text("x1\nx2\nx3\nx4\n")  # rewritten, and longer
    assert sent() == [("b.jsonl", 0, "x1"), ("b.jsonl", 3, "x2"), ("b.jsonl", 6, "x3"), ("b.jsonl", 9, "x4")]
    b.write_text("x1\n")  # shortened
    assert sent() == [("b.jsonl", 0, "x1")]
    a.unlink()
    (folder / "d.jsonl").write_text("new\n")
    assert sent() == [("d.jsonl", 0, "new")]


def test_stretches_of_a_long_file(tmp_path, monkeypatch):
    """Every line is in one stretch, wherever stretches begin."""
    rng = random.Random(2)
    lines = ["".join(rng.choice("abé😀") for _ in range(rng.randrange(40))) for _ in range(300)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\npart")
    for stretch in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(tail, "STRETCH", stretch)
        reader = tail.TailReader({"path": str(tmp_path)})
        end = reader.latestOffset()
        rows = [r for p in reader.partitions({}, end) for r in reader.read(p)]
        assert [r[2] for r in rows] == [x for x in lines if x] and [r[1] for r in rows] == sorted({r[1] for r in rows})
        assert [reader.read(p) and list(reader.read(p)) for p in reader.partitions(end, reader.latestOffset())] == [[]]
