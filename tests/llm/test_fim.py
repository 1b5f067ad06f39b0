"""Fill-in-middle against a plain version, for every grammar, with stretches that cut units."""

import hashlib
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from meterlake.llm import fim
from meterlake.llm import queries as Q

SF = "/root/testdata/sf0.001"
UNITS = {
    "code_point": r"(?s).",
    "word": r"(?s)[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+",
    "line": r"(?s)[^\n]*\n|[^\n]+",
    "token": r"(?s)[\p{L}\p{M}]+|\p{N}+|[ \t\n\x0b\f\r]+|.",
}


def units(text, name):
    if name == "word":  # what precedes the first word is a unit, as spaces belong to the word before
        lead = re.match(r"[ \t\n\x0b\f\r]*", text)[0]
        return [x for x in [lead, *re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", text)] if x]
    return regex.findall(UNITS[name], text)


def plain(doc_id, text, name="code_point"):
    text = text or ""
    pieces = units(text, name)
    n = len(pieces)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("name", sorted(UNITS))
@pytest.mark.parametrize("stretch", [1, 3, 16, fim.STRETCH])
def test_every_grammar(spark, name, stretch):
    rng = random.Random(11)
    texts = [None, "", "x", "\n", "\n\n", " ", "a b", "<P> stays", "nearly <S", "<", "S>", "😀", "😀é́\n漢字 😀", "\r\n\r\n"]
    texts += ["".join(rng.choice("abé́ \n\t17,.<>PSM😀") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (3, "same id, other text"), (9, texts[9])]
    rows = [(i, t, i) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, `n.dot` long")
    out = fim.fim_transform(df, grammar=fim.GRAMMARS[name], stretch=stretch).withColumn("back", fim.fim_restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, i, *plain(i, t, name), t or "") for i, t in [r[:2] for r in rows]), key=repr)
    assert {r[4] for r in got} == {"plain", "psm", "spm"}


def test_long_text_empty_table_and_clashing_names(spark):
    long = "añ😀 " * 60_000
    df = spark.createDataFrame([(1, long), (2, long)], "body long, digest string").withColumn("N", F.lit(7))
    rows = fim.fim_transform(df, "body", "digest").collect()
    assert [tuple(r[2:]) for r in rows] == [plain(1, long), plain(2, long)]
    assert fim.fim_transform(df.limit(0), "body", "digest").count() == 0
    with pytest.raises(ValueError):
        fim.fim_transform(df.withColumnRenamed("body", "Form"), "Form", "digest")


def test_boundary_has_no_width():
    for grammar in fim.GRAMMARS.values():
        assert not re.sub(r"\(\?<?=(\[[^\[\]]*\]|\[(\[[^\[\]]*\])+\])\)|\|", "", grammar.boundary())


def test_query(spark):
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t in docs}
    assert {tuple(r) for r in Q.op11_lookaround_fim(spark, SF).collect()} == want
