"""Quality rules as a short-circuit cascade.

A rule is a predicate that rejects a text.  On a bounded sample every rule is timed and its share of rejections is taken;
rules then run in descending order of rejections per second, and the first that rejects ends the work on a text.  The
order changes only the cost: a text is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SEPARATORS, arrow_batches, mapped, quoted, without

SYMBOLS = "#*$%&|<>"
#: Documents (expected number) of the sample on which the order of the rules is estimated.
SAMPLE_ROWS = 400
WINDOW = 5


class Text:
    """Measures of a text, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # on the six separators only, as these are bytes

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WORD_SEPARATORS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of five words that occur twice or more in the text."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, self.n_words).view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        code = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            code = code * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
            code ^= code >> np.uint64(32)
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(self.n_words + 1, np.int64)
        starts = np.flatnonzero(twice)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WINDOW, -1)
        return int((np.cumsum(step[:-1]) > 0).sum())


#: Name and rejecting predicate.  few_words and repeats are the base rules; the rest are the method's own.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeats": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "dup_lines": lambda t: 10 * t.n_dup_lines > 4 * len(t.lines),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "shouting": lambda t: 10 * t.text.count("!") > 3 * t.n_words,
    "capitals": lambda t: 2 * sum(map(bytes.isupper, t.words)) > t.n_words,
    "letters": lambda t: 10 * sum(map(str.isalpha, t.text)) < 4 * t.word_chars,
}
BASE = ("few_words", "repeats")


def measured(texts: list[str | None], names: list[str]) -> list[tuple[str, float, int, int]]:
    """Per rule: name, seconds, rejected texts, texts.  The words of a text, which nearly all rules share, are there before."""
    out = []
    for name in names:
        fresh = [Text(t) for t in texts]
        for t in fresh:
            t.n_words
        began = time.perf_counter()
        rejected = sum(map(RULES[name], fresh))
        out.append((name, time.perf_counter() - began, rejected, len(fresh)))
    return out


def ordered(stats: list[tuple[str, float, int, int]]) -> list[str]:
    """Names by rejections per second, highest first; ties by name."""
    sums: dict[str, list[float]] = {}
    for name, seconds, rejected, _ in stats:
        x = sums.setdefault(name, [0.0, 0])
        x[0] += seconds
        x[1] += rejected
    return sorted(sums, key=lambda name: (-sums[name][1] / max(sums[name][0], 1e-9), name))


def cascade_order(df: DataFrame, text_col: str = "text", rules: list[str] | None = None) -> list[str]:
    """The order of the rules from a sample of about SAMPLE_ROWS documents, drawn by a hash; it affects cost only, never a verdict."""
    arrow_batches(df.sparkSession)
    names = list(rules or RULES)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*measured(batch.column(0).to_pylist(), names))], ["rule", "seconds", "rejected", "texts"])

    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id(), quoted(text_col)), F.lit(1 << 40)) / (1 << 40)
    sample = df.where(draw < SAMPLE_ROWS / max(1, df.count())).select(quoted(text_col).alias("text"))
    rows = sample.mapInArrow(stats, "rule string, seconds double, rejected long, texts long").collect()  # a row for each rule and batch of the sample
    return ordered([tuple(r) for r in rows]) + sorted(set(names) - {r[0] for r in rows})


def judged(df: DataFrame, text_col: str = "text", rules: list[str] | None = None, order: list[str] | None = None, measures: bool = False) -> DataFrame:
    """df with `kept` (boolean); with measures also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty and fails for want of words.  Repeated rows get equal verdicts; an empty table gives an
    empty table; columns of df with the names of added columns are replaced.  Texts are judged whole, one at a time.  With
    measures, every text is measured and held to the base rules, and the cascade is of the other rules.
    """
    arrow_batches(df.sparkSession)
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean")] if measures else []
    added += [("kept", "boolean")]
    df = without(df, *[x for x, _ in added if x.lower() != text_col.lower()])
    order = order or cascade_order(df, text_col, rules)
    if measures:
        order = [x for x in order if x not in BASE]
    at = df.columns.index(text_col)
    schema = T.StructType(df.schema.fields + T._parse_datatype_string(", ".join(f"`{a}` {b}" for a, b in added)).fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [RULES[x] for x in order]
        for batch in batches:
            rows = []
            for value in batch.column(at):
                t = Text(value.as_py())
                if measures:
                    failed = RULES["few_words"](t) or RULES["repeats"](t)
                    rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and not any(r(t) for r in rules)))
                else:
                    rows.append((not any(r(t) for r in rules),))
            new = [pa.array(x, pa.bool_() if b == "boolean" else pa.int64()) for x, (_, b) in zip(zip(*rows) if rows else [[]] * len(added), added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[a for a, _ in added]])

    return mapped(df, judge, schema)


def oracle() -> str:
    """The measures and verdicts over `documents` in DuckDB's SQL, by whole windows of words; all rules, as their order changes none."""
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT r, doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, i, ws[i:i + 4] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM m WHERE len(ws) > 4))),
p AS (SELECT r, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM g, (SELECT unnest(range(0, 5)) AS o) WHERE n > 1 GROUP BY r),
b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM m LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * len(ls) OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 10 * length(regexp_replace(t, '[^!]', '', 'g')) > 3 * n_words
    OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > n_words OR 10 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 4 * word_chars) AS kept FROM b"""
