"""Language identification by bit-sliced Bloom filters.

Every slot of the filter holds one bit for each language.  An n-gram of a language sets that language's bit in a few
slots; the bitwise AND of an n-gram's slots is the set of all languages that have it, in one look-up.  A text counts its
n-grams for each language; the counts are corrected for the filter's false positives (the share of a language's bits
that are set, to the power of the number of slots), and the language with the highest count is the answer.

A language's n-grams are those in at least MIN_SHARE of its sampled texts (and in one), which bounds their number
whatever the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, mapped, quoted, without

#: Labelled documents of each language to learn from (expected number), drawn by a hash with a fixed seed.
SAMPLE, SEED = 2000, 42
GRAM, SLOTS_LOG2, PROBES, MIN_SHARE, PIECE = 4, 21, 3, 0.01, 1 << 18
#: Up to so many languages every slot has its bits; of more, slots without any share one row of zeros.
DENSE = 32
#: Hashes that a worker holds before it counts them; bits looked up at once.
HELD, BITS = 2_000_000, 1 << 22
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter; made once for each process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased text, a bounded piece at a time; what isn't a letter counts as a gap, and
    an n-gram has a letter in it and at most one gap on either side."""
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - GRAM + 1) : at + PIECE].lower()
        code = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(letters()[code], code, 0).astype(np.uint64)
        code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]  # gaps are one wide
        if len(code) < GRAM:
            code = np.concatenate((code, np.zeros(GRAM - len(code), np.uint64)))
        n = len(code) - GRAM + 1
        h, some, inner = np.zeros(n, np.uint64), np.zeros(n, bool), np.ones(n, bool)
        for k in range(GRAM):
            part_k = code[k : k + n]
            h = (h ^ part_k) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            some |= part_k != 0
            if 0 < k < GRAM - 1:
                inner &= part_k != 0
        yield h[some & inner]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _slots(h: np.ndarray, multiplier: int) -> np.ndarray:
    return (h * np.uint64(multiplier)) >> np.uint64(64 - SLOTS_LOG2)


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (slots, bytes): the bits of the languages
    false: np.ndarray  # of each language, the share of foreign n-grams that it seems to have
    row: np.ndarray | None = None  # where slots has only rows with a bit, and zeros first: of each slot, its row

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for m in _MULTIPLIERS[:PROBES]:
            at = _slots(h, m)
            bits = self.slots[at if self.row is None else self.row[at]]
            out = bits if out is None else out & bits
        return out

    def counted(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-grams of a text each language has, and how many there are."""
        count, n = np.zeros(len(self.languages)), 0
        step = max(1, BITS // max(1, len(count)))
        for piece in grams(text):
            n += len(piece)
            for at in range(0, len(piece), step):
                bits = self.masks(piece[at : at + step])
                if len(count) > DENSE:
                    count += np.unpackbits(bits, axis=1, count=len(count), bitorder="little").sum(axis=0, dtype=np.int64)
                    continue
                for i in range(len(count)):
                    count[i] += np.count_nonzero(bits[:, i >> 3] & (1 << (i & 7)))
        return count, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language (`und` without a letter) and score: the share of n-grams that it has, corrected."""
        if not text or not has_letter(text):
            return "und", 0.0
        if not self.languages:
            return "und", 0.0
        count, n = self.counted(text)
        share = (count / max(n, 1) - self.false) / (1 - self.false)
        best = int(share.argmax())  # ties: the first by name
        return self.languages[best], float(min(1.0, max(0.0, share[best])))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str | None = "doc_id") -> Filter:
    """The filter from labelled rows (null labels and null texts are passed over).

    About SAMPLE texts of each language are used, or all if there are no more, chosen by a hash of id and text (of the text
    alone without an id column), so neither partitions nor files matter.  Only n-grams in at least MIN_SHARE of them come
    to the driver, a number bounded by the mean distinct n-grams of a text / MIN_SHARE.
    """
    arrow_batches(df.sparkSession)
    draw = F.pmod(F.xxhash64(*([quoted(id_col)] if id_col in df.columns else []), quoted(text_col), F.lit(SEED)), F.lit(1 << 40)) / (1 << 40)
    rows = df.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang"), draw.alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    rates = [(x, SAMPLE / n if n > SAMPLE else 2.0, max(1, int(MIN_SHARE * min(n, SAMPLE)))) for x, n in counts.items()]
    rates = F.broadcast(df.sparkSession.createDataFrame(rates, "lang string, rate double, least long"))  # a condition for each would nest too deep
    sample = rows.join(rates, "lang").where(F.col("draw") < F.col("rate")).select("text", "lang")  # by row, so that a text with many copies fills no sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out(lang: str) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "texts"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                h = np.unique(np.concatenate([np.unique(x) for x in grams(text.as_py())] or [np.zeros(0, np.uint64)]))
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > HELD:
                    yield from map(out, list(held))
                    size = 0
        yield from map(out, list(held))

    sums = sample.mapInArrow(run, "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    found = sums.join(rates, "lang").where(F.col("texts") >= F.col("least")).select("lang", "gram").toArrow()
    h, number = found.column("gram").to_numpy().view(np.uint64), {x: i for i, x in enumerate(languages)}
    own = np.fromiter((number[x] for x in found.column("lang").to_pylist()), np.int64, len(h))
    row, n = None, 1 << SLOTS_LOG2
    if len(languages) > DENSE:
        filled = np.unique(np.concatenate([_slots(h, m) for m in _MULTIPLIERS[:PROBES]]))
        row, n = np.zeros(n, np.int32), len(filled) + 1
        row[filled] = np.arange(1, n)
    slots, fill = np.zeros((n, max(1, -(-len(languages) // 8))), np.uint8), np.zeros(len(languages))
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(len(languages) + 1))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        at = np.unique(np.concatenate([_slots(h[order[a:b]], m) for m in _MULTIPLIERS[:PROBES]]))
        slots[at if row is None else row[at], i >> 3] |= np.uint8(1 << (i & 7))
        fill[i] = len(at) / (1 << SLOTS_LOG2)
    return Filter(languages, slots, np.minimum(fill**PROBES, 0.99), row)


def identified(df: DataFrame, model: Filter, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all, if not said), lang_pred (string) and score (double, 0 to 1); only the text decides.

    A null text, or one without a letter, is `und` with score 0, as is any text if nothing was learned.  Repeated rows
    repeat; an empty table gives an empty table; columns named lang_pred or score are replaced.  Texts are read whole.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    source = df.select(*[quoted(c) for c in keep], *([] if text_col in keep else [quoted(text_col)]))
    at, n = source.columns.index(text_col), len(keep)
    shared = spark.sparkContext.broadcast(model)  # 2 MB for each eight languages, or 8 MB and the rows with a bit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names[:n], "lang_pred", "score"])

    return mapped(source, run, T.StructType([*source.schema.fields[:n], *T._parse_datatype_string("lang_pred string, score double").fields]))


def held_out(column: Column) -> Column:
    """Rows that the language filter doesn't learn from."""
    from .common import residue

    return residue(column, 5) == 0
