"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) P(member | class, history) P(word | member).  The first two factors are softmaxes
over sums of weight rows.  A history has three features: the word before, the word before that (a skip), and both
together.  The class takes the row that each feature is hashed to, the member the row that each feature with the class is
hashed to.  Each frequent word is a member of its own; the other words are classed by their endings and share members,
within which a word has its share of the counts, with 0.1 added to each.  A word never seen takes a fixed
0.1 / (N + 0.1 (V + 1)), and the rest of the probability goes to the words that were seen, so it adds up to one.

Counts are a distributed table over all training texts.  Weight rows grow with the number of training tokens, up to
MOST_ROWS for each feature.  Training is one pass over all training texts: every partition takes gradient steps from the
start weights, and the changes of a row are averaged by the number of steps that touched it.  Only the weights and HEAD
words come to the driver; the other words of a text meet their counts in a join.  Texts are cut into words once, into a
stored table whose rows are batches of texts, which counting, training and scoring read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_SEPARATORS, arrow_batches, fresh, quoted, stored
from .pieces import OTHER, WHITE, distinct_pieces, flat, slices

#: Most words whose counts are sent to the executors.
HEAD = 150_000
#: Classes, and members of each; frequent words that are members of their own fill the first OWN / MEMBERS classes.
CLASSES, MEMBERS, OWN, FEATURES = 32, 32, 512, 3
#: Training tokens to a weight row, and the least and most rows of a feature (the most make 100 MB of weights).
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 4096, 4096, 1 << 17
BATCH, RATE, ADD = 4096, 1.0, 0.1
CHUNK = 128  # weight rows to a message
END = b"\0end of text"  # no word has a space in it
NEVER = -1e4  # the start weight of a member that no word has
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[list(map(ord, WORD_SEPARATORS))] = WHITE


def word_hash(word: bytes) -> int:
    """64 bits, signed."""
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def ending_class(word: bytes) -> int:
    own = OWN // MEMBERS
    return own + zlib.crc32(word.rstrip(b".,;:!?")[-2:] or word[-2:]) % (CLASSES - own)


@dataclass
class Tokens:
    """Texts as numbers of words: hash and class by ending of each word (a word may be there twice), the words of all texts
    with an end after each, and how many each text has."""

    h: np.ndarray
    ending: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray


def tokenised(texts: pa.Array) -> Tokens:
    data, ends = flat(texts)
    h, endings, numbers = [word_hash(END)], [ending_class(END)], []
    sizes = np.zeros(len(ends) - 1, np.int64)
    data = _LOW[data]
    for a, b in slices(data, ends):
        kinds = _KINDS[data[a:b]]
        begin = np.empty(b - a, bool)
        begin[0], begin[1:] = True, kinds[1:] != kinds[:-1]
        begin[ends[(ends > a) & (ends < b)] - a] = True
        start = np.flatnonzero(begin)
        pieces = distinct_pieces(data[a:b], start)
        words = pieces.dictionary.to_pylist()
        is_word = kinds[start] == OTHER
        numbers.append(pieces.indices.to_numpy()[is_word] + len(h))
        h += map(word_hash, words)
        endings += map(ending_class, words)
        first, last = np.searchsorted(ends, (a, b), "right") - 1
        bounds = np.searchsorted(start[is_word], np.clip(ends[first : last + 2] - a, 0, b - a))
        sizes[first : last + 1] += np.diff(bounds)[: len(sizes) - first]
    numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    return Tokens(np.array(h, np.int64), np.array(endings, np.uint8), np.insert(numbers, np.cumsum(sizes), 0), sizes + 1)


_TOKENS = "h binary, ending binary, numbers binary, sizes binary, learned binary"


def tokenised_table(df: DataFrame, text_col: str, keep: list[str], learned: Column) -> DataFrame:
    """A stored row for each batch of texts: k0, k1, ... (arrays of the columns to keep) and the parts of its Tokens, with
    a byte for each text that says whether to learn from it."""
    arrow_batches(df.sparkSession)
    n = len(keep)
    source = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text_col).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    fields = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in source.schema.fields[:n]] + T._parse_datatype_string(_TOKENS).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokenised(batch.column(n))
            learned = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(np.uint8)
            kept = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x) for x in batch.columns[:n]]
            parts = (t.h, t.ending, t.numbers.astype(np.uint32), t.sizes, learned)
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], [f.name for f in fields])

    return stored(source.mapInArrow(run, T.StructType(fields)), "tokens")


def read_tokens(row: dict[str, bytes]) -> tuple[Tokens, np.ndarray]:
    kinds = (np.int64, np.uint8, np.uint32, np.int64, np.uint8)
    *parts, learned = (np.frombuffer(row[name], kind) for name, kind in zip("h ending numbers sizes learned".split(), kinds))
    return Tokens(*parts), learned.astype(bool)


def learned_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    """The tokens to learn from."""
    for batch in batches:
        for row in batch.to_pylist():
            t, learned = read_tokens(row)
            yield Tokens(t.h, t.ending, t.numbers[np.repeat(learned, t.sizes)], t.sizes[learned])


def counted(tokens: DataFrame) -> DataFrame:
    """h (word hash), ending (its class by ending) and c (its count) over all texts to learn from, the end of each included; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            h, ending, c = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, k) for k in (np.int64, np.uint8, np.int64))
            held.clear()
            order = np.argsort(h)
            h, ending, c = h[order], ending[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(ending[first].astype(np.int32)), pa.array(np.add.reduceat(c, first) if len(h) else c)], ["h", "ending", "c"])

        for t in learned_tokens(batches):
            c = np.bincount(t.numbers, minlength=len(t.h))
            some = np.flatnonzero(c)
            held.append((t.h[some], t.ending[some], c[some]))
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield out()
        yield out()

    rows = tokens.select("h", "ending", "numbers", "sizes", "learned").mapInArrow(run, "h long, ending int, c long")
    return stored(rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    tokens: int  # N
    words: int  # V
    head: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray  # of those
    own: np.ndarray  # hashes of the words that are members of their own, most frequent first
    mass: np.ndarray  # (CLASSES, MEMBERS): the sum of count + 0.1 over the words of a member
    rows: int  # weight rows of a feature: a power of two

    @property
    def total(self) -> float:
        return self.tokens + ADD * (self.words + 1)

    @property
    def log_unknown(self) -> float:
        return math.log10(ADD / self.total)

    @property
    def log_known(self) -> float:
        return math.log10(max(1 - ADD / self.total, 1e-300))


def rows_for(tokens: int) -> int:
    """A row for TOKENS_A_ROW training tokens, within bounds, as a power of two."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (tokens // TOKENS_A_ROW).bit_length() - 1 if tokens >= TOKENS_A_ROW else 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: the stored table of counted().  The head is all words at or above the least count (to a 16th of a power of
    two) for which there are at most HEAD of them; other words are as exact, by a join."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)), F.sum("c")).collect()), reverse=True)
    n, least = 0, None
    for at, k, _ in levels:
        if n + k > HEAD:
            break
        n, least = n + k, at
    found = counts.where(level >= (least if least is not None else 1 << 30)).select("h", "c").toArrow()
    h, c = found.column("h").to_numpy(), found.column("c").to_numpy()
    end = word_hash(END)
    best = np.lexsort((h, -c))
    own = np.array([end, *[int(x) for x in h[best] if x != end][: OWN - 1]], np.int64)
    of_own = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(own.tolist()) for x in (k, i)]), F.col("h"))
    member = F.coalesce(of_own, F.col("ending") * MEMBERS + F.pmod("h", F.lit(MEMBERS))).cast("int")
    mass = np.zeros(CLASSES * MEMBERS)
    for k, s in counts.groupBy(member.alias("k")).agg(F.sum(F.col("c") + ADD)).collect():
        mass[k] = s
    order = np.argsort(h)
    tokens = sum(x[2] for x in levels)
    return Vocabulary(tokens, sum(x[1] for x in levels), h[order], c[order], own, mass.reshape(CLASSES, MEMBERS), rows_for(tokens))


class Lexicon:
    """Class, member and count (-1: not in the head) of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.by_hash = np.argsort(v.own)
        self.own = v.own[self.by_hash]

    def of(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = self.v
        at = np.minimum(np.searchsorted(self.own, h), len(self.own) - 1)
        rank = np.where(self.own[at] == h, self.by_hash[at], -1)
        cls = np.where(rank < 0, ending, rank // MEMBERS)
        member = np.where(rank < 0, h % MEMBERS, rank % MEMBERS)
        if not len(v.head):
            return cls, member, np.full(len(h), -1.0)
        at = np.minimum(np.searchsorted(v.head, h), len(v.head) - 1)
        return cls, member, np.where(v.head[at] == h, v.counts[at], -1).astype(np.float64)


def mixed(x: np.ndarray, rows: int) -> np.ndarray:
    return (((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int32) & np.int32(rows - 1)


def decisions(h: np.ndarray, sizes: np.ndarray, cls: np.ndarray, member: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two decisions for each token, the class and then the member: weight rows of the features, row of the start
    weights, and what was chosen.  Classes come first, for all tokens; before a text there are zeros."""
    u, n = h.view(np.uint64), len(h)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.zeros_like(u), np.zeros_like(u)
    one[1:], two[2:] = u[:-1], u[:-2]
    one[place < 1], two[place < 2] = 0, 0
    salt = (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((2 * n, FEATURES), np.int32)
    for k, x in enumerate((one, two, one * np.uint64(0x9E3779B97F4A7C15) + (two ^ (two >> np.uint64(29))))):
        out[:n, k] = mixed(x, rows) + k * rows
        out[n:, k] = mixed(x ^ salt, rows) + (FEATURES + k) * rows
    start = np.concatenate((np.zeros(n, np.int64), 1 + cls)) + 2 * FEATURES * rows
    return out, start, np.concatenate((cls, member))


def scores_of(weights: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of each decision, less the largest of them."""
    z = weights.take(start, axis=0)
    for k in range(FEATURES):
        z += weights.take(rows[:, k], axis=0)
    z -= z.max(axis=1, keepdims=True)
    return z


def start_weights(v: Vocabulary) -> np.ndarray:
    """All zero but for the last rows: the log of the classes' shares, and of the members' in each class."""
    w = np.zeros((2 * FEATURES * v.rows + 1 + CLASSES, MEMBERS), np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        of_class = v.mass.sum(axis=1)
        logs = np.vstack((np.log(of_class / of_class.sum()), np.log(v.mass / of_class[:, None])))
    w[2 * FEATURES * v.rows :] = np.where(np.isfinite(logs), logs, NEVER)
    return w


def summed(values: np.ndarray, first: np.ndarray, n: np.ndarray, short: int = 8) -> np.ndarray:
    """Sums of runs of rows that begin at `first` and have n rows: the first rows of all runs together, the rest of long runs by run."""
    out, at = values.take(first, axis=0), np.arange(len(first))
    for k in range(1, short):
        at = at[n[at] > k]
        out[at] += values.take(first[at] + k, axis=0)
    ones = np.ones(n.max(initial=0), values.dtype)
    for i in at[n[at] > short]:
        out[i] += ones[: n[i] - short] @ values[first[i] + short : first[i] + n[i]]
    return out


def step(w: np.ndarray, seen: np.ndarray, size: np.ndarray, rows: np.ndarray, start: np.ndarray, chosen: np.ndarray) -> None:
    """A gradient step on a batch of decisions, in place, with rates that fall with the squared gradients of a row (size)."""
    g = scores_of(w, rows, start)
    np.exp(g, out=g)
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(chosen)), chosen] -= 1
    # Uses of a row are brought together; numpy sorts numbers faster than it finds their order.
    keys = np.sort(rows.ravel().astype(np.int64) << 32 | np.arange(rows.size))
    r, decision = keys >> 32, (keys & 0xFFFFFFFF) // FEATURES
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    n = np.diff(np.append(first, len(r)))
    mean = summed(g.take(decision, axis=0), first, n)
    mean /= np.sqrt(n)[:, None].astype(np.float32)
    at = r[first]
    size[at] += np.einsum("ij,ij->i", mean, mean)
    mean *= (RATE / np.sqrt(size[at] + 1e-3)).astype(np.float32)[:, None]
    w[at] = w.take(at, axis=0) - mean
    seen[at] += n


def trained(tokens: DataFrame, v: Vocabulary, w0: np.ndarray) -> np.ndarray:
    """Weights after one pass over the texts to learn from, averaged over partitions.  As every partition sends its weights, there are
    no more partitions than keep what is sent a fraction of the texts, however large the table of weights."""
    sent = tokens.sparkSession.sparkContext.broadcast((v, w0[2 * FEATURES * v.rows :]))
    rows = v.rows
    count, chunks = 2 * FEATURES * rows, 2 * FEATURES * rows // CHUNK
    schema = "chunk int, delta binary, seen binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, last = sent.value
        w = np.vstack((np.zeros((count, MEMBERS), np.float32), last))
        seen, size, lexicon = np.zeros(count, np.float32), np.zeros(count, np.float32), Lexicon(v)
        for t in learned_tokens(batches):
            cls, member, _ = (x[t.numbers] for x in lexicon.of(t.h, t.ending))
            where, start, chosen = decisions(t.h[t.numbers], t.sizes, cls, member, rows)
            n = len(cls)
            for i in range(0, n, BATCH):
                for a, b in ((i, min(n, i + BATCH)), (n + i, n + min(n, i + BATCH))):
                    step(w, seen, size, where[a:b], start[a:b], chosen[a:b])
        for k in range(chunks):
            part = slice(k * CHUNK, (k + 1) * CHUNK)
            if seen[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w[part].astype(np.float16).tobytes()]), pa.array([seen[part].tobytes()])], ["chunk", "delta", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for chunk, delta, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                s = np.frombuffer(seen.as_py(), np.float32).astype(np.float64)
                x = sums.setdefault(chunk, [np.zeros((CHUNK, MEMBERS)), np.zeros(CHUNK)])
                x[0] += np.frombuffer(delta.as_py(), np.float16).reshape(CHUNK, MEMBERS) * s[:, None]
                x[1] += s
        for k, (delta, seen) in sums.items():
            mean = (delta / np.maximum(seen, 1)[:, None]).round(4).astype(np.float16)  # as the order of addition varies
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean.tobytes()]), pa.array([b""])], ["chunk", "delta", "seen"])

    made = tokens.select("h", "ending", "numbers", "sizes", "learned").coalesce(max(32, v.tokens // (rows * 256))).mapInArrow(learn, schema)
    w = w0.copy()
    mean = made.repartition("chunk").mapInArrow(add, schema).select("chunk", "delta").toArrow()  # 2 * FEATURES * rows rows of weights
    for chunk, delta in zip(mean.column("chunk").to_pylist(), mean.column("delta")):
        w[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(delta.as_buffer(), np.float16).reshape(CHUNK, MEMBERS)
    return w


def token_logs(v: Vocabulary, w: np.ndarray, h: np.ndarray, sizes: np.ndarray, cls: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For each token the log10 probability of its member, less the log10 of the member's mass."""
    n = len(h)
    where, start, chosen = decisions(h, sizes, cls, member, v.rows)
    part = np.empty(2 * n)
    for i in range(0, 2 * n, BATCH):
        z = scores_of(w, where[i : i + BATCH], start[i : i + BATCH])
        part[i : i + BATCH] = z[np.arange(len(z)), chosen[i : i + BATCH]] - np.log(np.exp(z).sum(axis=1))
    return (part[:n] + part[n:]) / math.log(10) - np.log10(np.maximum(v.mass[cls, member], 1e-9))


def maxent_scores(df: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """For every row of df: the columns to keep (the id, if not said), n_tokens, n_known, train_tokens (long), base_score
    and score (double): log10 probabilities of the whole text by the counts alone and by the model, which learns from the
    rows for which `learned` is true.

    A null or empty text is its end alone; a very long text is cut into words in stretches.  Repeated rows are scored each
    for itself, by a row number in a stored table; with no rows to learn from every token is unknown; an empty df gives an
    empty table.  A column to keep that has the name of a result has underscores put before it.
    """
    spark = df.sparkSession
    keep = list(keep or [id_col])
    names: list[str] = []
    for c in keep:
        names += fresh([*RESULTS, *names], c)
    n = len(keep)
    tokens = tokenised_table(df, text_col, keep, learned)
    counts = counted(tokens)
    v = vocabulary(counts)
    w = trained(tokens, v, start_weights(v)) if v.tokens else start_weights(v)
    sent = spark.sparkContext.broadcast((v, w[: 2 * FEATURES * v.rows].astype(np.float16), w[2 * FEATURES * v.rows :]))
    kept = [T.StructField(f"k{i}", tokens.schema[f"k{i}"].dataType.elementType) for i in range(n)]
    tail = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("f", T.IntegerType()), T.StructField("m", T.DoubleType())]))
    fields = T._parse_datatype_string("tokens long, known long, base double, model double").fields + [T.StructField("tail", tail)]
    kind = pa.struct([("h", pa.int64()), ("f", pa.int32()), ("m", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, hashed, last = sent.value
        w = np.vstack((hashed.astype(np.float32), last))
        lexicon, log_total = Lexicon(v), math.log10(v.total)
        for batch, k in ((batch, k) for batch in batches for k in range(batch.num_rows)):
            t, _ = read_tokens({name: batch.column(name)[k].as_py() for name in "h ending numbers sizes learned".split()})
            h, sizes = t.h[t.numbers], t.sizes
            cls, member, c = (x[t.numbers] for x in lexicon.of(t.h, t.ending))
            model, base, inside = token_logs(v, w, h, sizes, cls, member), np.log10(np.maximum(c, 0) + ADD), c >= 0
            first = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(np.where(inside, x, 0), first) if len(first) else np.zeros(0)
            owner = np.repeat(np.arange(len(sizes)), sizes)[~inside]
            th, tm = h[~inside], model[~inside]
            order = np.lexsort((th, owner))
            th, tm, owner = th[order], tm[order], owner[order]
            new = np.flatnonzero(np.concatenate(([True], (th[1:] != th[:-1]) | (owner[1:] != owner[:-1])))) if len(th) else np.zeros(0, np.int64)
            f = np.diff(np.append(new, len(th))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(th[new]), pa.array(f), pa.array(np.add.reduceat(tm, new) if len(new) else np.zeros(0))], fields=list(kind))
            offsets = np.searchsorted(owner[new], np.arange(len(sizes) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            known = total(np.ones(len(c)))
            arrays = [pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(total(base - log_total)), pa.array(total(model + base + v.log_known)), lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(i)[k].values for i in range(n)], *arrays], [*[f.name for f in kept], *[x.name for x in fields]])

    table = tokens.mapInArrow(run, T.StructType([*kept, *fields])).withColumn("row", F.monotonically_increasing_id())
    table = stored(table, "scores")
    # The words outside the head: none has a large share of the rows.
    rare = table.select("row", F.explode("tail").alias("t")).select("row", "t.h", "t.f", "t.m")
    met = rare.join(counts.select("h", "c"), "h", "left")
    add = F.coalesce(F.col("c"), F.lit(0)) + ADD
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("f")).otherwise(0)).cast("long").alias("more_known"),
        F.sum(F.col("f") * (F.log10(add) - math.log10(v.total))).alias("more_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("m") + F.col("f") * (F.log10(add) + v.log_known)).otherwise(F.col("f") * v.log_unknown)).alias("more_model"),
    )
    out = table.drop("tail").join(met, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
    return out.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(names)],
        F.col("tokens").alias("n_tokens"),
        plus("known", "more_known", 0).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base", 0.0).alias("base_score"),
        plus("model", "more_model", 0.0).alias("score"),
    )
