"""SimHash near-duplicates, with Golay-code fuzzy hashing to find fingerprints that differ in at most two bits.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits.  Two errors leave at least one of three segments
without an error, and the segment after it with two at most.  In the perfect Golay code of length 23 the word and its 23
neighbours are decoded to codewords; two words that differ in at most two bits have a neighbour in common, so they share
a decoded codeword.  The exact segment with one codeword of the next segment is a key: one to six for each segment.

Fingerprints are joined on keys and verified.  A key with more than BUCKET fingerprints isn't compared in pairs: its
fingerprints meet at the 65 words within one bit of each, which is exact for two errors, and no word has more than 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, arrow_batches, fresh, mapped, quoted, stored

SEED, BUCKET, MAX_BITS = 42, 64, 2
#: Generator polynomial of the Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((41, 23), (18, 23), (0, 18))
_CHUNK = 16384


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half the shingles' hashes.  No words: zero; fewer than a shingle: the whole."""
    words = text.encode().lower().split() if text else []  # of bytes: lower-cases A-Z only, splits at the six separators
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    if total == 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        n = len(part) - shingle + 1
        hashes = np.fromiter((digest(join(w), SEED) for w in zip(*(part[i:] for i in range(shingle)))), np.uint64, n)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for i in range(0, n, 255):
            counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3, name: str = "fp") -> DataFrame:
    """The columns to keep (all, if not said) and the fingerprint as a signed long."""
    arrow_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    source = df.select(*[quoted(c) for c in keep], *([] if text_col in keep else [quoted(text_col)]))
    at = source.columns.index(text_col)
    schema = T.StructType(source.schema.fields[: len(keep)] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], [*batch.schema.names[: len(keep)], name])

    return mapped(source, run, schema)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the words, as polynomials, by the generator."""
    out = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ np.uint32(GENERATOR << bit - 11), out)
    return out


def _errors() -> np.ndarray:
    """The one error pattern of up to three bits for each of the 2,048 syndromes: the code is perfect."""
    one = [1 << i for i in range(23)]
    patterns = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    patterns = np.array(patterns, np.uint32)
    out = np.zeros(2048, np.uint32)
    out[_syndromes(patterns)] = patterns
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word a row of 24 codeword indices (12 bits): of the word and of its neighbours, repeats included."""
    near = words.astype(np.uint32)[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.uint32)
    return (near ^ _errors()[_syndromes(near)]) >> np.uint32(11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (signed longs) and the place of the fingerprint that each belongs to; a fingerprint's keys are distinct."""
    keys, owners, u = [], [], fps.view(np.uint64)
    parts = [(u >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
    for i, exact in enumerate(parts):
        near = np.sort(golay_keys(parts[(i + 1) % 3]), axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        at, which = np.nonzero(first)
        keys.append((np.uint64(i) << np.uint64(40)) | (exact[at] << np.uint64(12)) | near[at, which].astype(np.uint64))
        owners.append(at)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """distinct: a stored table of one column fp, each once.  Pairs (a, b) that connect all fingerprints within two bits:
    every such pair is linked, directly or through words that lie within two bits of both."""
    arrow_batches(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            keys, owners = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owners])], ["k", "fp"])

    keys = stored(distinct.select("fp").mapInArrow(run, "k long, fp long"), "golay-keys")
    shared = stored(keys.groupBy("k").count().where("count > 1"), "golay-shared")
    members = stored(keys.join(shared, "k"), "golay-members")
    few = members.where(F.col("count") <= BUCKET).groupBy("k").agg(F.collect_list("fp").alias("m"))  # BUCKET at most
    near = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = few.select(F.explode(near).alias("p")).select("p.a", "p.b")
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)]])
    many = members.where(F.col("count") > BUCKET).select("fp").distinct()
    words = many.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = words.groupBy("word").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)  # 65 at most
    stars = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """Columns node and root of every node in pairs (a, b): one root to a connected component.

    Each round points every node at its least neighbour, follows the pointers once more, and contracts the edges.  All
    state is in stored tables, nothing is collected, and a hub meets partial aggregation or a join that can be split.
    """
    edges = Stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while not edges.df.isEmpty():
        e = edges.df
        least = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        once = Stored(least, "parents")
        p, q = once.df, once.df.select(F.col("node").alias("mid"), F.col("parent").alias("far"))
        jump = Stored(p.join(q, p.parent == q.mid).select("node", F.col("far").alias("root")), "jumps")
        j = jump.df
        if roots is None:
            roots = jump
        else:
            step = j.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            after = Stored(roots.df.join(step, roots.df.root == step.mid, "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
            roots.drop()
            roots = after
        left, right = j.select(F.col("node").alias("a"), F.col("root").alias("ra")), j.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = e.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = Stored(nxt, "edges")
        edges.drop()
        once.drop()
        edges = nxt
    return roots.df if roots else edges.df.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint_classes(fps: DataFrame, id_col: str) -> DataFrame:
    """fps: a stored table with fp and an id.  Columns fp (each once), component (the least id reachable within two bits at a step)."""
    nodes = stored(fps.groupBy("fp").agg(F.min(quoted(id_col)).alias("least_id")), "fingerprints")
    roots = components(linked_pairs(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "classes")
    least = stored(named.groupBy("root").agg(F.min("least_id").alias("component")), "components")
    return named.join(least, "root").select("fp", "component")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of df: the id, `fp` (signed long) and `component` (the least id reachable, itself included).

    Null and empty texts have fingerprint zero and link like any other; equal texts share a fingerprint, so a group of
    copies is one node; repeated rows give repeated results; null ids are passed over by the least id (a component of
    nulls only has none); an empty table gives an empty table.  A text is fingerprinted in stretches of shingles, however
    long.  Other columns are not returned; an id column named fp or component has an underscore put before it.
    """
    name = fresh(["fp", "component"], id_col)[0]
    source = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    fps = stored(fingerprints(source, "text", ["id"], shingle), "simhash")
    classes = stored(fingerprint_classes(fps, "id"), "simhash-classes")
    # Both sides are tables: a fingerprint with a third of all rows is split by the adaptive planner.
    return fps.join(classes, "fp").select(F.col("id").alias(name), "fp", "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """df with one row left of each class of near-duplicates: that of the least id (null ids last), one of repeated rows.

    The columns are those of df.  Rows are told apart by a number of their own, so repeated or null ids do no harm.
    """
    fp, row, stay_row = fresh(df.columns, "fp", "row_number", "stay_row")
    table = fingerprints(df, text_col, None, shingle, fp).withColumn(row, F.monotonically_increasing_id())
    table = stored(table, "simhash-rows")
    classes = stored(fingerprint_classes(table.select(quoted(fp).alias("fp"), quoted(row).alias("row")), "row"), "simhash-classes")
    tagged = table.select(quoted(id_col).alias("id"), quoted(fp).alias("fp"), quoted(row).alias("row")).join(classes, "fp")
    stay = tagged.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select(F.col("x.row").alias(stay_row))
    return table.join(stay, quoted(row) == quoted(stay_row), "left_semi").drop(fp, row)
