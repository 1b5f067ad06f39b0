"""Near copies by the Jaccard similarity of word shingles: fingerprints and MinHash keys propose pairs, the sets decide.

A text is the set of its shingles' hashes; texts with the same set are one node.  Golay keys of SimHash fingerprints (of the
same shingles) propose nodes within two bits.  They don't reach nodes at the least similarity, which are about ten bits
apart, so MinHash keys propose these: some minima make a key, and there are as many keys as leave a pair at the least
similarity unproposed with a chance of MISS at most.  All proposed pairs are verified on the whole sets, and verified pairs
are links of a graph whose components are the groups.

A key with more than BUCKET nodes isn't compared in pairs.  First all its nodes are held against LEADERS of them.  A link
that is still to find has an end outside the key's largest component, so these nodes are held against all.  Either way
blocks of nodes meet: the shingles that both blocks hold are coded, and the counts of common ones are a matrix product.
Nodes meet only at sizes that can reach the similarity, and a pair of blocks emits the links that join its components,
not all it finds.  So every link between components is found, in two passes, within the memory of two blocks.

Texts are picked by the numbers of their rows.  A filter of a fixed number of bits says which rows may be among the numbers,
or among the others if these are fewer; only rows that may be are shuffled to the exact join, the rest stays where it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, arrow_batches, fresh, mapped, quoted, stored
from .simhash import components, fingerprint, linked_pairs

SEED, MISS, BUCKET = 42, 1e-5, 16
#: Minima in a key; nodes that lead a crowded key.
BAND, LEADERS = 4, 1
#: Nodes in a block, and shingles in all of them, on average at most; columns of a product at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096
_CHUNK = 4096
#: Words, of 64 bits, in a filter of rows.
FILTER_WORDS = 1 << 17


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles, sorted.  No words: none; fewer than a shingle: one, the whole."""
    words = text.encode().lower().split() if text else []
    n, digest, join = len(words) - shingle + 1, xxhash.xxh64_intdigest, b" ".join
    if n <= 1:
        return np.array([digest(join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.fromiter((digest(join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))), np.uint64, n))


def bands(similarity: float, band: int) -> int:
    """Keys of so many minima for which two sets at this similarity share none with a chance of MISS at most."""
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log1p(-(similarity**band)))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minhash_keys(hashes: np.ndarray, multipliers: np.ndarray, band: int) -> np.ndarray:
    """One key (signed long) for each band of a set; an empty set has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    mixed, step = hashes ^ (hashes >> np.uint64(31)), max(1, _CHUNK * 64 // len(multipliers))
    least = np.min([np.min(mixed[i : i + step, None] * multipliers, axis=0) for i in range(0, len(mixed), step)], axis=0)
    key = np.arange(len(multipliers) // band, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(-1, band).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _nodes(df: DataFrame, text_col: str, shingle: int, similarity: float, band: int, node: str, keys: str, fp: str | None = None) -> DataFrame:
    """df with the hash of each text's shingle set and the set's keys, and the fingerprint if it has a name."""
    arrow_batches(df.sparkSession)
    at, multipliers = df.columns.index(text_col), _multipliers(band * bands(similarity, band))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(at)]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            found = [minhash_keys(s, multipliers, band) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found or [np.zeros(0, np.int64)]), pa.int64()))
            more = [pa.array(np.array([fingerprint(x.as_py(), shingle) for x in batch.column(at)], np.uint64).view(np.int64))] if fp else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), lists, *more], [*batch.schema.names, *new])

    new = [node, keys, *([fp] if fp else [])]
    kinds = [T.LongType(), T.ArrayType(T.LongType()), T.LongType()]
    return mapped(df, run, T.StructType([*df.schema.fields, *[T.StructField(x, kind) for x, kind in zip(new, kinds)]]))


def shared_keys(keys: DataFrame) -> DataFrame:
    """keys: a stored table of k and node, each once.  Those that more than one node has, with their count; stored."""
    shared = stored(keys.groupBy("k").count().where("count > 1"), "minhash-shared")
    return stored(keys.join(shared, "k"), "minhash-members")


def close_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes of each key that has BUCKET at most."""
    few = members.where(F.col("count") <= BUCKET).groupBy("k").agg(F.collect_list("node").alias("m"))
    all_of = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return few.select(F.explode(all_of).alias("p")).select("p.a", "p.b")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts: node and text, each node once.  node, s (the bytes of its set) and n (its size); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["node", "s", "n"])

    return stored(texts.select("node", "text").mapInArrow(run, "node long, s binary, n long"), "minhash-sets")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b), each once, with the distance of their sets: one less the Jaccard similarity; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((x, y)), kind="stable")
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append(1 - n / max(1, len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "d"])

    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    met = stored(pairs.select("a", "b").distinct(), "minhash-pairs").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(met.mapInArrow(run, "a long, b long, d double"), "minhash-distances")


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """rows: node and fp.  Pairs (a, b) of nodes whose fingerprints are within two bits, as operator 5 links them; nodes with
    one fingerprint are paired with the least of them."""
    least = stored(rows.groupBy("fp").agg(F.min("node").alias("first")), "minhash-fingerprints")
    same = rows.join(least, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    apart = linked_pairs(least.select("fp"))
    name = lambda c, n: least.select(F.col("fp").alias(c), F.col("first").alias(n))
    far = apart.join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(far)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right."""
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    hashes = [np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (left, right)]
    shared = np.intersect1d(*hashes)
    entries = []
    for h, o in zip(hashes, owners):
        code = np.searchsorted(shared, h)
        code[code == len(shared)] = 0
        held = shared[code] == h if len(shared) else np.zeros(len(h), bool)
        order = np.argsort(code[held], kind="stable")
        entries.append((code[held][order], o[held][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        factors = []
        for (code, owner), rows in zip(entries, out.shape):
            a, b = np.searchsorted(code, (at, at + COLUMNS))
            factors.append(np.zeros((rows, min(COLUMNS, len(shared) - at)), np.float32))
            factors[-1][owner[a:b], code[a:b] - at] = 1
        out += factors[0] @ factors[1].T
    return out


def joining(left: np.ndarray, right: np.ndarray, labels: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the linked places of a matrix of nodes, as many as join the components which labels (left, then right) don't."""
    labels, out = labels.copy(), []
    for i, row in enumerate(linked):
        at = np.flatnonzero(row)
        other, first = np.unique(labels[len(left) + at], return_index=True)
        apart = other != labels[i]
        if apart.any():
            out += [(int(left[i]), int(right[j])) for j in at[first[apart]]]
            labels[np.isin(labels, other[apart])] = labels[i]
    return out


def block_links(some: DataFrame, every: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """some, every: k and node, each once, stored.  Links (a, b) that join the components which roots (node, root) give:
    of nodes in some to nodes in every that share a key with them.  Stored."""
    width = max(-math.log(similarity), 1e-3) * (1 + 1e-6)  # sets of linked nodes are less than one such step apart in size
    sized = sets.select("node", "n", F.floor(F.log("n") / width).cast("int").alias("c"))
    some, every = (stored(df.join(sized, "node"), "minhash-sized") for df in (some, every))
    blocks = lambda: F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    shape = every.groupBy("k").agg(blocks().alias("n_right")).join(some.groupBy("k").agg(blocks().alias("n_left"), F.collect_set("c").alias("classes")), "k")
    shape = stored(shape, "minhash-shapes")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = some.join(shape, "k").select("k", "c", of("n_left").alias("i"), every_of("n_right").alias("j"), F.lit(True).alias("left"), "node")
    near = F.filter("classes", lambda x: F.abs(x - F.col("c")) <= 1)
    right = every.join(shape, "k").select("k", F.explode(near).alias("c"), "n_left", of("n_right").alias("j"), "node")
    right = right.select("k", "c", every_of("n_left").alias("i"), "j", F.lit(False).alias("left"), "node")
    held = left.union(right).join(sets.select("node", "s"), "node").join(roots, "node", "left").select("k", "c", "i", "j", "left", "node", F.coalesce("root", "node").alias("root"), "s")

    def run(table: pa.Table) -> pa.Table:
        on_left = table.column("left").to_numpy()
        nodes, labels, values = table.column("node").to_numpy(), table.column("root").to_numpy(), table.column("s").to_pylist()
        sides = [np.flatnonzero(on_left), np.flatnonzero(~on_left)]
        held = [[np.frombuffer(values[i], np.uint64) for i in side] for side in sides]
        counts = common_counts(*held)
        sizes = [np.array([len(x) for x in side], np.float64) for side in held]
        union = np.maximum(sizes[0][:, None] + sizes[1] - counts, 1)
        found = joining(nodes[sides[0]], nodes[sides[1]], labels[np.concatenate(sides)], counts >= (similarity - 1e-9) * union)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(held.groupBy("k", "c", "i", "j").applyInArrow(run, "a long, b long"), "minhash-block-links")


def crowded_links(hot: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """links (a, b) and what else connects the nodes of keys (hot: k, node; stored) with more than BUCKET."""
    if hot.isEmpty():
        return links
    links = stored(links, "minhash-links")
    first = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"]
    lead = hot.groupBy("k").agg(F.array_distinct(F.array(*[first(i) for i in range(LEADERS)])).alias("lead")).select("k", F.explode("lead").alias("node"))
    roots = stored(components(links), "minhash-roots")
    links = links.union(block_links(stored(lead, "minhash-leaders"), hot, sets, roots, similarity))
    roots = stored(components(links), "minhash-roots")
    at = stored(hot.join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("r")), "minhash-rooted")
    parts = at.groupBy("k", "r").count().groupBy("k").agg(F.count(F.lit(1)).alias("parts"), F.max_by("r", F.struct("count", "r")).alias("main")).where("parts > 1")
    rest = stored(at.join(parts, "k").select("k", "node", (F.col("r") != F.col("main")).alias("outside")), "minhash-rest")
    return links.union(block_links(rest.where("outside").select("k", "node"), rest.select("k", "node"), sets, roots, similarity))


def picked(table: DataFrame, row: str, some: DataFrame, every: DataFrame) -> DataFrame:
    """The rows of a stored table whose number (the column `row`) is in some; every: the numbers of all, each once.  Texts
    are not shuffled but for those in the smaller part, and what the filter takes for these."""
    some = stored(some.select(F.col("row").alias("n")), "minhash-picked")
    others = stored(every.select(F.col("row").alias("n")).join(some, "n", "left_anti"), "minhash-others")
    anti = others.count() < some.count()
    few = others if anti else some
    word, bits, number = fresh(table.columns, "filter_word", "filter_bits", "number")
    few = few.withColumnRenamed("n", number)
    slot = F.pmod(F.xxhash64(quoted(number)), F.lit(64 * FILTER_WORDS))
    bit_of = lambda slot: F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = few.select(F.floor(slot / 64).alias(word), bit_of(slot).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    own = F.pmod(F.xxhash64(quoted(row)), F.lit(64 * FILTER_WORDS))
    held = table.join(F.broadcast(words), F.floor(own / 64) == quoted(word), "left" if anti else "inner")
    within = F.coalesce(quoted(bits).bitwiseAND(bit_of(own)), F.lit(0).cast("long")) != 0
    plain = lambda df: df.select(*[quoted(c) for c in table.columns])
    maybe = plain(held.where(within)).join(few, quoted(row) == quoted(number), "left_anti" if anti else "left_semi")
    return plain(held.where(~within)).union(maybe) if anti else maybe


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one row left of each group of near copies: that of the least id (null ids last), one of repeated rows.

    Texts without words (null ones too) are copies of each other.  A very long text is a set as large.  The columns are
    those of df, whatever their names; an empty table gives an empty one.  Rows are told apart by a number of their own,
    so repeated or null ids do no harm.
    """
    node, keys, fp, row = fresh(df.columns, "node", "keys", "fp", "row_number")
    table = _nodes(df, text_col, shingle, similarity, BAND, node, keys, fp)
    table = stored(table.withColumn(row, F.monotonically_increasing_id()), "minhash-rows")
    rows = table.select(quoted(node).alias("node"), quoted(row).alias("row"))
    one = stored(rows.groupBy("node").agg(F.min("row").alias("row")), "minhash-nodes")
    first = table.select(quoted(node).alias("node"), quoted(row).alias("row"), quoted(keys).alias("keys"), quoted(fp).alias("fp"))
    first = picked(first, "row", one, rows)
    every_key = Stored(first.select("node", F.explode(F.array_distinct("keys")).alias("k")), "minhash-keys")
    members = shared_keys(every_key.df)
    every_key.drop()
    hot = stored(members.where(F.col("count") > BUCKET).select("k", "node"), "minhash-hot")
    pairs = stored(close_pairs(members).union(fingerprint_pairs(stored(first.select("node", "fp"), "minhash-first"))).distinct(), "minhash-proposed")
    asked = one.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct(), "node", "left_semi")
    texts = picked(table.select(quoted(node).alias("node"), quoted(row).alias("row"), quoted(text_col).alias("text")), "row", asked, rows)
    sets = shingle_sets(texts, shingle)
    links = distances(pairs, sets).where(F.col("d") <= 1 - similarity + 1e-9).select("a", "b")
    roots = components(crowded_links(hot, links, sets, similarity))
    classes = one.join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", F.coalesce("root", "node").alias("component"))
    classes = stored(classes, "minhash-classes")
    tagged = table.select(quoted(id_col).alias("id"), quoted(node).alias("node"), quoted(row).alias("row")).join(classes, "node")
    stay = tagged.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("x")).select("x.row")
    return picked(table.drop(keys, fp), row, stay, rows).drop(node, row)
