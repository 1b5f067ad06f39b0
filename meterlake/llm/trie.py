"""A prefix trie of conversations, totalled by messages from the leaves to the root.

Every prefix of a conversation is named by 128 bits: the exclusive or of its turns' hashes, each with its depth.  Prefixes
with one name are a node.  Each node is represented by one member, that with the least hash of its id.  The nodes that a
conversation represents follow each other on its own path, so they are one run of the trie, and as the order is by hash, a
way from a leaf to the root meets about ln(members) runs whatever the trie's shape.

Runs are peeled from the leaves: each has a counter of the runs that hang from it and haven't reported.  Runs at zero are
complete: they send their totals to their parents, whose counters fall by as many, until only the root's run is left.  A
last running sum along each run gives the totals of its nodes.  Running sums are taken in cells of CELL turns, with the
cells' totals carried on, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, arrow_batches, quoted, stored

#: Places of a conversation in a cell, as a power of two; ids in a piece of a list of ids likewise.
CELL_BITS, IDS_BITS = 12, 10
NODE = ["depth", "p1", "p2"]


def ordered(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, depth (long, from 1 without gaps), role and text (null: empty); turns in order of turn, role and text, nulls first.

    Rows are dealt by ranges of the whole order and numbered in the part of a conversation that a range holds, so a
    conversation with a third of all rows is numbered by many tasks.  Stored.
    """
    text = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = df.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), quoted(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = stored(rows.repartitionByRange("id", "turn", "role", "text", "row").withColumn("part", F.spark_partition_id()), "trie-dealt")
    before = F.sum("count").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    split = dealt.groupBy("id", "part").count().withColumn("before", before).where("before IS NOT NULL").select("id", "part", "before")
    place = F.row_number().over(Window.partitionBy("id", "part").orderBy("turn", "role", "text", "row"))
    numbered = dealt.withColumn("place", place).join(split, ["id", "part"], "left")
    return stored(numbered.select("id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("depth"), "role", "text"), "trie-turns")


def spliced(turns: DataFrame, ids: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns of the first id of its group, then its own turns after its first h, where
    h is the crc32 of its id modulo heads.  turns: id, depth, role, text.  The same columns."""
    asked = ids.select("id", (F.col("id") - F.col("id") % group).alias("base"), (F.crc32(F.col("id").cast("string")) % heads).alias("h"))
    lengths = turns.groupBy("id").agg(F.max("depth").alias("length")).withColumnRenamed("id", "base")
    asked = asked.join(lengths, "base", "left").withColumn("got", F.least("h", F.coalesce("length", F.lit(0)))).drop("length")
    lead = turns.where(F.col("depth") < heads).withColumnRenamed("id", "base")
    borrowed = asked.where("got > 0").join(lead, "base").where("depth <= got").select("id", "depth", "role", "text")
    own = turns.join(asked, "id").where("depth > h").select("id", (F.col("depth") - F.col("h") + F.col("got")).alias("depth"), "role", "text")
    return borrowed.union(own)


def running(df: DataFrame, key: str, at: str, folds: dict[str, Callable], combine: Callable[[Column, Column], Column], backwards: bool = False) -> DataFrame:
    """df (a table) with each column of folds folded over its key's rows up to its own, in order of at or backwards."""
    order = lambda c: F.col(c).desc() if backwards else F.col(c).asc()
    df = df.withColumn("cell", F.shiftright(at, CELL_BITS))
    inside = Window.partitionBy(key, "cell").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(key).orderBy(order("cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(c) for c, f in folds.items()])
    carry = totals.select(key, "cell", F.sum("rows").over(across).alias("rows"), *[f(F.col(c)).over(across).alias(f"carry_{c}") for c, f in folds.items()]).where("rows IS NOT NULL").drop("rows")
    out = df.withColumns({c: f(F.col(c)).over(inside) for c, f in folds.items()}).join(carry, [key, "cell"], "left")
    return out.withColumns({c: F.coalesce(combine(F.col(c), F.col(f"carry_{c}")), c) for c in folds}).drop("cell", *[f"carry_{c}" for c in folds])


def _digests(ends: DataFrame) -> DataFrame:
    """ends: the node and id of each conversation that ends there.  A row per node: the SHA-256 of its ids, ascending, with
    commas between.  A task streams the list of a node in pieces, however long; a SHA-256 can't be taken in parts."""
    pieces = ends.groupBy(*NODE, F.shiftright("id", IDS_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield rows(out)
        yield rows([] if node is None else [(*node, sha.hexdigest())])

    def rows(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return dealt.mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _peeled(runs: DataFrame) -> DataFrame:
    """runs: run, parent (null: the root's), attach, waiting, leaves, saved; stored.  The same with the totals of all that
    hangs from each run.  Each round, complete runs report to their parents."""
    rounds = [runs]
    while not (rest := rounds[-1].where("waiting > 0")).isEmpty():
        came = rounds[-1].where("waiting = 0").groupBy(F.col("parent").alias("run")).agg(F.count(F.lit(1)).alias("came"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
        after = rest.join(came, "run", "left").select("run", "parent", "attach", (F.col("waiting") - F.coalesce("came", F.lit(0))).alias("waiting"), more("leaves", "more_leaves").alias("leaves"), more("saved", "more_saved").alias("saved"))
        rounds.append(stored(after, "trie-round"))
    out = rounds[0].where("waiting = 0")
    for table in rounds[1:]:
        out = out.union(table.where("waiting = 0"))
    return out


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """turns: id (long), depth (long, from 1 without gaps), role and text, no nulls, as ordered() gives them; ids: all
    conversations, each once, if some have no turns.  A row per node, all long: conv_id (the smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, and ends_sha256 (string).

    Equal turns make equal nodes, so conversations with the same turns end at one node.  Texts are hashed, however long.
    No conversation, no node, not even a root.
    """
    arrow_batches(turns.sparkSession)
    hashed = stored(turns.select("id", "depth", F.xxhash64("depth", "role", "text").alias("p1"), F.xxhash64(F.lit(17), "text", "role", "depth").alias("p2"), F.char_length("text").cast("long").alias("length")), "trie-hashes")
    ids = stored(hashed.select("id").distinct() if ids is None else ids.select("id"), "trie-ids")
    last = hashed.groupBy("id").agg(F.max("depth").alias("last"))
    xor = lambda a, b: a.bitwiseXOR(b)
    named = running(hashed.withColumns({"h1": F.col("p1"), "h2": F.col("p2")}), "id", "depth", {"p1": F.bit_xor, "p2": F.bit_xor}, xor)
    named = named.join(last, "id").select("id", *NODE, xor(F.col("p1"), F.col("h1")).alias("q1"), xor(F.col("p2"), F.col("h2")).alias("q2"), "length", (F.col("depth") == F.col("last")).alias("ends"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    tops = ids.join(last, "id", "left").select("id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), zero.alias("length"), F.col("last").isNull().alias("ends"))
    members = stored(named.union(tops), "trie-members")
    # Partial aggregation meets a first turn that all conversations share before the exchange does.
    nodes = members.groupBy(*NODE).agg(F.min("id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min(F.struct(F.xxhash64("id").alias("order"), "id"))["id"].alias("run"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("length").alias("length"))
    nodes = stored(nodes, "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("run").alias("parent"))
    saved = (F.col("n_convs") - 1) * F.col("length")
    linked = nodes.join(above, ["depth", "q1", "q2"], "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", saved.alias("saved"), "run", "parent")
    linked = stored(linked, "trie-links")
    children = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("run"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("run") != F.col("parent")).alias("hanging"))
    counted = linked.join(children, ["run", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    counted = stored(counted, "trie-nodes")
    top = counted.where(F.col("parent").isNull() | (F.col("parent") != F.col("run"))).select("run", "parent", (F.col("depth") - 1).alias("attach"))
    sums = counted.groupBy("run").agg(F.coalesce(F.sum("hanging"), zero).alias("waiting"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    runs = stored(top.join(sums, "run").select("run", "parent", "attach", "waiting", "leaves", "saved"), "trie-runs")
    sent = _peeled(runs).where("parent IS NOT NULL").groupBy(F.col("parent").alias("run"), F.col("attach").alias("depth")).agg(F.sum("leaves").alias("leaves_in"), F.sum("saved").alias("saved_in"))
    met = counted.join(sent, ["run", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("leaves_in", zero), "saved": F.col("saved") + F.coalesce("saved_in", zero)})
    met = stored(met.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "run", "leaves", "saved"), "trie-met")
    totals = running(met, "run", "depth", {"leaves": F.sum, "saved": F.sum}, lambda a, b: a + b, backwards=True)
    digests = _digests(members.where("ends").select(*NODE, "id"))
    out = totals.join(digests, NODE, "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The prefix trie of the conversations in df; see prefix_trie for its rows.  rebuild makes other turns of all turns and
    ids first.  Ids are whole numbers; rows without one belong to no conversation and are left out.  A null role or text is
    empty; ties of turn are in order of role and text; repeated rows are turns of their own; other columns are not used."""
    turns = ordered(df, id_col, turn_col, role_col, text_col)
    ids = stored(turns.select("id").distinct(), "trie-ids")
    return prefix_trie(rebuild(turns, ids) if rebuild else turns, ids)


def oracle() -> str:
    """The query over `conversations` in DuckDB's SQL: paths as whole lists of turns, subtrees by all pairs on a path."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda y: ord(y)::BIGINT)), lambda a, o: list_reduce(list_prepend(xor(a, o), range(0, 8)), lambda u, k: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384 ELSE 0 END)))"
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - c % 100 AS base, xor({crc}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
l AS (SELECT c AS base, max(d) AS n FROM t GROUP BY c),
g AS (SELECT i.c, i.base, i.h, least(i.h, coalesce(l.n, 0)) AS got FROM i LEFT JOIN l USING (base)),
b AS (SELECT g.c, t.d, t.r, t.x FROM g JOIN t ON t.c = g.base AND t.d <= g.got UNION ALL SELECT g.c, t.d - g.h + g.got, t.r, t.x FROM g JOIN t ON t.c = g.c AND t.d > g.h),
p AS (SELECT c, d, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS k, length(x) AS len FROM b UNION ALL SELECT c, 0, [{{'r': '', 'x': ''}}][1:0], 0 FROM g),
z AS (SELECT c, max(d) AS n FROM p GROUP BY c),
e AS (SELECT p.k, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS s FROM p JOIN z ON p.c = z.c AND p.d = z.n GROUP BY p.k),
n AS (SELECT k, any_value(d) AS d, min(c) AS conv, count(*) AS m, any_value(len) AS len FROM p GROUP BY k),
f AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(f.kids, 0) AS kids FROM n LEFT JOIN f ON n.k = f.k),
a AS (SELECT p.k, sum((w.kids = 0)::INT) AS leaves, sum((w.m - 1) * w.len) AS saved FROM w JOIN p ON p.c = w.conv AND p.d <= w.d GROUP BY p.k)
SELECT w.conv AS conv_id, w.d::BIGINT AS depth, u.conv AS parent_conv_id, w.m AS n_convs, w.kids AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, coalesce(e.s, sha256('')) AS ends_sha256
FROM w JOIN a ON w.k = a.k LEFT JOIN e ON w.k = e.k LEFT JOIN n u ON w.d > 0 AND u.k = w.k[1:w.d - 1]"""
