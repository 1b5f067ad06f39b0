"""Uniform shuffle into shards of exact sizes, by a communication matrix.

Each input block draws, from the multivariate hypergeometric law, how many of its rows go to each cell of the output;
the draws of all blocks add up to the exact cell sizes.  A block permutes its rows locally and deals them out by its
row of the matrix, the rows are exchanged, and each cell permutes what it received.  Every arrangement of rows is then
as likely as any other, and no shard differs from another by more than one row.

A cell is a slice of a shard's slots, so that a shard is never the work of a single task.  The matrix has at most
MAX_BLOCKS x MAX_CELLS entries (32 MB), whatever the size of the input, and is all that the driver sees.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, stored, without

MAX_BLOCKS, MAX_CELLS, GROUP = 4096, 1024, 32


#: Rows up to which numpy draws from the hypergeometric law.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` drawn without return are good, for counts of any size: by inversion over all counts that have a
    chance of 1e-30 or more, whose chances follow from each other by exact ratios."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    wide = math.sqrt(draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1)))
    a, b = max(low, mode - int(12 * wide) - 64), min(high, mode + int(12 * wide) + 64)
    k = np.arange(a, b, dtype=np.float64)
    logs = np.concatenate(([0.0], np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))))
    chance = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Row sums are `blocks`, column sums are `cells`; drawn as a uniform permutation would give it.  A table of more rows
    than numpy's generator takes is first split: half of the blocks draw their share of every cell, again and again."""
    rng = np.random.default_rng(seed)

    def drawn(blocks: list[int], cells: list[int]) -> list[list[int]]:
        if sum(cells) < NUMPY_LIMIT:
            left, out = np.array(cells), []
            for n in blocks:
                out.append(rng.multivariate_hypergeometric(left, n, method="marginals"))
                left = left - out[-1]
            return [x.tolist() for x in out]
        if len(blocks) == 1:
            return [list(cells)]
        half = len(blocks) // 2
        first, rest, draws = [], sum(cells), sum(blocks[:half])
        for size in cells:
            first.append(hypergeometric(rng, size, rest - size, draws))
            rest, draws = rest - size, draws - first[-1]
        return drawn(blocks[:half], first) + drawn(blocks[half:], [a - b for a, b in zip(cells, first)])

    return drawn(blocks, cells)


def uniform_shards(df: DataFrame, shards: int = 8, seed: int = 0, rows_per_cell: int = 20_000) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (0 onward without gaps in each shard); sizes differ by one row at most.

    The place of a row depends on the seed and on its place in the input's partitions, not on its values, so copies are
    dealt out like any rows.  Null and empty values, very long ones and repeated rows are ordinary rows; an empty table
    gives an empty table; columns of df named shard or slot are replaced.
    The table is written once to the shared folder, so pass only the columns that are wanted in the result.
    """
    spark = df.sparkSession
    df = without(df, "shard", "slot")
    block, at, cell, starts = fresh(df.columns, "block", "at", "cell", "starts")
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    # Local permutation; the id of a row then holds its block and its place in it.
    mixed = df.coalesce(MAX_BLOCKS).withColumn(at, key).sortWithinPartitions(at).withColumn(at, F.monotonically_increasing_id())
    mixed = mixed.withColumn(block, F.shiftrightunsigned(at, 33).cast("int")).withColumn(at, quoted(at).bitwiseAND(F.lit((1 << 33) - 1)))
    mixed = stored(mixed, "sharding")
    counts = {r[0]: r[1] for r in mixed.groupBy(quoted(block)).count().collect()}  # MAX_BLOCKS rows at most
    n = sum(counts.values())
    slices = max(1, min(MAX_CELLS // shards, -(-n // (shards * rows_per_cell))))
    size = [n // shards + (s < n % shards) for s in range(shards)]
    cells = [size[s] // slices + (k < size[s] % slices) for s in range(shards) for k in range(slices)]
    order = sorted(counts)
    rows = []
    for b, row in zip(order, communication_matrix([counts[b] for b in order], cells, seed)):
        first = [0, *np.cumsum(row).tolist()[:-1]]
        groups = [first[i : i + GROUP] for i in range(0, len(first), GROUP)]
        rows.append({"b": b, "g": [x[0] for x in groups], "s": groups})
    json_rows = spark.createDataFrame([(json.dumps(x),) for x in rows], "j string")
    matrix = json_rows.select(F.from_json("j", "struct<b:int,g:array<bigint>,s:array<array<bigint>>>").alias("x"))
    matrix = stored(matrix.select(F.col("x.b").alias(block), F.struct("x.g", "x.s").alias(starts)), "sharding-matrix")
    dealt = mixed.join(F.broadcast(matrix), block)  # MAX_BLOCKS x MAX_CELLS numbers at most
    # The last start that isn't above the row's place, first among the groups of cells, then within the group.
    group = F.size(F.filter(quoted(starts)["g"], lambda x: x <= quoted(at)))
    dealt = dealt.withColumn(cell, group)
    inside = F.size(F.filter(F.element_at(quoted(starts)["s"], quoted(cell)), lambda x: x <= quoted(at)))
    dealt = dealt.withColumn(cell, (quoted(cell) - 1) * GROUP + inside - 1)
    # Exchange, and permute again within the cell.
    again = Window.partitionBy(quoted(cell)).orderBy(F.xxhash64(F.lit(seed + 1), quoted(block), quoted(at)), quoted(block), quoted(at))
    shard, part = F.floor(quoted(cell) / slices).cast("int"), (quoted(cell) % slices).cast("long")
    per, extra = F.lit(n // shards) + (shard < n % shards).cast("long"), None
    base = part * F.floor(per / slices).cast("long") + F.least(part, per % slices)
    return dealt.withColumn("shard", shard).withColumn("slot", (base + F.row_number().over(again) - 1).cast("long")).drop(block, at, cell, starts)
