"""Exact nearest neighbours by a block matrix join.

Queries are dealt to blocks and candidates to groups, and a block meets a group in a cell of the matrix: one task's stretch
of rows, the queries first, then the candidates batch after batch.  Vectors are rounded to int8 with a scale of their own;
the product of a block and a batch gives the distances of the rounded vectors, which are off by the two rounding errors at
most.  A pair whose least possible distance is beyond its query's k-th distance so far, or beyond the k-th of the greatest
possible ones in the batch, is settled; the others are computed in double precision from the vectors as given and go to
the query's heap.  The heaps of a block's cells are merged by rank.  Nothing is lost: each bound holds for every pair.

A cell holds its queries, their heaps and one batch, however many candidates it meets.  Copies of a vector, of which only
the k smallest ids can be near, are met once in a batch; so a vector that a third of all rows have costs little.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, quoted, stored

#: Queries of a block at most on average; candidates of a group likewise, and at least if the table has so many.
QUERIES, CANDIDATES, LEAST = 1 << 17, 1 << 20, 1 << 11
#: Groups of candidates for which small tables are cut smaller.
GROUPS = 64
#: Rows of a tile of the product.
TILE = 1024
_LAST = 1 << 63  # the place of a null id among ties


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null, empty, zero nor with a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rounded:
    """Rows of vectors as int8 codes with a scale each, the squares of their lengths, and bounds of their errors."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        exact = rows.astype(np.float64)
        self.scale = np.maximum(np.abs(exact).max(axis=1) / 127, np.finfo(np.float64).tiny)
        self.codes = np.rint(exact / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.error = np.sqrt(((exact - near) ** 2).sum(axis=1)) * (1 + 1e-9)
        self.square = self.scale**2 * (self.codes.astype(np.float64) ** 2).sum(axis=1)
        #: Products of codes are whole numbers, exact in this type.
        self.product = np.float32 if rows.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.factor = self.codes.astype(self.product)

    def bounds(self, at: slice, other: Rounded) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distances of the rows at a slice to the rows of the other."""
        products = (self.factor[at] @ other.factor.T).astype(np.float64)
        both = self.square[at, None] + other.square
        squares = both - 2 * (self.scale[at, None] * other.scale) * products
        slack = both * 1e-12  # of the arithmetic
        error = self.error[at, None] + other.error
        return np.sqrt(np.maximum(squares - slack, 0)) - error, np.sqrt(np.maximum(squares + slack, 0)) + error


class Block:
    """The queries of one cell with a heap each of the nearest candidates so far, the farthest on top."""

    def __init__(self, rows: np.ndarray, own: np.ndarray, ids: list, k: int):
        self.vectors, self.own, self.ids, self.k = Rounded(rows), own, ids, k
        self.heaps: list[list[tuple]] = [[] for _ in ids]
        self.reach = np.full(len(ids), np.inf)

    def meet(self, rows: np.ndarray, numbers: np.ndarray, ids: list) -> None:
        """numbers: of the candidates' rows, which tell a query from its copies; ids may be null."""
        keys = np.array([_LAST if i is None else i for i in ids], object)
        keep = self._distinct(rows, keys)
        rows, numbers, keys = rows[keep], numbers[keep], keys[keep]
        other = Rounded(rows)
        for begin in range(0, len(self.ids), TILE):
            at = slice(begin, min(begin + TILE, len(self.ids)))
            least, most = self.vectors.bounds(at, other)
            most[self.own[at, None] == numbers] = np.inf
            limit = self.reach[at].copy()
            if len(rows) > self.k:
                limit = np.minimum(limit, np.partition(most, self.k - 1, axis=1)[:, self.k - 1])
            q, c = np.nonzero(~(least > limit[:, None]) & (self.own[at, None] != numbers))
            for i in range(0, len(q), 1 << 16):
                self._push(q[i : i + (1 << 16)] + begin, c[i : i + (1 << 16)], rows, keys)

    def _distinct(self, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of the rows without those that k + 1 copies with smaller ids precede (one may be the query itself)."""
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        whole = np.ascontiguousarray(rows[order] + rows.dtype.type(0))  # minus zero is zero
        _, group = np.unique(whole.view(np.dtype((np.void, whole.strides[0]))).ravel(), return_inverse=True)
        together = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[together], prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        return order[np.sort(together[place <= self.k])]

    def _push(self, q: np.ndarray, c: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> None:
        apart = self.vectors.rows[q].astype(np.float64) - rows[c].astype(np.float64)
        exact = np.sqrt((apart * apart).sum(axis=1))
        near = np.flatnonzero(exact <= self.reach[q])
        for i, d, key in zip(q[near].tolist(), exact[near].tolist(), keys[c[near]].tolist()):
            heap, entry = self.heaps[i], (-d, -key)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.reach[i] = -heap[0][0]

    def found(self) -> list[tuple]:
        """Number of the query's row, its id, the candidate's id, the distance."""
        return [(own, i, None if key == -_LAST else -key, -d) for own, i, heap in zip(self.own.tolist(), self.ids, self.heaps) for d, key in heap]


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id and score (double): the k nearest rows by Euclidean distance of each row for
    which is_query holds; all if there are fewer; ties to the smaller id, null ids last.

    Every row but the query's own is a candidate, also one with the same id or vector; repeated rows are queries and
    candidates of their own.  Vectors that are null, empty, zero or have null or non-finite components take no part, and
    vectors of different lengths don't meet.  Other columns are not used; an empty table gives an empty one.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("vector")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "nearest-rows")
    asks, total = rows.agg(F.count_if("asks"), F.count(F.lit(1))).first()
    blocks, groups = max(1, -(-asks // QUERIES)), max(1, -(-total // CANDIDATES), min(GROUPS, total // LEAST))
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    size, every = F.size("vector").alias("size"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").select(size, dealt(blocks, 1).alias("block"), every(groups).alias("group"), F.lit(0).alias("kind"), "row", "id", "vector")
    candidates = rows.select(size, every(blocks).alias("block"), dealt(groups, 2).alias("group"), F.lit(1).alias("kind"), "row", "id", "vector")
    cells = queries.union(candidates).repartition(max(blocks * groups, 1), "size", "block", "group").sortWithinPartitions("size", "block", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, block, asked = None, None, []
        for batch in batches:
            size, at, group, kind = (batch.column(i).to_numpy() for i in range(4))
            edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(at) != 0) | (np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
                if a == b:
                    continue
                part, here = batch.slice(a, b - a), (size[a], at[a], group[a])
                vectors = part.column(6).flatten().to_numpy().reshape(b - a, size[a])
                numbers, ids = part.column(4).to_numpy(), part.column(5).to_pylist()
                if here != cell:
                    yield rows_of(block)
                    cell, block, asked = here, None, []
                if kind[a] == 0:
                    asked.append((vectors, numbers, ids))
                elif asked:
                    if block is None:
                        block = Block(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]), [i for x in asked for i in x[2]], k)
                    block.meet(vectors, numbers, ids)
        yield rows_of(block)

    def rows_of(block: Block | None) -> pa.RecordBatch:
        columns = list(zip(*(block.found() if block else []))) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["row", "query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10) -> str:
    """The query over `embeddings` in DuckDB's SQL."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id NULLS LAST) AS k FROM d)
SELECT query_id, k::INT AS rank, vec_id, score FROM n WHERE k <= {k}"""
