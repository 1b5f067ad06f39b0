"""Cost-balanced packing of token sequences.

A document's full stretches of `capacity` tokens are sequences of their own, as they are in the order of cost: no piece
costs more, so they come first, and each fills the first empty sequence.  What remains of each document is packed in blocks of bounded size: a block opens as many sequences as its tokens need, and takes its pieces in descending order of
estimated cost (linear plus quadratic in length, as attention is), each to the sequence of lowest cost that has room.
Pieces for which none has room are cut over the room that is left, so a block pads less than one sequence.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import arrow_batches, fresh, quoted, stored
from .pieces import PieceNumbers, character_classes, flat

CAPACITY, BLOCK = 2048, 4096
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
RESULTS = "start length ids_crc32 doc_tokens sequence_id offset padded_to ids".split()


class WordIds:
    """Ids of whole texts by a byte-level BPE tokenizer, with ids remembered for the pieces of its pattern.

    Texts with a special token, and all texts of a tokenizer of another kind, are encoded whole by the library.
    """

    def __init__(self, path: str, table: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(spec)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec["added_tokens"]]
        by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        ranked = self._ranked(spec["model"]) if by_piece else None
        self.pieces = PieceNumbers(ranked or self._by_library, character_classes() if table is None else table, True, False) if by_piece else None

    @staticmethod
    def _ranked(model: dict):
        """A faster encoder of pieces with the same ids: only if an id is the rank of its merge."""
        byte = {c: i for i, c in enumerate(byte_symbols())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or not all(len(t) == 1 for t, i in model["vocab"].items() if i < 256):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        one = tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # the whole is one piece
        return lambda pieces: [one(p.decode()) for p in pieces]

    def _by_library(self, pieces: list[bytes]) -> list[list[int]]:
        out = []
        for i in range(0, len(pieces), 1000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces[i : i + 1000]], add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls are empty), one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), self.pieces is None)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.pieces.of(*flat(texts))
        aside = {int(i): np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(whole)}
        rest, counts = self.pieces.of(*flat(pc.if_else(pa.array(whole), "", texts))) if self.pieces else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        parts = np.split(rest, np.cumsum(counts)[:-1])
        for i, ids in aside.items():
            parts[i], counts[i] = ids, len(ids)
        return np.concatenate(parts), counts


_MADE: dict[str, WordIds] = {}


def word_ids(path: str, table: np.ndarray | None = None) -> WordIds:
    """One for each worker process."""
    if path not in _MADE:
        _MADE[path] = WordIds(path, table)
    return _MADE[path]


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def packed(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, length, sequence, offset in that) of items no longer than a sequence."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    used, spent, out, over = np.zeros(n, np.int64), np.zeros(n), [], []
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        room = np.where(used + size <= capacity, spent, np.inf)
        k = int(room.argmin())
        if room[k] == np.inf:
            over.append(item)
            continue
        out.append((int(item), 0, size, k, int(used[k])))
        used[k] += size
        spent[k] += cost(size)
    spare = sorted(np.flatnonzero(used < capacity).tolist(), key=lambda k: (used[k], k), reverse=True) if over else []
    for item in over:
        at, size = 0, int(lengths[item])
        while at < size:
            k = spare[-1]
            take = min(size - at, capacity - int(used[k]))
            out.append((int(item), at, take, k, int(used[k])))
            used[k] += take
            at += take
            if used[k] == capacity:
                spare.pop()
    return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """A row per piece: the id, start, length, ids_crc32 (unsigned, of little-endian 32-bit ids), doc_tokens,
    sequence_id, offset (longs), padded_to (long), and with_ids the ids as bytes.

    A null or empty text is its end token alone.  Repeated rows are packed each for itself; an empty table gives no
    piece.  A long text is encoded in stretches and gives as many pieces as it needs.  A sequence is padded to the
    capacity, except where its length is a power of two.  Blocks are dealt by a row number in a stored table, so neither a
    repeated id nor a lost executor changes them.  An id column with the name of a result has underscores put before it;
    other columns are not used.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    kind = df.schema[id_col].dataType
    id_name, given = "id", fresh([*RESULTS, "row", "block"], id_col)[0]
    pieces = T.StructType([T.StructField(id_name, kind)] + T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary").fields)

    classes = spark.sparkContext.broadcast(character_classes())  # a megabyte

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = 0, TaskContext.get().partitionId()
        encoder = word_ids(tokenizer_path, classes.value)
        for batch in batches:
            ids, counts = encoder.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            n = -(-counts // capacity)  # pieces of each text
            at = np.repeat(np.arange(len(counts)), n)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(counts[at] - start, capacity)
            whole = length == capacity
            ends = np.cumsum(length)
            data = memoryview(ids.view(np.uint8))
            crc = np.zeros(len(at), np.int64)
            for k in np.flatnonzero(whole):
                crc[k] = zlib.crc32(data[4 * (ends[k] - capacity) : 4 * ends[k]])
            sequence = (np.int64(1) << 62) | np.int64(part << 40) | (made + np.cumsum(whole) - whole)
            made += int(whole.sum())
            kept = np.ones(len(at), bool) if with_ids else ~whole
            narrow = not with_ids and len(ids) and ids.max() < 65536
            small = ids if with_ids else ids[np.repeat(kept, length)]
            small = small.astype("<u2" if narrow else "<u4")
            offsets = pa.array(np.concatenate(([0], np.cumsum(length * kept) * small.itemsize)).astype(np.int32))
            binary = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets.buffers()[1], pa.py_buffer(small)])
            sequence = pa.array(sequence, mask=~whole)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(start), pa.array(length), pa.array(crc), pa.array(counts[at]), sequence, binary], pieces.names)

    table = df.select(quoted(id_col).alias(id_name), quoted(text_col).alias("text")).mapInArrow(cut, pieces).withColumn("row", F.monotonically_increasing_id())
    table = stored(table, "pieces")
    rest = table.where("sequence_id IS NULL")
    blocks = max(1, -(-rest.count() // BLOCK))
    out_schema = T.StructType(pieces.fields[:6] + T._parse_datatype_string("offset long, padded_to long, ids binary").fields)

    def fill(block: pa.Table) -> pa.Table:
        block = block.sort_by("row")
        lengths = block.column("length").to_numpy()
        number, start0, whole_ids = block.column("block")[0].as_py(), block.column("start").to_numpy(), block.column("ids").to_pylist()
        placed = packed(lengths, capacity)
        ends: dict[int, int] = {}
        for _, _, n, k, offset in placed:
            ends[k] = max(ends.get(k, 0), offset + n)
        rows, at = [], []
        for item, start, n, k, offset in placed:
            raw = whole_ids[item]
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * lengths[item] else "<u4")[start : start + n].astype("<u4").tobytes()
            at.append(item)
            rows.append((int(start0[item]) + start, n, zlib.crc32(ids), number << 20 | k, offset, ends[k] if ends[k] & (ends[k] - 1) == 0 else capacity, ids if with_ids else None))
        c = list(zip(*rows)) if rows else [[]] * 7
        take = pa.array(at, pa.int32())
        long = [pa.array(x, pa.int64()) for x in c[:6]]
        return pa.table([block.column(id_name).take(take), *long[:3], block.column("doc_tokens").take(take), *long[3:], pa.array(c[6], pa.binary())], out_schema.names)

    dealt = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    tails = dealt.groupBy("block").applyInArrow(fill, out_schema)
    wholes = table.where("sequence_id IS NOT NULL").select(*pieces.names[:6], F.lit(0).cast("long").alias("offset"), F.lit(capacity).cast("long").alias("padded_to"), "ids")
    out = wholes.unionByName(tails).withColumnRenamed(id_name, given)
    return out if with_ids else out.drop("ids")
