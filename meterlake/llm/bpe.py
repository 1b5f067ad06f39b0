"""Byte-pair encoding and decoding with a contiguous array of ranks.

A word is held as the boundaries of its parts and, beside each, the rank of joining it with the next part.  The array is
scanned for its least rank, that boundary is deleted, and the ranks on either side are looked up anew.  A word of more
than SHORT symbols keeps its parts in linked lists with a heap of ranks instead, which makes the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_batches, mapped, quoted
from .pieces import WHITE, PieceNumbers, character_classes, flat

#: Symbols of a word that the array is for; ids whose text is made at once.
SHORT, JOINED = 128, 1 << 20
_NO = 1 << 60


@lru_cache
def unlike_python(tokenizer_path: str) -> np.ndarray:
    """For every code point whether the tokenizer's normalizer may treat it unlike Python: texts with one go through the
    normalizer itself.  Each is normalized alone, after a mark of a high class and before one of a low class (which shows
    its own class); those that Python's tables don't know are taken as different.
    """
    from tokenizers import Tokenizer

    normalizer = Tokenizer.from_file(tokenizer_path).normalizer
    out = np.array([0xD800 <= c < 0xE000 or unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    points = np.flatnonzero(~out)[1:]
    spaces = character_classes()[points] == WHITE
    for before, after in (("", ""), ("x\u0345", ""), ("x", "\u0334")):
        apart = "\0".join([before + chr(c) + after for c in points])
        pairs = zip(normalizer.normalize_str(apart).split("\0"), normalized(apart).split("\0")) if normalizer else ()
        out[points[np.fromiter((x != y for x, y in pairs), bool) & ~spaces]] = True
    return out


def normalized(text: str) -> str:
    """Canonical composition and lower case, without a final sigma by context."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class WordBpe:
    """A tokenizer of the word kind (lower case, white space dropped, words end in a suffix), from its file."""

    def __init__(self, path: str, classes: np.ndarray | None = None, odd: np.ndarray | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        self.normalizer = Tokenizer.from_str(text).normalizer
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.decimal = pa.array([str(i) for i in range(len(self.tokens))], pa.string())
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        self.odd = unlike_python(path) if odd is None else odd
        classes = character_classes() if classes is None else classes
        self.white = frozenset(map(chr, np.flatnonzero(classes == WHITE)))
        self.pieces = PieceNumbers(self._ids, classes, False, True)

    def merged(self, parts: list[str]) -> list[str]:
        if len(parts) > SHORT:
            return self._merged_long(parts)
        ranks, text = self.ranks, "".join(parts)
        at = [0]
        for p in parts:
            at.append(at[-1] + len(p))
        rank = [ranks.get((a, b), _NO) for a, b in zip(parts, parts[1:])] + [_NO]
        # at[i]: where part i begins; rank[i]: of joining part i with part i + 1.
        while (least := min(rank)) < _NO:
            i = rank.index(least)
            del at[i + 1], rank[i + 1]
            here = text[at[i] : at[i + 1]]
            rank[i] = ranks.get((here, text[at[i + 1] : at[i + 2]]), _NO) if i + 2 < len(at) else _NO
            if i:
                rank[i - 1] = ranks.get((text[at[i - 1] : at[i]], here), _NO)
        return [text[a:b] for a, b in zip(at, at[1:])]

    def _merged_long(self, parts: list[str]) -> list[str]:
        n, part = len(parts), list(parts)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p, ok in zip(part, alive) if ok]

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces of the pattern; white space has none."""
        symbols, ids, out = self.symbols, self.vocabulary, []
        for piece in pieces:
            text = piece.decode()
            if text[0] in self.white:
                out.append([])
                continue
            parts = [symbols[b] for b in piece]
            parts[-1] += self.suffix
            out.append([ids[x] for x in self.merged(parts) if x in ids])
        return out

    def _normal(self, text: str) -> str:
        if self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.normalizer.normalize_str(text) if self.normalizer else text
        return normalized(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls are empty), one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        ascii_only = pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for x in self.special:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if ascii_only.all() and not special.any():
            return self._of(texts)
        # Texts with special tokens are cut at them; the tokens stand between the stretches of one text.
        stretches, owner, between = [], [], []
        for i, (text, plain, cut) in enumerate(zip(texts.to_pylist(), ascii_only, special)):
            parts, at = [], 0
            for m in self.cut.finditer(text) if cut else ():
                parts.append(text[at : m.start()])
                between.append((len(stretches) + len(parts), self.special[m[0]], i))
                at = m.end()
            parts.append(text[at:])
            stretches += parts if plain else map(self._normal, parts)
            owner += [i] * len(parts)
        ids, counts = self._of(pa.array(stretches, pa.string()))
        if between:
            ends = np.concatenate(([0], np.cumsum(counts)))
            ids = np.insert(ids, [ends[k] for k, _, _ in between], [x for _, x, _ in between])
        counts = np.bincount(np.array(owner + [i for _, _, i in between], np.int64), np.concatenate((counts, np.ones(len(between)))), len(texts)).astype(np.int64)
        return ids, counts

    def _of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, ends = flat(texts)
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        return self.pieces.of(low[data], ends)

    def joined(self, ids: np.ndarray, counts: np.ndarray, words: pa.Array) -> Iterator[Iterator[str]]:
        """For each text the words of its ids, joined by spaces, in stretches of at most JOINED ids."""
        ends = np.concatenate(([0], np.cumsum(counts)))
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + JOINED, "right")) - 1)
            if counts[a] > JOINED:
                yield (pc.binary_join(pa.array([pc.drop_null(words.take(pa.array(ids[k : min(k + JOINED, ends[a + 1])])))], pa.list_(pa.string())), " ")[0].as_py() for k in range(ends[a], ends[a + 1], JOINED))
            else:
                values = words.take(pa.array(ids[ends[a] : ends[b]]))
                lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), values)
                yield from ((x,) for x in pc.binary_join(lists, " ").to_pylist())
            a = b

    def decode(self, ids: list[int]) -> str:
        """The tokenizer has no decoder: its tokens, joined by spaces."""
        (text,) = self.joined(np.array(ids, np.uint32), np.array([len(ids)]), self.tokens)
        return " ".join(text)


_MADE: dict[str, WordBpe] = {}


def word_bpe(path: str, classes: np.ndarray | None = None, odd: np.ndarray | None = None) -> WordBpe:
    """One for each worker process."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path, classes, odd)
    return _MADE[path]


def encoded(df: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, full: bool = True) -> DataFrame:
    """The columns to keep (all, if not said), n_tokens (long) and either, if full, ids (array of int) and decoded
    (string) or ids_sha256 and decoded_sha256 (lowercase hex).

    The decoded text is made from the ids.  A null text counts as empty: no ids and an empty decoded text.  Repeated rows
    give equal results, an empty table an empty one; columns with the names of the results are replaced.  Texts are
    encoded whole, very long ones in stretches.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    new = "n_tokens long, ids array<int>, decoded string" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    fields = T._parse_datatype_string(new).fields
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name for f in fields}]
    source = df.select(*[quoted(c) for c in keep], *([] if text_col in keep else [quoted(text_col)]))
    at, n = source.columns.index(text_col), len(keep)
    tables = spark.sparkContext.broadcast((character_classes(), unlike_python(tokenizer_path)))  # two megabytes

    def hashed(stretches: Iterator[str]) -> str:
        sha = hashlib.sha256()
        for k, x in enumerate(stretches):
            sha.update(b" " * (k > 0) + x.encode())
        return sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path, *tables.value)
        for batch in batches:
            ids, counts = bpe.encode(batch.column(at))
            decoded = bpe.joined(ids, counts, bpe.tokens)
            if full:
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                found = [pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))), pa.array([" ".join(x) for x in decoded], pa.string())]
            else:
                found = [pa.array(list(map(hashed, x)), pa.string()) for x in (bpe.joined(ids, counts, bpe.decimal), decoded)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts), *found], [*batch.schema.names[:n], *[f.name for f in fields]])

    return mapped(source, run, T.StructType(source.schema.fields[:n] + fields))
