"""Chat formatting that survives a round trip through its own grammar.

A conversation is rendered as turns `### Role: text`, a line feed and `</turn>` on a line of its own.  The rendering is
parsed again by a deterministic parser and compared with its source; turns that don't come back are escaped, and this is
repeated until the parse is identical.  Escaping puts one more backslash before every control string (with the
backslashes already there); the parser takes one away, so any text comes back.

    conversation = { "### " role ": " text "\\n</turn>\\n" }
    text         = anything in which ### and </turn> have a backslash before them
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, fresh, mapped, quoted

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = {v: k for k, v in ROLES.items()}
OPEN, CLOSE = "### ", "\n</turn>\n"
_CONTROL = re.compile(r"\\?(?:###|</turn>)")  # with one backslash at most, so that runs of them are read once
RESULTS = ("n_turns", "formatted", "loss_spans")
_ROLE = re.compile(r"([A-Za-z]+|=[^: \n]*): ")


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)  # it makes no difference before which of its backslashes


def unescaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0].removeprefix("\\"), text)


def role_name(role: str | None) -> str:
    return ROLES.get(role or "", "=" + quote(role or "", safe=""))


def render(turns: list[tuple[str, str]], escape: set[int]) -> str:
    return "".join(f"{OPEN}{role_name(role)}: {escaped(text) if i in escape else text}{CLOSE}" for i, (role, text) in enumerate(turns))


def parse(formatted: str) -> list[tuple[str, int, int]] | None:
    """Role, begin and end of the text of each turn; None if it doesn't follow the grammar."""
    out, at, n = [], 0, len(formatted)
    while at < n:
        if not formatted.startswith(OPEN, at) or not (m := _ROLE.match(formatted, at + len(OPEN))):
            return None
        begin = m.end()
        for c in _CONTROL.finditer(formatted, begin):
            if formatted[c.start()] != "\\":
                break
        else:
            return None
        end = c.start() - 1
        if end < begin or not formatted.startswith(CLOSE, end):
            return None
        name = m[1]
        if not name.startswith("=") and name not in _NAMES:
            return None
        out.append((unquote(name[1:]) if name.startswith("=") else _NAMES[name], begin, end))
        at = end + len(CLOSE)
    return out


def read_back(formatted: str) -> list[tuple[str, str]] | None:
    spans = parse(formatted)
    return None if spans is None else [(role, unescaped(formatted[a:b])) for role, a, b in spans]


def formatted(turns: list[tuple[str, str]]) -> str:
    """The rendering whose parse is the source; first nothing is escaped, then the turns that don't come back alone, then all."""
    for escape in (set(), {i for i, t in enumerate(turns) if read_back(render([t], set())) != [t]}, set(range(len(turns)))):
        out = render(turns, escape)
        if read_back(out) == turns:
            return out
    raise AssertionError("the grammar lost a turn")


def chat_format(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """A row per conversation: the id, n_turns (long), formatted (string) and loss_spans (array of begin and end, in code
    points of formatted, of the texts of the learned role as they stand there).

    Turns are in order of turn, role and text, nulls first, so ties and repeated rows have one order; a null role or
    text is empty; a row with a null id is a conversation of its own; an empty table gives an empty table; other columns
    are not used; an id column with the name of a result has underscores put before it.  A conversation is one value of
    the result and is gathered as one; texts of any length and content are escaped and parsed in time linear in them.
    """
    arrow_batches(df.sparkSession)
    name = fresh(RESULTS, id_col)[0]
    alone = F.when(quoted(id_col).isNull(), F.monotonically_increasing_id())
    turns = df.select(quoted(id_col).alias("id"), alone.alias("alone"), F.struct(quoted(turn_col).alias("turn"), quoted(role_col).alias("role"), quoted(text_col).alias("text")).alias("t"))
    whole = turns.groupBy("id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("id", "turns")
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, loss = [], []
            for turns in batch.column(1).to_pylist():
                texts.append(formatted([(t["role"] or "", t["text"] or "") for t in turns]))
                loss.append([{"begin": a, "end": b} for role, a, b in parse(texts[-1]) if role == learned])
            counts = pa.array([len(x) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(texts, pa.string()), pa.array(loss, kind)], ["id", "n_turns", "formatted", "loss_spans"])

    return whole.mapInArrow(run, schema).withColumnRenamed("id", name)


def chat_digest(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What comes back from chat_format's output: turns_sha256, loss_chars, loss_sha256, formatted_chars for each id."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    fields = T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields
    source = df.select(quoted(id_col), "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                loss = "".join(unescaped(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            arrays = [pa.array(x, pa.string() if f.name.endswith("sha256") else pa.int64()) for x, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *[f.name for f in fields]])

    return mapped(source, run, T.StructType([df.schema[id_col], *fields]))
