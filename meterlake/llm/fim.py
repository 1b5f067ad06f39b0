"""Fill-in-middle by lookaround splitting, in DataFrame functions only.

A unit grammar says between which neighbouring classes of characters a unit ends.  It is translated to a regular expression
of zero width, one lookbehind and one lookahead for each such pair of classes, so that Spark's split cuts there and keeps
every character.  An empty text, which split takes for one empty piece, has no unit and is handled apart.

A text of one stretch is split once: its units and both cuts come from the same pieces.  A boundary depends on two
neighbouring characters alone, so a longer text is split in stretches, each with the character before it; what is held at a
time are the pieces of one stretch, however long the text.  Its cuts are found by splitting the two stretches that hold them
again, as far as the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, without

#: Characters of a stretch.
STRETCH = 1 << 15
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Grammar:
    """Classes of characters (each the inside of a bracket expression) and the pairs of them between which a unit ends."""

    classes: dict[str, str]
    ends: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The places between two units, as an expression of zero width.  Pairs with one left class share a lookbehind."""
        after: dict[str, list[str]] = {}
        for left, right in self.ends:
            after.setdefault(left, []).append(self.classes[right])
        union = lambda rights: "[" + "".join(f"[{x}]" for x in rights) + "]"
        return "|".join(f"(?<=[{self.classes[left]}])(?={union(rights)})" for left, rights in after.items())


_KINDS = {"letter": r"\p{L}\p{M}", "digit": r"\p{N}", "space": r"\s", "other": r"^\p{L}\p{M}\p{N}\s"}
GRAMMARS = {
    "code_point": Grammar({"any": r"\x{0}-\x{10FFFF}"}, (("any", "any"),)),
    "word": Grammar({"space": r" \t\n\x0B\f\r", "word": r"^ \t\n\x0B\f\r"}, (("space", "word"),)),  # a word and the space after it
    "line": Grammar({"feed": r"\n", "any": r"\x{0}-\x{10FFFF}"}, (("feed", "any"),)),  # a line and its line feed
    "token": Grammar(_KINDS, tuple((a, b) for a in _KINDS for b in _KINDS if a != b or a == "other")),  # runs of a kind; other characters each alone
}


def _stretches(text: Column, grammar: Grammar, stretch: int) -> Column:
    """An array with, for each stretch: where it begins (less the character before it), and the places before its end."""
    begin = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(text) - 1), F.lit(stretch))
    lead = lambda at: F.when(at > 0, at - 1).otherwise(at)
    piece = lambda at: F.substring(text, lead(at) + 1, F.lit(stretch) + at - lead(at))
    return F.transform(begin, lambda at: F.struct(lead(at).alias("at"), (F.size(F.split(piece(at), grammar.boundary(), -1)) - 1).alias("ends")))


def _place(text: Column, parts: Column, k: Column, n: Column, grammar: Grammar, stretch: int) -> Column:
    """Characters in the first k of n units: a cut inside lies in the stretch that has the k-th boundary."""
    start = F.struct(F.lit(0).alias("before"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("rest"))
    step = lambda s, p: F.when(s["at"].isNotNull(), s).when(s["before"] + p["ends"] >= k, F.struct(s["before"], p["at"], (k - s["before"]).alias("rest"))).otherwise(F.struct((s["before"] + p["ends"]).alias("before"), s["at"], s["rest"]))
    found = F.aggregate(parts, start, step)
    pieces = lambda at, rest: F.split(F.substring(text, at + 1, F.lit(stretch + 1)), grammar.boundary(), rest + 1)
    cut = lambda at, rest: at + F.char_length(F.array_join(F.slice(pieces(at, rest), F.lit(1), rest), ""))
    inside = F.transform(F.array(found), lambda s: cut(s["at"], s["rest"]))[0]  # so that the search is made once
    return F.when(k <= 0, F.lit(0)).when(k >= n, F.char_length(text)).otherwise(inside)


def _short(text: Column, draws: tuple[Column, Column], plain: Column, grammar: Grammar) -> Column:
    """n, a and b of a text of one stretch, which is split once: its units, and unless plain the characters before both cuts."""

    def measured(pieces: Column) -> Column:
        n = F.size(pieces).cast("long")
        lo, hi = (f(draws[0] % (n + 1), draws[1] % (n + 1)).cast("int") for f in (F.least, F.greatest))
        chars = lambda first, units: F.char_length(F.array_join(F.slice(pieces, first, units), ""))
        cuts = F.transform(F.array(F.struct(lo.alias("lo"), hi.alias("hi"))), lambda c: F.struct(chars(F.lit(1), c["lo"]).alias("a"), chars(c["lo"] + 1, c["hi"] - c["lo"]).alias("m")))[0]
        return F.struct(n.alias("n"), F.when(~plain, cuts).alias("cuts"))

    found = F.transform(F.array(F.split(text, grammar.boundary(), -1)), measured)[0]  # so that the pieces are made once
    return F.transform(F.array(found), lambda x: F.struct(x["n"].alias("n"), x["cuts"]["a"].alias("a"), (x["cuts"]["a"] + x["cuts"]["m"]).alias("b")))[0]


def fim_transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: Grammar = GRAMMARS["code_point"], seed: int = 1, percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), stretch: int = STRETCH) -> DataFrame:
    """df with `n` (long, units), `form`, `prefix_chars` and `middle_chars` (long, null if plain) and `output`.

    The first four groups of eight digits of sha256(seed:id) decide: two cuts among the n + 1 places between units, whether
    a text is transformed (percent of all), and which of those have the suffix first (spm_percent).  Texts that hold a
    sentinel, and empty ones, stay plain.  So the result depends on a row's id and text alone: ties and repeated rows get
    equal results.  A null text is empty; a null id counts as an empty one.  Other columns pass through, whatever their
    names; those named like a result are replaced, unless it is the id or the text, which can't be named so.  An empty
    table gives an empty one.
    """
    if {id_col.lower(), text_col.lower()} & set(RESULTS):
        raise ValueError("the id and the text can't have the name of a result")
    df = without(df, *RESULTS)
    body, digest, parts, one, lo, hi, a, b = fresh([*df.columns, *RESULTS], "body", "digest", "stretches", "one_stretch", "first_cut", "second_cut", "first_place", "second_place")
    h = lambda i: F.conv(F.substring(F.col(digest), 8 * i + 1, 8), 16, 10).cast("long")
    text, n = F.col(body), F.col("n")
    out = df.withColumn(body, F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    out = out.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))), 256))
    clash = F.lit(False)
    for s in sentinels:
        clash = clash | F.contains(text, F.lit(s))
    form = F.when((text == "") | clash | (h(2) % 100 >= percent), "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumn("form", form)
    is_plain, short = F.col("form") == "plain", F.char_length(text) <= stretch
    out = out.withColumn(one, F.when(short, _short(text, (h(0), h(1)), is_plain, grammar))).withColumn(parts, F.when(~short, _stretches(text, grammar, stretch)))
    units = F.aggregate(parts, F.lit(1).cast("long"), lambda s, p: s + p["ends"])
    out = out.withColumn("n", F.when(text == "", F.lit(0).cast("long")).otherwise(F.coalesce(F.col(one)["n"], units)))
    out = out.withColumn(lo, F.least(h(0) % (n + 1), h(1) % (n + 1)).cast("int")).withColumn(hi, F.greatest(h(0) % (n + 1), h(1) % (n + 1)).cast("int"))
    place = lambda k, known: F.when(~is_plain, F.coalesce(F.col(one)[known], _place(text, F.col(parts), F.col(k), n, grammar, stretch)))
    out = out.withColumn(a, place(lo, "a")).withColumn(b, place(hi, "b"))
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col(a)), F.substring(text, F.col(a) + 1, F.col(b) - F.col(a)), F.substring(text, F.col(b) + 1, F.char_length(text) - F.col(b))
    p, s, m = map(F.lit, sentinels)
    out = out.withColumn("prefix_chars", F.col(a).cast("long")).withColumn("middle_chars", (F.col(b) - F.col(a)).cast("long"))
    out = out.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    return out.select(*[quoted(c) for c in df.columns], *RESULTS)


def fim_restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text from an output and its form: a transformed text holds each sentinel once, so they split it into its parts."""
    split = F.split(output, "|".join("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in sentinels), -1)
    joined = lambda part: F.when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(split), joined)[0])  # so that the split is made once


def oracle() -> str:
    """The query over `documents` in DuckDB's SQL."""
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
