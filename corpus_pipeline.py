"""A corpus made ready in five stages: quality rules, language, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result to
the shared folder and reads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import langid, line_dedup, minhash, packing, quality
from meterlake.llm.common import Stored, documents, quoted, stored
from meterlake.llm.queries import tokenizer

#: A text stays if at least this corrected share of its n-grams belongs to its predicted language.
LEAST_SCORE = 0.3


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with its columns named by their places, so that no operator meets a name of its own; the names of id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.select(*[quoted(c).alias(n) for c, n in zip(docs.columns, names)]), names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def named(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in a result over numbered(docs)."""
    return out.select(*[out[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null and empty texts do, for want of words.  Repeated rows share their fate.
    Columns pass through, whatever their names; an empty table gives an empty one."""
    source, _, text = numbered(docs)
    return named(quality.judged(source, text).where("kept"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no language that could be learned, go.  The filter is
    learned from documents' labels, held-out ones aside; a prediction reads the text alone.  Repeated rows share their
    fate; columns pass through, whatever their names; an empty table gives an empty one."""
    model = langid.learn(documents(spark, sf_dir).where(~langid.held_out(F.col("doc_id"))))
    source, _, text = numbered(docs)
    found = langid.identified(source, model, text)
    return named(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated windows of three lines go from the texts; n_chars (if there) follows; no document goes.
    Null texts stay null, with no characters; rows with one id and text are one document and stay equal; columns pass
    through, whatever their names; an empty table gives an empty one."""
    source, doc_id, text = numbered(docs)
    out = named(line_dedup.drop_repeated_windows(source, doc_id, text), docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 at least are linked.  Pairs are proposed by SimHash fingerprints within two bits, as operator 5 finds
    them, and by MinHash keys, as texts at 0.8 are about ten bits apart; the whole sets of both texts decide.

    Texts without words (null ones too) are copies of each other; the least id stays, null ids last, and one of repeated
    rows.  Columns pass through, whatever their names; an empty table gives an empty one."""
    source, doc_id, text = numbered(docs)
    return named(minhash.one_of_each(source, doc_id, text, shingle=5, similarity=0.8), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 2,048 tokens.  A null or empty text is its end token alone;
    repeated rows are packed each for itself; other columns are not used; an empty table gives no piece."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the shingles, the language filter or the tokenizer; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before = len(Stored.kept)
        docs, after = stored(stage(spark, docs, sf_dir), name.replace(" ", "-")), Stored.kept[-1]
        for table in Stored.kept[before:-1]:  # what the stage stored on its way
            table.drop()
        if name != STAGES[0][0]:
            last.drop()  # its input
        last = after
    return STAGES[-1][1](spark, docs, sf_dir)
