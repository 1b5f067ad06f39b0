"""What the operators of this package share: shared folders, stored tables, Arrow batches, fresh column names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SEPARATORS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


class Stored:
    """A table written to the shared folder and read again, which cuts the lineage and survives lost executors."""

    #: Tables that were not dropped yet, oldest first.
    kept: list[Stored] = []

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        self.kept.append(self)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.kept.remove(self)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def drop_stored(before: int | None = None) -> None:
    """Drops the tables that operators have stored (the first ones, up to a place in Stored.kept): for a caller that has
    saved the results which read them."""
    for table in Stored.kept[:before]:
        table.drop()


def arrow_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, by rows and by bytes, so that long texts don't add up.  The bounds are the
    session's, and the same for every operator, as plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, dots and clashes included: batches know them by their places."""
    import pyarrow as pa

    places = lambda n: [f"c{i}" for i in range(n)]
    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(places(len(schema)), schema)])

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, places(batch.num_columns))

    return df.toDF(*places(len(df.columns))).mapInArrow(renamed, plain).toDF(*schema.names)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until none of them is taken (case aside)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add under these names (case aside)."""
    gone = {x.lower() for x in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def residue(column, modulus: int):
    """crc32 of a value written as text, modulo a number; null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus
