"""Helpers shared by the corpus operators: word rule, tables, shared storage, seeded splits."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
ROWS = 2000
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: Column) -> Column:
    """Words of a text, counted in the JVM."""
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share.

    Where it is unset, a session on one machine gets a folder of its own, that goes with the process; a cluster gets an error.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="faturaflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application's operators have written, once their results are no longer needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(spark: SparkSession) -> None:
    """Rows of whole texts reach Python in batches of ROWS, unless the session asks for fewer still."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives a lost executor.

    A small table, with ids and numbers only, goes to a quarter of the session's partitions: fewer files.
    """
    if small:
        df = df.coalesce(max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of docs has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, as a lambda's variable, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
