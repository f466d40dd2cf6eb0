"""What the operators share: the folder for written tables, scans and joins that survive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A class of more rows than this is spread over several salts when it is joined to its members.
ROWS_PER_SALT = 50_000
#: At most so many of the largest classes are salted, so that the table of hot keys has a fixed bound.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written meanwhile goes to Python in Arrow batches of about so many bytes, or one row; a limit that the session has set stands.

    By default a batch ends at 10,000 rows only, however long they are; the executor holds it outside its heap and the
    Python worker a second time.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is not None:
        yield
        return
    spark.conf.set(limit, str(most))
    try:
        yield
    finally:
        spark.conf.unset(limit)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def boxed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed c0, c1, ..., which no column of an operator is named, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unboxed(df: DataFrame, names: dict[str, str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of boxed docs under their old names; ``changed`` has those with new values."""
    return df.select(*((changed or {}).get(c, F.col(box)).alias(c) for c, box in names.items()))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of few rows, so that long texts are not all Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def scan(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 1024) -> DataFrame:
    """Apply make()'s function to slices of df within its own partitions. make runs once a task, on the executor."""

    def run(batches):
        each = make()
        for batch in slices(batches, rows):
            yield each(batch)

    return df.mapInArrow(run, schema)


def attach(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined (left) to the one row of classes with the same key, where a class may hold a large part of all rows.

    size names the column of classes with the number of its rows. The HOT_KEYS largest classes at most are salted, by
    copying the row of the class; any class beyond those holds under 1/HOT_KEYS of all rows.
    """
    hot = classes.select(F.col(key).alias("_hot"), F.ceil(F.col(size) / ROWS_PER_SALT).cast("int").alias("_salts"), F.col(size).alias("_size"))
    hot = F.broadcast(hot.where("_salts > 1").orderBy(F.desc("_size"), "_hot").limit(HOT_KEYS).select("_hot", "_salts"))
    others = [c for c in rows.columns if c != key]
    spread = rows.join(hot, rows[key] == hot["_hot"], "left").withColumn("_salt", F.expr("int(pmod(xxhash64(" + ", ".join(f"`{c}`" for c in others) + "), coalesce(_salts, 1)))")).drop("_hot", "_salts")
    copies = classes.join(hot, classes[key] == hot["_hot"], "left").withColumn("_salt", F.explode(F.expr("sequence(0, coalesce(_salts, 1) - 1)"))).drop("_hot", "_salts")
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def power_of_two(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))
