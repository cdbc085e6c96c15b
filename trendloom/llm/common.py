"""Shared helpers: kept tables in the cluster's shared folder, ASCII white space, text batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the ASCII white space of the word rule, as a character class.
SPACE = r"[\x20\x09-\x0D]"
#: Words of a text, by the word rule.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trendloom/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, text: str):
    """The text as a string, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def let(value, body):
    """Bind a value once for a higher-order body that reads it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values, start, step, out: str, block: int = 256):
    """Fold that gives an array of outputs: step(state, x) -> struct(state, out), out's type as given; nulls drop out.

    Outputs gather in blocks, as an array that grows by one element a step is copied as often.
    """
    none = F.array().cast(f"array<{out}>")

    def part(state, first):
        run = lambda acc, i: let(step(acc["state"], F.get(values, i)), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))
        last = F.least(F.size(values), first + block) - 1
        return F.aggregate(F.sequence(first, last), F.struct(state.alias("state"), none.alias("outs")), run)

    def add(acc, b):
        return let(part(acc["state"], b * block), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["outs"])).alias("outs")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(block)).cast("int"))
    found = F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs")), add, lambda acc: F.flatten(acc["outs"]))
    return F.when(F.size(values) > 0, F.filter(found, lambda x: x.isNotNull())).otherwise(none)


def by_bytes(sizes, most: int):
    """Cut consecutive rows into slices (start, stop) of at most so many bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
