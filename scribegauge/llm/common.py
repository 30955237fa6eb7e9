"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Names that start so are the operators' own; input columns of these names are dropped.
OWN = "__sg_"
_local: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="scribegauge-"))
    return _local[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what written() wrote, once all that is made of it is itself written: nothing may read these tables again."""
    for table in tables:
        if (path := _paths.pop(table, None)) is not None:
            spark = table.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names or of the operators' own, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone and not c.lower().startswith(OWN)])


def rows_kept(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], *needed: str) -> DataFrame:
    """The rows that keep() leaves of docs, with docs' own columns. Those that it doesn't need are renamed on the way, so
    that none of its outputs replaces one of the same name."""
    names = {n.lower() for n in needed}
    aside = {c: c if c.lower() in names else f"in_{i}" for i, c in enumerate(docs.columns)}
    kept = keep(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in aside.items()]))
    return kept.select(*[F.col(f"`{a}`").alias(c) for c, a in aside.items()])


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n.lower() not in {c.lower() for c in df.columns}]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of(id_column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; a null id counts as empty text (0)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_python(df: DataFrame, text_column: str, compute: Callable[[list[str | None]], dict[str, Any]], fields: list[StructField], keep_text: bool = True) -> DataFrame:
    """df plus fields that compute() makes from a batch of texts (null where the text is null). Other columns pass
    through as Arrow data, untouched. With keep_text false the text column itself is left out of the result."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    as_text = df.schema[text_column].dataType == StringType()
    rows = df if as_text else df.withColumn("__sg_text", F.col(text_column).cast("string"))
    source = text_column if as_text else "__sg_text"
    kept = [f for f in df.schema.fields if keep_text or f.name != text_column]
    names, schema = [f.name for f in kept], StructType([*kept, *fields])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(StructType(fields))
        for batch in batches:
            made = compute(batch.column(source).to_pylist())
            columns = [batch.column(n) for n in names] + [pa.array(made[f.name], t.type, from_pandas=True) for f, t in zip(fields, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f.name for f in fields)])

    return rows.mapInArrow(mapped, schema)
