"""Helpers shared by the corpus operators: Arrow row mapping and scratch tables.

Scratch tables cut lineage: they are Parquet tables in the folder that the session's
``spark.checkpoint.dir`` names, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python worker turns into objects at once; bounds its memory whatever Arrow's batch holds.
SLICE_ROWS = 256
#: Scratch tables made so far, each with the scope that it was made in.
_MADE: list[tuple[str, str]] = []
_SCOPE = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) only, so that no other column can clash or cost a read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. On one machine a folder of its own does where none is set, as in tests; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="townwire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a scratch folder, which belongs to the scope of the moment."""
    path = f"{scratch_root(spark)}/townwire/{name}-{uuid.uuid4().hex}"
    _MADE.append((_SCOPE, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to this scope."""
    global _SCOPE
    before, _SCOPE = _SCOPE, name
    try:
        yield
    finally:
        _SCOPE = before


def release(spark: SparkSession, scopes: Iterable[str], still_read: DataFrame) -> None:
    """Delete the scratch tables of these scopes, except those that still_read's plan reads."""
    scopes = set(scopes)
    doomed = [x for x in _MADE if x[0] in scopes]
    used = still_read.inputFiles() if doomed else []
    for scope_, path in doomed:
        tail = path.rsplit("/townwire/", 1)[1]
        if not any(f"/townwire/{tail}/" in x for x in used):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            _MADE.remove((scope_, path))


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables that are made inside, for callers that have read or written their results by the end."""
    before = len(_MADE)
    try:
        yield
    finally:
        for scope_, path in _MADE[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _MADE[before:]


#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than this.
HOT_SHARE = 2_000


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with a table of one row per key, whose column n adds up to total at most.

    Hot keys are broadcast (fewer than HOT_SHARE rows, by their counts), so their rows stay
    where they are; all others are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(counted.filter(F.col(n) > total / HOT_SHARE))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(counted.filter(F.col(n) <= total / HOT_SHARE), keys))


def map_slices(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow over small slices: fn takes an iterator of {column: list} and yields {column: list or array}."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict]:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(i, SLICE_ROWS)
                    yield {name: _column(part.column(k)) for k, name in enumerate(part.schema.names)}

        for out in fn(slices()):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, arrow.field(k).type) for k, x in ((k, out[f.name]) for k, f in enumerate(arrow))], schema=arrow)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, inputs: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """df with further columns that fn computes from the inputs of a small slice; all of df's columns pass through as they are."""
    added = StructType.fromDDL(schema)
    arrow = to_arrow_schema(added)
    whole = StructType([*df.schema.fields, *added.fields])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                out = fn({c: part.column(names.index(c)).to_pylist() for c in inputs})
                new = [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *arrow.names])

    return df.mapInArrow(run, whole)


def with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The documents' own columns with this column as their text, and n_chars to match where there is one."""
    new = {"text": F.col(text)} | ({"n_chars": F.char_length(F.col(text)).cast(df.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def _column(array: pa.Array):
    """Python objects for strings and lists; numpy for numbers without nulls."""
    if pa.types.is_integer(array.type) and not array.null_count:
        return array.to_numpy(zero_copy_only=False)
    return array.to_pylist()
