"""What the text operators share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidelog.llm
from tidelog.session import shared_folder

# Tasks get the functions of this package with the job: executors need not have it on their path.
cloudpickle.register_pickle_by_value(tidelog.llm)

_ROWS_PER_TASK = 200_000
_ROWS_AT_A_TIME = 256
_BATCH_BYTES = 4 << 20
_SCRATCH: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, rows: int | None = None, compression: str = "none") -> DataFrame:
    """``df``, written as a table in the shared folder and read from there from now on.

    It is computed once, whatever uses it, and lost executors cost no more than the tasks they ran. Unlike
    a checkpointed frame, a table has a known size: Spark need not guess it from the whole history of
    the frame, a guess that is squared in every round of a loop and soon takes minutes.
    ``rows``, if known, says about how many narrow rows there are: they are written by as many tasks as that
    takes, not by one for every shuffle partition. The tables stay until :func:`clear_scratch`, as results may still read them.
    """
    spark = df.sparkSession
    folders = _SCRATCH.setdefault(spark.sparkContext.applicationId, [])
    folders.append(shared_folder(spark, "llm"))
    if rows is not None:
        df = df.coalesce(1 + rows // _ROWS_PER_TASK)
    # Mostly without compression: its buffers lie outside the heap and stay until the executor collects garbage.
    df.write.option("compression", compression).parquet(folders[-1])
    return spark.read.schema(df.schema).parquet(folders[-1])


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables :func:`settled` has written in this session. Results that read them are void."""
    for folder in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    except Exception:  # a Spark that bounds batches by rows alone
        return
    if not 0 < given <= _BATCH_BYTES:
        spark.conf.set(name, str(_BATCH_BYTES))


def _give_back() -> None:
    """Return free memory of this worker to the system, as far as its allocators know how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply a function to every Arrow batch, a few rows at a time, so that what a task holds as Python objects
    stays small. ``start`` makes the function once per task, with what it needs to load. Workers live on after a task, so
    what it held is given back to the system. A batch has some _BATCH_BYTES, or one row: Spark's setting for that is
    lowered to it in the session, if it is higher."""
    _small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = start()
        try:
            for batch in batches:
                for start_row in range(0, batch.num_rows, _ROWS_AT_A_TIME):
                    yield apply(batch.slice(start_row, _ROWS_AT_A_TIME))
        finally:
            del apply
            _give_back()

    return df.mapInArrow(run, schema)


def map_texts(
    df: DataFrame,
    start: Callable[[], Callable[[list], dict[str, pa.Array]]],
    made: str,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with columns made of the texts: ``start`` gives a function from a batch's texts to arrays.

    Columns named in ``keep`` are passed on as they are, whatever their type and name; a made column replaces
    one of the same name.
    """
    names = [n.split()[0] for n in made.split(", ")]
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]

    def begin():
        apply = start()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            arrays = apply(batch.column(0).to_pylist())
            return pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[arrays[n] for n in names]], names=[*[f"_{i}" for i in range(len(passed))], *names]
            )

        return run

    kinds = [df.schema[c].dataType.simpleString() for c in passed]
    schema = ", ".join([*[f"_{i} {kind}" for i, kind in enumerate(kinds)], made])
    rows = df.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(passed)])
    out = map_batches(rows, begin, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(passed)], *names)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves no rest."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))

