"""Shared plumbing of the training-data operators.

Every operator here takes and returns DataFrames and keeps three habits:

* a text operator reads only the columns it was told to read, through
  :func:`map_texts`, so extra input columns - whatever they are called - cannot
  clash with its own;
* lineage is cut with ``checkpoint()`` in the folder the session names in
  ``spark.checkpoint.dir``; :func:`ensure_checkpoint_dir` sets one only where
  the session has none (a local test session);
* a side is broadcast only after its size was checked against a bound.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none it must be a local one, and a temporary folder
    is set; on a cluster without the setting this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessella-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` usable; see :func:`shared_dir`."""
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_bucket(id_col: str | Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string").cast("binary")) % F.lit(buckets)


#: Rows and bytes of one Arrow batch of texts.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lowers the session's Arrow batches to ``rows`` rows and ``size`` bytes.

    Spark reads both settings when a plan is prepared, so they stay lowered; a
    session that has smaller ones keeps them.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """All of ``rows`` if they are at most ``most``, else those whose ``key`` hashes low, at most about ``most``.

    The same rows whatever their order; chosen by a threshold on the hash, without a sort.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = (most - 3 * most**0.5) / n
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


def map_texts(
    docs: DataFrame,
    carry: list[str],
    text_col: str,
    result: T.StructType,
    make: Callable[[], Callable[[list], list[pa.Array]]],
) -> DataFrame:
    """Adds columns computed in Python from one text column.

    ``make()`` runs once for each task and returns a function from a list of
    texts (null given as the empty text) to one Arrow array for each field of
    ``result``. Columns named in ``carry`` pass through untouched inside a
    struct, so their names never meet those of ``result``. The output has the
    columns ``row`` (struct of ``carry``) and ``res`` (struct of ``result``).
    A text that is carried is sent to Python once, inside ``row``.
    """
    packed, texts_of = pack_texts(docs, carry, text_col)
    schema = T.StructType(
        [T.StructField("row", packed.schema["row"].dataType), T.StructField("res", result)]
    )
    names = result.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                arrays = work(texts_of(batch))
                res = pa.StructArray.from_arrays(arrays, names=names)
                yield pa.RecordBatch.from_arrays([batch.column(0), res], names=["row", "res"])

    return packed.mapInArrow(run, schema)


def pack_texts(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[str]]]:
    """``docs`` as ``row`` (struct of ``carry``) and, unless it is in there, ``text``; and how to take a batch's texts.

    Bounds the session's Arrow batches. A null text is taken as the empty one.
    """
    bound_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    if text_col in carry and dict(docs.dtypes)[text_col] == "string":
        place = carry.index(text_col)
        return docs.select(row), lambda batch: [t or "" for t in batch.column(0).field(place).to_pylist()]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    return docs.select(row, text), lambda batch: batch.column(1).to_pylist()


def join_unique(
    left: DataFrame, right: DataFrame, key: str, weight: str, total: int, keep: list[str]
) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose ``key`` is unique, for a skewed ``key``.

    ``weight`` in ``right`` counts the rows of ``left`` that have the key. At most
    1,000 keys can each hold over a thousandth of the ``total`` rows; those - and
    nothing else - are broadcast, so the shuffled rest has no hot key.
    """
    bar = max(1000, total // 1000)
    right = right.select(key, weight, *keep)
    hot = right.filter(F.col(weight) > bar).drop(weight)
    cold = right.filter(F.col(weight) <= bar).drop(weight)
    far = left.join(F.broadcast(hot), key, "inner")
    near = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return far.unionByName(near)
