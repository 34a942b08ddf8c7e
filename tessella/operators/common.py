"""Helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, set in its context; a temporary one in a local session without any."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessella-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, its lineage cut.

    Where rounds join what earlier rounds left, this and not :func:`cut`: a checkpoint
    keeps the estimated size of its plan, which every join multiplies, until the number
    alone fills the driver; a table has the size of its files.
    """
    path = f"{_shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parts:
    """A table in the shared folder that grows by a part a round; the parts before are not written again."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as the next part and gives that part."""
        self.paths.append(f"{_shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}")
        df.write.parquet(self.paths[-1])
        self.reader = df.sparkSession.read.schema(df.schema)
        return self.reader.parquet(self.paths[-1])

    def all(self) -> DataFrame:
        """All parts."""
        return self.reader.parquet(*self.paths)


#: Rows and bytes of one Arrow batch where rows hold lists.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, so that the lists a Python worker holds do not grow with the table.

    Spark reads both settings when a plan is prepared, so they stay lowered; smaller ones are kept.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def spread(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sorting and merging and never broadcast.

    Sizes of compressed files and of checkpoints are estimates far below the rows'
    size, by which Spark would send a table that grows with the input through the
    driver, in every round anew.
    """
    return df.hint("merge")
