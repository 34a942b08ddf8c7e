"""Event streams: classification, debouncing, windows.

Windows with watermarks are an extension over the event table; the functions work
on a stream and on a batch alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Our mapping of the test table's events to file events.
FILE_EVENTS = {"signup": "file-added", "click": "file-modified", "view": "file-modified", "error": "file-removed", "purchase": "configuration-changed"}


def classify(event_type: Column | str) -> Column:
    """File event of a raw event type."""
    c = F.col(event_type) if isinstance(event_type, str) else event_type
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILE_EVENTS.items() for x in kv]), c), F.lit("unknown"))


def classify_path_event(raw: str, path: str, manifests: list[str], configs: list[str]) -> Column:
    """Class of a watch event: of a package manifest, of configuration, of a file or a directory."""
    kind = F.col(raw)
    package = F.when(kind.isin("unlink", "unlinkDir"), "package-removed").when(kind.isin("add", "addDir"), "package-added").otherwise("package-modified")
    plain = (
        F.when(kind == "add", "file-added").when(kind == "change", "file-modified").when(kind == "unlink", "file-removed")
        .when(kind == "addDir", "directory-added").when(kind == "unlinkDir", "directory-removed")
    )
    return F.when(F.col(path).isin(*manifests), package).when(F.col(path).isin(*configs), "configuration-changed").otherwise(plain)


def read_events(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def debounce(events: DataFrame, key: str, ts: str, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key with no pause longer than ``gap``: start, end, number of events."""
    w = F.session_window(ts, gap).alias("w")
    found = events.withWatermark(ts, late).groupBy(key, w).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; later than the watermark they are dropped."""
    w = F.window(ts, size, slide or size).alias("w")
    found = events.withWatermark(ts, late).groupBy(w, kind).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), kind, "n")


def write_changes(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a classified stream to Parquet; what is there is processed once, then the query ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()
