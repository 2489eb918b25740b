"""Streams that replay what is there and then follow: drained into tables, resumed, routed, counted.

A subscriber is a streaming query with a checkpoint of its own: it sees each row
once, a stopped one goes on where it was, and several do not disturb each other.
How many files a batch admits bounds what is in flight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from nestra.plans.catalog import later_wins
from nestra.sources.shared import numbered, scratch


def drain(rows: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream has by now, appended to the table at path.

    With the path and checkpoint of an earlier call, only rows since then are read. An empty stream gives an empty table.
    """
    spark = rows.sparkSession
    path, checkpoint = path or scratch(spark, "drained"), checkpoint or scratch(spark, "drained-at")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def _batches(spark, base: str, schema) -> DataFrame:
    """What foreachBatch wrote under base/batch=N, with the column `batch`; empty if there was no batch yet."""
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _run(rows: DataFrame, mode: str, keep: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def latest(totals: DataFrame, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """A streaming aggregate as it stands after all rows that the stream has by now, with one row for each key.

    Each batch writes the rows that it changes under its number, so a batch that
    runs again after a failure replaces its own; the last one of a key counts.
    What was written stays beside the checkpoint, so a resumed stream without new
    rows gives the same answer.
    """
    spark = totals.sparkSession
    checkpoint = (checkpoint or scratch(spark, "totals-at")).rstrip("/")
    base = f"{checkpoint}-totals"
    _run(totals, "update", lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/batch={number}"), checkpoint)
    return later_wins(_batches(spark, base, totals.schema), keys, "batch").select(totals.columns)


def with_ids(rows: DataFrame, order: list[str], name: str = "message_id", checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream has by now with ids from 0 without gaps, in the order of batches and of the columns in each."""
    spark = rows.sparkSession
    checkpoint = (checkpoint or scratch(spark, "ids-at")).rstrip("/")
    base = f"{checkpoint}-ids"
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def keep(batch: DataFrame, number: int) -> None:
        earlier = _batches(batch.sparkSession, base, schema).where(F.col("batch") < number)
        start = earlier.agg(F.coalesce(F.max(name) + 1, F.lit(0))).first()[0]
        made = numbered(batch, "__at", order).withColumn(name, F.col("__at") + start).drop("__at")
        made.write.mode("overwrite").parquet(f"{base}/batch={number}")

    _run(rows, "append", keep, checkpoint)
    return _batches(spark, base, schema).drop("batch")


class Overflow(Exception):
    """A batch had more rows than its queue may hold."""


def bounded(rows: DataFrame, most: int, path: str, checkpoint: str) -> DataFrame:
    """drain() that fails, and keeps nothing of the batch, where one batch has more than `most` rows."""
    spark = rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        if batch.limit(most + 1).count() > most:
            raise Overflow(f"more than {most} rows in batch {number}")
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(rows, "append", keep, checkpoint)
    return _batches(spark, path, rows.schema).drop("batch")


def subscribe(rows: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """A running query that hands each batch of what comes to update(batch, number), once in `every`; stop() ends it, a new one with its checkpoint goes on."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(update).start()


class Metrics(StreamingQueryListener):
    """What happened to each query, by its name or id: starts, batches, rows, errors. Add it with spark.streams.addListener()."""

    def __init__(self):
        self.queries: dict[str, dict] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self._of(event.id)["starts"] += 1

    def onQueryProgress(self, event) -> None:
        own = self._of(event.progress.id)
        own["batches"] += 1
        own["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._of(event.id)["errors"] += event.exception is not None

    def _of(self, query_id) -> dict:
        return self.queries.setdefault(self._names.get(str(query_id), str(query_id)), {"starts": 0, "batches": 0, "rows": 0, "errors": 0})


def handled(spark: SparkSession, name: str, schema: str, size: Callable[[], int], rows: Callable[[int, int], Iterator[tuple]], parts: int = 8) -> DataFrame:
    """A stream from a handler: size() says how many rows there are by now, rows(start, end) yields those of a range, in any executor and again if need be."""

    class Range(InputPartition):
        def __init__(self, start: int, end: int):
            self.start, self.end = start, end

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def latestOffset(self) -> dict:
            return {"at": size()}

        def partitions(self, start: dict, end: dict) -> list:
            step = max(1, -(-(end["at"] - start["at"]) // parts))
            return [Range(at, min(end["at"], at + step)) for at in range(start["at"], end["at"], step)]

        def read(self, partition) -> Iterator[tuple]:
            yield from rows(partition.start, partition.end)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def call_totals(calls: DataFrame, method: str, value: str, failed_over: float) -> DataFrame:
    """(method, calls, errors, min_ms, max_ms) of a stream of calls; what a state holds grows with methods, not with calls."""
    v = F.col(value)
    return calls.groupBy(F.col(method).alias("method")).agg(F.count("*").alias("calls"), F.count_if(v > failed_over).alias("errors"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"))


def windowed(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """(begin, key, n): rows for each key and window of event time; in latest(), state of windows older than `late` goes, and rows later than that are left out."""
    seen = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    return seen.groupBy(F.window("__at", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), key, "n")


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The stream without rows whose key was there before, as far back as `late`: redelivered messages count once."""
    return events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")
