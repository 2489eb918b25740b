"""Token counts of documents in flat token files, found by a scan for the end-of-document id.

The files hold nothing but ids of a fixed width. Blocks of them are read by
many tasks; each finds its separators with one vectorised comparison. What a
block cannot know, the last separator before it and how many there were, comes
from a prefix scan over block summaries: within runs of blocks, over the runs
of a file, and joined. So one huge file is no single task's work.

Cases: an empty document (or null text) is a separator alone and counts 0. Ids
after a file's last separator are a document that is not closed. An empty
folder gives no rows. Files whose size is no multiple of the width are refused.
A text of any length is encoded whole and written at once; repeated rows count
each. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestra.llm import token_ids
from nestra.llm.common import filesystem, put_in_place, saved, scratch

END_ID = 50256
BLOCK_BYTES = 4 << 20
#: Blocks whose summaries one window of the prefix scan takes.
RUN_BLOCKS = 1024


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Writes a flat file for each partition of (doc_id, text); returns (doc_id, file, ordinal), where each document went.

    A file gets its name when it is whole, and a task that is run again writes
    the same bytes. Markers in texts are plain text, so no text holds end_id.
    """
    vocabulary = vocabulary or token_ids.default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        draft, ordinal = f"{root}/_{name}-{task.taskAttemptId()}", 0
        end = np.array([end_id], dtype)
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                ids = batch.column(0)
                for text in batch.column(1):
                    out.write(token_ids.encode(text.as_py() or "", vocabulary, special=False).astype(dtype).tobytes())
                    out.write(end.tobytes())
                n = len(ids)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64())], ["doc_id", "file", "ordinal"])
                ordinal += n
        put_in_place(fs, draft, f"{root}/{name}")

    return saved(docs.select("doc_id", "text").mapInArrow(write, "doc_id long, file string, ordinal long"), "token-places")


def blocks_of(spark: SparkSession, folder: str, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, at, ids): the blocks of all token files in a folder; `at` and `ids` count ids, not bytes."""
    width = np.dtype(dtype).itemsize
    try:
        found = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no task wrote a file
            raise
        found = spark.createDataFrame([], "file string, length long")
    step = block_bytes // width
    odd = F.raise_error(F.concat(F.lit("not whole ids: "), "file")).cast("long")
    files = found.where("length > 0").select("file", F.when(F.col("length") % width == 0, F.expr(f"length div {width}")).otherwise(odd).alias("size"))
    blocks = files.select("file", "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("block", "at"))
    return blocks.select("file", F.col("block").cast("long").alias("block"), "at", F.least(F.lit(step), F.col("size") - F.col("at")).cast("long").alias("ids"))


def scan_blocks(blocks: DataFrame, folder: str, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """Adds `seps`, the places in the file of the separators in each block."""
    width = np.dtype(dtype).itemsize

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = filesystem(folder)
        for frame in frames:
            seps = []
            for file, at, ids in zip(frame["file"], frame["at"], frame["ids"], strict=True):
                with fs.open_input_file(f"{root}/{file}") as f:
                    data = np.frombuffer(f.read_at(int(ids) * width, int(at) * width), dtype)
                seps.append(np.flatnonzero(data == end_id) + at)
            yield frame.assign(seps=seps)

    spread = blocks.repartition(max(1, blocks.sparkSession.sparkContext.defaultParallelism * 2), "file", "block")
    return spread.mapInPandas(scan, "file string, block long, at long, ids long, seps array<long>")


def document_lengths(scanned: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """(file, ordinal, n_tokens) of each closed document, from scan_blocks()."""
    scanned = saved(scanned.withColumn("run", F.floor(F.col("block") / run_blocks)), "token-blocks")
    summary = scanned.select("file", "run", "block", F.size("seps").cast("long").alias("n"), F.array_max("seps").alias("last"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_run = summary.select("file", "run", "block", F.sum("n").over(before).alias("n_in"), F.max("last").over(before).alias("last_in"))
    runs = summary.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.sum("n").over(earlier).alias("n_before"), F.max("last").over(earlier).alias("last_before"))
    carried = in_run.join(runs, ["file", "run"]).select(
        "file", "block", (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_before", F.lit(0))).alias("base"), F.coalesce("last_in", "last_before", F.lit(-1)).alias("carry")
    )
    stitched = scanned.where(F.size("seps") > 0).join(carried, ["file", "block"])
    starts = F.concat(F.array("carry"), F.slice("seps", 1, F.size("seps") - 1))
    each = stitched.select("file", "base", F.posexplode(F.arrays_zip(F.col("seps").alias("sep"), starts.alias("start"))).alias("i", "x"))
    return each.select("file", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("x.sep") - F.col("x.start") - 1).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens) of (doc_id, text), by way of token files in the shared folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-files")
    places = write_token_files(docs, folder, vocabulary, end_id)
    lengths = document_lengths(scan_blocks(blocks_of(spark, folder), folder, end_id))
    return places.join(lengths, ["file", "ordinal"]).select("doc_id", "n_tokens")
