"""What the operators share: tables, the shared folder, Arrow batches and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step handles; a longer text is a step of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none and all run in one process, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_WORKSPACE: ContextVar[str | None] = ContextVar("workspace", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{_WORKSPACE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A folder for the tables that are saved within; it goes at the end. Yields saved() for those that stay."""
    own = _WORKSPACE.set(scratch(spark, "work"))
    folder = _WORKSPACE.get()

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _WORKSPACE.set(folder.rpartition("/")[0])
        try:
            return saved(df, name)
        finally:
            _WORKSPACE.reset(inner)

    try:
        yield keep
    finally:
        _WORKSPACE.reset(own)
        fs, root = filesystem(folder)
        if fs.get_file_info(root).type.name == "Directory":
            fs.delete_dir(root)


#: Spark's setting by which a finished query gives back its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and any executor can read it.

    Its shuffle files are given back at once, as nothing reads them again, and what the driver freed for it.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    trimmed(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession) -> None:
    """Has the driver collect what finished queries left, before its heap grows for that; their broadcasts go on executors too."""
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> None:
    """Has the driver's JVM give back memory that it freed outside of its heap, as its compiler does with each new plan.

    The C library keeps such memory for each of some hundred threads. A JVM without the command (before 17.0.9, or not on Linux) keeps it.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kinds, given = array(jvm.Class, 4), array(jvm.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.Class.forName(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # By the interface's method, as the server's own class is not open to others.
    invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError as error:
        if "javax.management.ReflectionException" not in str(error) and "InstanceNotFoundException" not in str(error):
            raise


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_in_place(fs, draft: str, path: str) -> None:
    """Gives a whole file its name. A task that runs again finds it there, with the same bytes, and leaves it."""
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type == FileType.NotFound:
        try:
            fs.move(draft, path)
            return
        except OSError:  # another run of the task was faster
            if fs.get_file_info(path).type == FileType.NotFound:
                raise
    fs.delete_file(draft)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows, so that the column `text` has about `limit` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1]
        start = 0
        while start < len(text):
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(len(text), max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of each); a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
#: A-Z to a-z; every other byte as it is.
LOWER = IDENTITY.copy()
LOWER[65:91] += 32

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        out = np.ones(size, np.uint64)
        filled = 1
        while filled < size:  # doubling: each half is the one before it times a power
            out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        have = _POWERS[base] = out
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space and ASCII punctuation.
MARKS = SPACE.copy()
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def byte_codes(fold: np.ndarray, seed: int, between: np.ndarray) -> np.ndarray:
    """A 64-bit code for each byte after folding; what stands between words counts nothing."""
    codes = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))[fold]
    codes[between] = 0
    return codes


_CODES: dict = {}


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a chunk of texts, found and hashed at once.

    marks: punctuation also stands between words. starts, ends: byte positions; first: index of each text's first word, with
    the number of all words at the end; hashes: 64 bits of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, marks: bool = False, seed: int = 1):
        n = len(data)
        self.data, self.offsets = data, offsets
        between = MARKS if marks else SPACE
        space = between[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets[:-1]] = True
        begins[n] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | begins[:n]))
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.ends = np.flatnonzero(~space & (after | begins[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        if len(self.starts):
            key = (lower, marks, seed)
            if key not in _CODES:
                _CODES[key] = byte_codes(LOWER if lower else IDENTITY, seed, between)
            values = _CODES[key][data]
            values *= powers(_BASE, n)
            sums = np.add.reduceat(values, self.starts)
            self.hashes = mix(sums * powers(inverse(_BASE), n)[self.starts])
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int, base: int = 0xA0761D6478BD642F | 1) -> np.ndarray:
        """Hash of the k words from each position on; those that leave their text are not valid (see inside())."""
        h = self.hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * powers(base, len(h)), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(inverse(base), n))

    def inside(self, k: int) -> np.ndarray:
        """Positions from which k words stay in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return np.flatnonzero(text[:n] == text[k - 1 :])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
