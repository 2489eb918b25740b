"""Length-prefixed frames in binary columns and files: joined, split, filtered by kind, validated; typed JSON; gzip texts.

A frame is a little-endian 32-bit length and so many bytes. Splitting walks from
one length to the next, which no column function does, so it runs over Arrow
batches; everything else is column functions.

Cases: a null column gives null; no bytes are no frames. A batch that ends
within a length or a frame gives the frames before it and an error.
"""

from __future__ import annotations

import base64
import gzip
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

# Kinds of messages that a client does not send on, and where in a frame its kind stands.
FINISH, RELEASE = 4, 6
KIND_AT = 16


def u32(data: Column, at: int) -> Column:
    """The little-endian 32-bit number at a byte; null beyond the end."""
    four = F.hex(F.substring(data, at + 1, 4))
    turned = F.concat(*[F.substring(four, 7 - 2 * i, 2) for i in range(4)])
    return F.when(F.length(four) == 8, F.conv(turned, 16, 10).cast("long"))


def u16(data: Column, at: int) -> Column:
    two = F.hex(F.substring(data, at + 1, 2))
    return F.when(F.length(two) == 4, F.conv(F.concat(F.substring(two, 3, 2), F.substring(two, 1, 2)), 16, 10).cast("int"))


def prefixed(frame: Column) -> Column:
    """A frame with its length before it."""
    size = F.lpad(F.hex(F.octet_length(frame).cast("long")), 8, "0")
    return F.concat(F.unhex(F.concat(*[F.substring(size, 7 - 2 * i, 2) for i in range(4)])), frame)


def joined(frames: Column) -> Column:
    """All frames of an array<binary> as one batch."""
    return F.unhex(F.array_join(F.transform(frames, lambda x: F.hex(prefixed(x))), ""))


def _split(batch: pd.Series) -> pd.DataFrame:
    frames, errors = [], []
    for data in batch:
        own, at, error = [], 0, None
        while data is not None and at < len(data):
            if at + 4 > len(data):
                error = "truncated length prefix"
                break
            size = int.from_bytes(data[at : at + 4], "little")
            if at + 4 + size > len(data):
                error = "truncated frame"
                break
            own.append(bytes(data[at + 4 : at + 4 + size]))
            at += 4 + size
        frames.append(None if data is None else own)
        errors.append(error)
    return pd.DataFrame({"frames": frames, "error": errors})


def exploded_frames(df: DataFrame, batch: str, strict: bool = False) -> DataFrame:
    """A row (.., place, frame, error) for each frame of the batches in a column; strict: a damaged batch is an error of the query."""
    rest = [c for c in df.columns if c != batch]
    made = df.withColumn("__x", split(batch))
    error = F.col("__x.error")
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    return made.select(*rest, error.alias("error"), F.posexplode_outer("__x.frames").alias("place", "frame"))


def without_kinds(frames: Column, kinds: tuple[int, ...] = (FINISH, RELEASE)) -> Column:
    """The frames whose kind is none of these; null if none is left. A frame too short for a kind has none."""
    kept = F.filter(frames, lambda x: ~F.coalesce(u16(x, KIND_AT).isin(*kinds), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def framing_code(message: Column) -> Column:
    """0: one whole segment; 1: under 8 bytes; 2: no multiple of 8; 3: several segments; 4: the stated size is not the rest."""
    size = F.octet_length(message)
    return (
        F.when(size < 8, 1).when(size % 8 != 0, 2).when(u32(message, 0) != 0, 3).when(u32(message, 4) != (size - 8) / 8, 4).when(message.isNotNull(), 0)
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, frame, error) of files that hold a batch each."""
    return exploded_frames(spark.read.format("binaryFile").load(path).select("path", "content"), "content")


def _decoded(value) -> tuple[str, str | None]:
    if isinstance(value, list) and not (len(value) == 1 and isinstance(value[0], list)):
        tag = value[0] if value and isinstance(value[0], str) else None
        if tag in ("undefined", "null"):
            return tag, None
        if tag in ("inf", "-inf", "nan"):
            return "number", {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}[tag]
        if tag in ("bigint", "bytes", "date"):
            return tag, str(value[1])
        if tag == "error":
            return "error", f"{value[1] if len(value) > 1 and value[1] else 'Error'}: {value[2] if len(value) > 2 and value[2] else ''}"
        return ("reference" if tag in ("import", "export", "pipeline") else "array"), json.dumps(value, separators=(",", ":"))
    if isinstance(value, list):
        return "array", json.dumps([_plain(x) for x in value[0]], separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, dict):
        return "object", json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False)
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    return ("string" if isinstance(value, str) else "number"), str(value)


def _plain(value):
    """A value within an array or object: lists without their escape, tagged values as {type, value}."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        if len(value) == 1 and isinstance(value[0], list):
            return [_plain(x) for x in value[0]]
        kind, text = _decoded(value)
        return {"type": kind, "value": text}
    return value


def _typed_json(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            out.append((None, None) if t is None else _decoded(json.loads(t)))
        except ValueError:
            out.append((None, None))
    return pd.DataFrame(out, columns=["type", "value"])


def to_typed_json(kind: Column, value: Column) -> Column:
    """A value of a kind as typed JSON; value is its text."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'^\{"x":|\}$', "")
    special = F.create_map(*[F.lit(x) for x in ("NaN", '["nan"]', "Infinity", '["inf"]', "-Infinity", '["-inf"]')])
    return (
        F.when(kind == "undefined", '["undefined"]').when(value.isNull() | (kind == "null"), "null").when(kind == "string", quoted(value))
        .when(kind == "number", F.coalesce(F.try_element_at(special, value), value)).when(kind.isin("bigint", "bytes"), F.concat(F.lit('["'), kind, F.lit('",'), quoted(value), F.lit("]")))
        .when(kind == "date", F.concat(F.lit('["date",'), value, F.lit("]"))).when(kind == "array", F.concat(F.lit("["), value, F.lit("]"))).otherwise(value)
    )


def _embedded(text: str) -> str:
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()


def _extracted(packed: str) -> str:
    return gzip.decompress(base64.b64decode(packed)).decode()


#: Bytes of texts that one step of `through` holds beside their batch; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def _pieces(array: pa.Array) -> Iterator[pa.Array]:
    """An array of texts cut between them into steps."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(array):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + STEP_BYTES, side="right")))
        yield array.slice(start, end - start)
        start = end


def through(column: Column | str, *steps: Callable[[str], str]) -> Column:
    """A text after these steps, one after another; only a bounded part of a batch is in Python's hands at a time."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in _pieces(batch):
                out = []
                for text in piece:
                    text = text.as_py()
                    for step in steps:
                        text = None if text is None else step(text)
                    out.append(text)
                yield pa.array(out, pa.string())

    return arrow_udf(run, "string")(column)


class _Chunks:
    """Streams a text in pieces of so many characters."""

    def eval(self, text: str, size: int):
        for place, at in enumerate(range(0, len(text or ""), size)):
            yield place, text[at : at + size]


def chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """df with a row (.., place, chunk) for each `size` characters of a text; none for a null or empty one."""
    return df.lateralJoin(udtf(_Chunks, returnType="place int, chunk string")(F.col(text).outer(), F.lit(size))).drop(text)


def split(column: Column | str) -> Column:
    """The frames of a batch, and what is wrong with its end, if anything is."""
    return pandas_udf(_split, "struct<frames:array<binary>,error:string>")(column)


def typed_json(column: Column | str) -> Column:
    """Type and text of a value in typed JSON, where lists with a tag stand for what JSON lacks; null if it is no JSON."""
    return pandas_udf(_typed_json, "struct<type:string,value:string>")(column)


def embedded(column: Column | str) -> Column:
    """A text as gzip in base64, the same for the same text."""
    return through(column, _embedded)


def extracted(column: Column | str) -> Column:
    """The text of embedded()."""
    return through(column, _extracted)


def regained(column: Column | str) -> Column:
    """extracted() of embedded(), in one pass."""
    return through(column, _embedded, _extracted)
