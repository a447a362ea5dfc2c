"""What the corpus operators share: reading tables, words, checkpoints and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.lineage import cut, remove, shared_dir

__all__ = ["cut", "remove", "shared_dir"]

#: What Spark hands to a Python worker at a time, unless the session says otherwise: long texts come in small batches.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

#: Letters A-Z in lower case, other bytes as they are.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: The columns of the documents table.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone (the path may be in any store).

    A table in fewer partitions than there are cores, as one small file gives, is dealt over the cores; larger ones stay
    as they are read.
    """
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a string like "doc_id long, ids array<int>", without Spark, as executors need it."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(","))])


def release() -> None:
    """Gives back what a task has freed: workers wait for their next task, and would keep it from the others meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow for a function from an iterator of record batches to an iterator of lists or arrays by column."""

    kind = arrow_schema(schema)
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == "67108864b":  # the default
        conf.set(BATCH_KEY, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for columns in function(batches):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, kind, strict=True)], schema=kind)
        finally:
            release()

    return df.mapInArrow(run, schema)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; none for null. bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two parts from the hashes of the parts."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right))


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to blocks of about limit bytes; bounds what is held at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def spread(values: np.ndarray, bound: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists numbered at, one after another; bounds of these lists). List i is values[bound[i]:bound[i + 1]]."""
    size = (bound[1:] - bound[:-1])[at]
    out = np.append(0, np.cumsum(size))
    return values[np.repeat(bound[at] - out[:-1], size) + np.arange(out[-1])], out
