"""Arrow plumbing shared by the training-data operators.

Texts reach Python as Arrow buffers, so numpy kernels see one byte array per
slice instead of one Python string per row. Slices are bounded in bytes: a
batch that happens to hold many long documents is worked off piece by piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from glosspark.session import ship

SLICE_BYTES = 4 << 20
BATCH_ROWS = 512


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def set_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short (a batch is held whole by the JVM and by Python) and ship this package to the executors.

    Plans read the setting when they run, so it stays; a smaller value of the session's own is left alone.
    """
    own = int(spark.conf.get(ARROW_ROWS))
    spark.conf.set(ARROW_ROWS, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    ship(spark)


@contextmanager
def long_batches(spark: SparkSession, rows: int = 1 << 16):
    """Longer batches of narrow rows for what runs inside the block."""
    own = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, own)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; null counts as empty."""
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
    else:
        texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(offsets, bytes) of consecutive rows, about ``limit`` bytes at a time."""
    offsets, data = buffers(texts)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        own = offsets[at : end + 1]
        yield own - own[0], data[own[0] : own[-1]]
        at = end


def text_udf(work: Callable, ddl: str, limit: int = SLICE_BYTES):
    """A column function from texts: ``work(offsets, bytes)`` gives an array, or a dict of arrays for a struct type.

    Marked non-deterministic only so that Catalyst never evaluates it twice.
    """
    kind = _parse_datatype_string(ddl)
    arrow = to_arrow_type(kind)

    def run(texts):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        done = [pack(work(offsets, data), arrow) for offsets, data in slices(texts, limit)]
        return pa.concat_arrays(done) if done else pa.array([], arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind).asNondeterministic()


def pack(out, arrow: pa.DataType) -> pa.Array:
    """A dict of arrays as a struct array of the given type, anything else as a plain array."""
    if isinstance(out, dict):
        return pa.StructArray.from_arrays([pack(out[f.name], f.type) for f in arrow], fields=list(arrow))
    return out.cast(arrow) if isinstance(out, pa.Array) else pa.array(out, arrow)


def is_struct(ddl: str) -> bool:
    return isinstance(_parse_datatype_string(ddl), StructType)
