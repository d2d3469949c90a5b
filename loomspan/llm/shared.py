"""Arrow helpers and what several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle of about the size of ``df``'s own input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def kept_names(keep: tuple[str, ...], own: list[str]) -> list[str]:
    """The names of kept columns, apart from an operator's own."""
    taken, out = {c.lower() for c in own}, []
    for name in keep:
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Gives what a worker has freed back to the system: idle workers stay
    beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):
        release(0)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of about ``budget`` bytes of ``column``; one
    longer text makes a run of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > budget:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        if first < batch.num_rows:
            yield batch.slice(first)
    trim()
