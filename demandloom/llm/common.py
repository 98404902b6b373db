"""Reading documents and walking their texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A Python step takes this many bytes of text at a time, whatever the session's batch size.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once a row however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def text_steps(batches: Iterator[pa.RecordBatch], at: int | None = None, step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes (null: empty), ``step`` bytes or one longer text at a time.

    The texts are column ``at``, or the one named text.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text") if at is None else at).cast(pa.binary())
        start, size = 0, 0
        for i, length in enumerate(_lengths(column)):
            size += length
            if size >= step:
                yield batch.slice(start, i + 1 - start), _bytes(column.slice(start, i + 1 - start))
                start, size = i + 1, 0
        if start < len(column):
            yield batch.slice(start), _bytes(column.slice(start))


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _bytes(column: pa.Array) -> list[bytes]:
    return [x if x is not None else b"" for x in column.to_pylist()]


def row_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict]:
    """Runs of rows with equal first ``keys`` columns, as numpy arrays, from sorted batches.

    A run may cross batches; callers bound its size.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        if held:
            last = held[-1]
            change[0] = any(last.column(i)[last.num_rows - 1] != batch.column(i)[0] for i in range(keys))
        cuts = np.flatnonzero(change).tolist()
        start = 0
        for cut in cuts:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            yield _joined(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> dict:
    whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return {name: whole.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(whole.schema.names)}


def written(names: list[tuple[str, pa.DataType]], rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples."""
    schema = pa.schema(names)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _filter_bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each unsigned 64-bit hash in a filter of ``bits`` bits, a power of two."""
    return (hashes >> np.uint64(32)).astype(np.int64) % bits, (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) % bits


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the one column of longs, as bytes: at most bits / 64 rows come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_filter_bits(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["place", "word"])

    rows = hashes.mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[rows.column("place").to_numpy()] = rows.column("word").to_numpy()
    return filled.view(np.uint8)


def passing(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    one, two = _filter_bits(hashes, 8 * len(filled))
    return (filled[one >> 3] >> (one & 7) & 1 & (filled[two >> 3] >> (two & 7))).astype(bool)
