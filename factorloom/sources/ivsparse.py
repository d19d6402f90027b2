"""The binary file of a matrix compressed by column, distinct value and index gaps.

Little-endian: six u32 (level 3, rows, columns, cells, the value type's bytes: size, floating, signed, by column; bytes of an index), the size of every
column as u64, then the columns. A column is a row of runs by ascending value: the f64 value, the width of its indices as one byte, the
first index and the gaps to the next ones at that width, and a zero of that width.

Columns are compressed, and read back, by tasks, which write them to files of the shared folder; the file itself is one stream, as its format asks: the driver
puts those files together, a few megabytes at a time, and gets only their names from the tasks. Parquet
(matrix_io) is the form for large matrices. The folder must be one that pyarrow reads.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix
from ..session import shared_dir, ship

_HEAD = struct.Struct("<6I")
#: Bytes that the driver holds of a file.
AT_ONCE = 8 << 20
LEVEL, VALUE_TYPE, INDEX_BYTES = 3, 8 | 1 << 8 | 1 << 16 | 1 << 24, 8


def encode_column(values: list[float], widths: list[int], gaps: list[list[int]]) -> bytes:
    out = []
    for value, width, own in zip(values, widths, gaps):
        bytes_ = np.array(own, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out += [struct.pack("<dB", value, width), bytes_.tobytes(), bytes(width)]
    return b"".join(out)


def decode_column(blob: bytes | memoryview) -> Iterator[tuple[float, np.ndarray]]:
    """(value, indices) of each run."""
    at = 0
    while at < len(blob):
        value, width = struct.unpack_from("<dB", blob, at)
        at += 9
        parts, ended, n = [], False, 64
        while not ended:
            n = min(n, (len(blob) - at) // width)
            if n <= 0:
                raise ValueError("a run has no end")
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
            gaps = wide.view("<u8")[:, 0].astype(np.int64)
            zero = np.flatnonzero(gaps == 0)
            zero = zero[zero > 0] if not parts else zero  # the first index may be zero
            if len(zero):
                gaps, ended = gaps[: zero[0]], True
            parts.append(gaps)
            at += (len(gaps) + ended) * width
            n *= 4
        yield value, np.concatenate(parts).cumsum()


def write(m: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Writes the cells of m to the file at path, a URI or a local path."""
    ship(m.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_column(*r) for r in rows], pa.binary())], names=["col_id", "blob"])

    runs = matrix.to_ivcsc(m).groupBy("col_id").agg(F.sort_array(F.collect_list(F.struct("value", F.col("width").cast("int").alias("width"), "gaps"))).alias("r"))
    rows = runs.repartitionByRange("col_id").sortWithinPartitions("col_id").select(F.col("col_id").cast("long"), "r.value", "r.width", "r.gaps")
    base = f"{shared_dir(m.sparkSession)}/ivsparse"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's columns in a file of their own, and their ids and sizes in another."""
        name, first = f"{base}/{uuid.uuid4().hex}", None
        place, path = fs.FileSystem.from_uri(name)
        place.create_dir(path.rpartition("/")[0])
        with place.open_output_stream(f"{path}.columns") as columns, place.open_output_stream(f"{path}.sizes") as sizes:
            for batch in run(batches):
                ids = batch.column(0).to_numpy()
                first = int(ids[0]) if first is None and len(ids) else first
                own = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
                sizes.write(np.stack([ids, own], axis=1).astype("<u8").tobytes())
                for blob in batch.column(1):
                    columns.write(blob.as_buffer())
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([name])], names=["first", "name"])

    parts = sorted((r["first"], r["name"]) for r in rows.mapInArrow(store, "first long, name string").collect())
    place, name = fs.FileSystem.from_uri(path)
    with place.open_output_stream(name) as out:
        out.write(_HEAD.pack(LEVEL, n_rows, n_cols, m.count(), VALUE_TYPE, INDEX_BYTES))
        done = 0
        for _, part in parts:
            for piece in _pieces(f"{part}.sizes"):
                ids, own = np.frombuffer(piece, "<u8").reshape(-1, 2).T.astype(np.int64)
                whole = np.zeros(int(ids[-1]) + 1 - done, "<u8")
                whole[ids - done] = own
                out.write(whole.tobytes())
                done += len(whole)
        for at in range(done, n_cols, AT_ONCE // 8):
            out.write(bytes(8 * (min(n_cols, at + AT_ONCE // 8) - at)))
        for _, part in parts:
            for piece in _pieces(f"{part}.columns"):
                out.write(piece)


def _pieces(uri: str) -> Iterator[bytes]:
    place, name = fs.FileSystem.from_uri(uri)
    with place.open_input_file(name) as file:
        while piece := file.read(AT_ONCE):
            yield piece


def read(spark: SparkSession, path: str, at_once: int = 64 << 20) -> DataFrame:
    """The cells (row_id, col_id, value) of a file; tasks take stretches of about at_once bytes."""
    ship(spark)
    place, name = fs.FileSystem.from_uri(path)
    with place.open_input_file(name) as file:
        level, _, n_cols, _, value_type, _ = _HEAD.unpack(file.read(_HEAD.size))
        if (level, value_type) != (LEVEL, VALUE_TYPE):
            raise ValueError("not a level 3 file of doubles by column")
        sizes = np.frombuffer(file.read(8 * n_cols), "<u8").astype(np.int64)
    ends = sizes.cumsum()
    lot = (ends - 1) // at_once
    cuts = np.append(np.flatnonzero(np.append(True, lot[1:] != lot[:-1])), n_cols) if n_cols else np.zeros(1, np.int64)
    base = _HEAD.size + 8 * n_cols
    parts = [(int(a), int(base + ends[a] - sizes[a]), sizes[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, start, packed in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(packed, np.int64)
                place, name = fs.FileSystem.from_uri(path)
                with place.open_input_file(name) as file:
                    file.seek(start)
                    for k, size in enumerate(own.tolist()):
                        runs = list(decode_column(file.read(size)))
                        if runs:
                            index = np.concatenate([i for _, i in runs])
                            values = np.repeat([v for v, _ in runs], [len(i) for _, i in runs])
                            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.full(len(index), first + k, np.int64)), pa.array(values)], names=["row_id", "col_id", "value"])

    schema = "row_id long, col_id long, value double"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(parts, "first long, start long, sizes binary").repartition(len(parts)).mapInArrow(run, schema)


def show(m: DataFrame, n_rows: int, n_cols: int, most: int = 100) -> str:
    """The dense upper left corner, a line per row."""
    rows, cols = min(n_rows, most), min(n_cols, most)
    dense = np.zeros((rows, cols))
    for r in m.where((F.col("row_id") < rows) & (F.col("col_id") < cols)).collect():
        dense[r["row_id"], r["col_id"]] = r["value"]
    return "\n".join(" ".join(f"{x:g}" for x in line) for line in dense)
