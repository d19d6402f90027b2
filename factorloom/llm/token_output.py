"""Token-id output: documents in ascending doc_id order as rANS files, and their reader.

Documents are range-partitioned by id, tokenized, and each partition streams into one file of segments
(see rans.py); a file is written under a temporary name and then renamed, so a task that is run again
leaves a whole file. The manifest has one row per file. Documents with the same id stay in one file, ordered by
text; null texts are empty (only the end id); a null doc_id comes first and reads back as null; an
empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rans
from .common import END_ID, column, crc32, encoder, map_arrow, text_bytes

_NULL = -(1 << 63)
MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, directory: str, tokenizer: str) -> DataFrame:
    """Writes docs(doc_id, text) below the directory, a URI that all executors share; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(directory)
        enc, name = encoder(tokenizer), None
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = docs_out = ids_out = 0
        part = TaskContext.get().partitionId()
        sink = None

        def flush() -> None:
            nonlocal pending, held
            if pending:
                sink.write(rans.encode_segment(*(np.concatenate(x) for x in zip(*pending))))
            pending, held = [], 0

        try:
            for batch in batches:
                names = [_NULL if i is None else i for i in column(batch, "doc_id")]
                texts = text_bytes(batch)
                if sink is None:
                    place.create_dir(root)
                    name = f"part-{part:06d}.rans"
                    temporary = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                    sink = place.open_output_stream(temporary)
                at = 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and size < 4_000_000:
                        size += len(texts[to])
                        to += 1
                    ids, offsets = enc.encode(texts[at:to])
                    sizes = np.diff(offsets) + 1
                    out = np.full(int(sizes.sum()), END_ID, np.uint32)
                    out[np.arange(len(ids)) + np.repeat(np.arange(to - at), np.diff(offsets))] = ids
                    pending.append((np.array(names[at:to], np.int64), sizes, out))
                    held += len(out)
                    docs_out += to - at
                    ids_out += len(out)
                    if held >= rans.SEGMENT:
                        flush()
                    at = to
            if sink is not None:
                flush()
                n_bytes = sink.tell()
                sink.close()
                sink = None
                _put(place, temporary, f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (name, pa.string()), (docs_out, pa.int64()), (ids_out, pa.int64()), (n_bytes, pa.int64()))], names=["part", "file", "n_docs", "n_ids", "n_bytes"])
        finally:
            if sink is not None:
                sink.close()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return map_arrow(rows, run, MANIFEST, encodes=True)


def _put(place: fs.FileSystem, temporary: str, final: str) -> None:
    """Renames a whole file; what another attempt of the task has left there, which is the same, gives way."""
    try:
        place.move(temporary, final)
    except OSError:
        place.delete_file(final)
        place.move(temporary, final)


def read(manifest: list, directory: str, spark) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest's rows name."""
    files, before = [], 0
    for row in sorted(manifest, key=lambda r: r.part):
        files.append((f"{directory.rstrip('/')}/{row.file}", before))
        before += row.n_ids
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(column(batch, "uri"), column(batch, "start")):
                place, path = fs.FileSystem.from_uri(uri)
                with place.open_input_stream(path) as source:
                    while (segment := rans.read_segment(source.read)) is not None:
                        names, sizes, ids = segment
                        ends = sizes.cumsum()
                        starts = ends - sizes
                        crcs = [crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names, mask=names == _NULL), pa.array(starts + start), pa.array(sizes), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        start += len(ids)

    rows = spark.createDataFrame(files, "uri string, start long").repartition(len(files))
    return map_arrow(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
