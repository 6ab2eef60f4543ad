"""Flat token-id files with 64-bit document offsets.

Layout of a folder, one set of files per part p (parts follow each other in id order):

* ``p.ids``      token ids, little-endian unsigned 16-bit (vocabularies up to 65,536) or 32-bit, documents back to back;
* ``p.offsets``  little-endian int64: the global position of each document's first token, then the part's end;
* ``p.docs``     little-endian int64 document ids (the lowest int64 stands for null).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, utf8_list
from .encoder import kept

NULL_ID = -(1 << 63)


def _open(uri: str):
    return pfs.FileSystem.from_uri(uri) if "://" in uri else (pfs.LocalFileSystem(), uri)


def _put(fs, path: str, write) -> None:
    """Writes under a name of its own, then renames: a repeated or speculative task leaves whole files only."""
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        write(f)
    fs.move(own, path)


def _clear(uri: str, parts: set[int]) -> None:
    """Deletes files of other parts, which an earlier writing into the same folder left behind."""
    fs, base = _open(uri)
    for x in fs.get_file_info(pfs.FileSelector(base, allow_not_found=True)):
        stem, _, kind = x.base_name.partition(".")
        if kind in ("ids", "docs", "offsets") and stem.isdigit() and int(stem) not in parts:
            fs.delete_file(x.path)


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, part_bytes: int = 256 << 20) -> DataFrame:
    """Encodes every text, in ascending id order, into the files described above under `uri`; returns (part, n_docs, n_tokens, base).

    Rows are dealt by ranges of (id, hash of the text) into `parts` parts, by default as many as give each about `part_bytes` of
    text, and no fewer than the session's shuffle partitions; they are sorted, encoded in Arrow batches and appended to the part's file, so no
    task holds more than a batch. A part's base is the prefix sum of the token counts of the parts before it; one small row
    per part is all that meets. `end_id` is appended to each document. Null text: no tokens but the end id; null ids come
    first; rows with the same id stand in the order of their texts' hashes. An empty table gives no files and no rows.
    Parts that an earlier writing left in the folder, beyond those of this one, are deleted.
    An id of -2^63, which would read back as null, is refused. Executors must reach `uri` (a shared folder or object store); lost
    tasks are run again and replace their files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = parts
    if not n:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = kept(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        fs, base = _open(uri)
        fs.create_dir(base, recursive=True)
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def body(f) -> None:
            for batch in by_bytes(batches, "text", 4 << 20):
                found = [encoder.ids(x) + end for x in utf8_list(batch.column("text"))]
                f.write(b"".join(found))
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)) // encoder.dtype.itemsize)
                own = np.asarray(batch.column("id").fill_null(NULL_ID), "<i8")
                if (own == NULL_ID).sum() > batch.column("id").null_count:
                    raise ValueError("an id of -2^63 stands for null")
                ids.append(own)

        _put(fs, f"{base}/{part:06d}.ids", body)
        if not ids:
            fs.delete_file(f"{base}/{part:06d}.ids")
            return
        local = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        _put(fs, f"{base}/{part:06d}.docs", lambda f: f.write(np.concatenate(ids).tobytes()))
        _put(fs, f"{base}/{part:06d}.offsets", lambda f: f.write(local.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(local) - 1], pa.int64()), pa.array([int(local[-1])], pa.int64())], ["part", "n_docs", "n_tokens"])

    # a row per file: the listing of the folder, of the size of a directory listing
    found = sorted(tuple(x) for x in rows.mapInArrow(encode, "part int, n_docs bigint, n_tokens bigint").collect())
    _clear(uri, {x[0] for x in found})
    bases = np.concatenate([[0], np.cumsum([x[2] for x in found])]).astype(int)
    table = [(p, d, t, int(b)) for (p, d, t), b in zip(found, bases[: len(found)], strict=True)]
    out = spark.createDataFrame(table, "part int, n_docs bigint, n_tokens bigint, base bigint")
    if not table:
        return out
    spread = spark.createDataFrame(table, "part int, n_docs bigint, n_tokens bigint, base bigint").repartition(min(len(table), n), "part")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['part']:06d}.offsets"
                with fs.open_input_file(path) as f:
                    at = np.frombuffer(f.read(), "<i8")
                if len(at):  # a repeated task finds its own earlier work: the first value tells the base
                    _put(fs, path, lambda f, at=at, b=row["base"]: f.write((at - at[0] + b).astype("<i8").tobytes()))
            yield batch

    spread.mapInArrow(shift, spread.schema).collect()
    return out


def read_token_files(spark: SparkSession, uri: str, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document in the files; ids are summed as unsigned 32-bit integers.

    table is what write_token_files() returned. Files on a local or mounted path are memory-mapped, others are read as ranges.
    A file's size and offsets tell whether its ids have 16 or 32 bits; one in which they don't agree fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(uri)
        local = isinstance(fs, pfs.LocalFileSystem)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/{row['part']:06d}"
                with fs.open_input_file(f"{name}.offsets") as f:
                    at = np.frombuffer(f.read(), "<i8")
                with fs.open_input_file(f"{name}.docs") as f:
                    docs = np.frombuffer(f.read(), "<i8")
                size, n = fs.get_file_info(f"{name}.ids").size, int(at[-1] - at[0])
                if size not in (2 * n, 4 * n):
                    raise ValueError(f"{name}.ids has {size} bytes for {n} ids")
                dtype = np.dtype("<u2" if size == 2 * n else "<u4")
                flat = np.memmap(f"{name}.ids", dtype, "r") if local and at[-1] > at[0] else None
                with fs.open_input_file(f"{name}.ids") as f:
                    crc = []
                    for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True):
                        if flat is not None:
                            ids = flat[a:b]
                        else:
                            f.seek(a * dtype.itemsize)
                            ids = np.frombuffer(f.read((b - a) * dtype.itemsize), dtype)
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                for i in range(0, len(docs), 50_000):
                    part = docs[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64(), mask=part == NULL_ID), pa.array(at[i : i + len(part)], pa.int64()), pa.array(np.diff(at)[i : i + len(part)], pa.int64()), pa.array(crc[i : i + len(part)], pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(table.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return table.repartition(n, "part").mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)
