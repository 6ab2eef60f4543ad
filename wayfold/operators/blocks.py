"""Tables that tasks keep by name in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_wayfold_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="wayfold-")) / "wayfold.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(to))
    context._wayfold_shipped = True


def at(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri) if "://" in uri else (pfs.LocalFileSystem(), uri)


def put(uri: str, name: str, table: pa.Table) -> None:
    """Writes under a name of its own, then renames: a repeated or speculative task leaves whole files only."""
    fs, base = at(uri)
    to = f"{base}/{name}"
    fs.create_dir(to.rpartition("/")[0], recursive=True)
    own = f"{to}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own) as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    fs.move(own, to)


def get(uri: str, name: str) -> pa.Table:
    fs, base = at(uri)
    with fs.open_input_file(f"{base}/{name}") as f:
        return pa.ipc.open_stream(f).read_all()


def versions(uri: str, name: str) -> list[int]:
    """The numbers of the files in a folder of versions, in order."""
    fs, base = at(uri)
    found = fs.get_file_info(pfs.FileSelector(f"{base}/{name}", allow_not_found=True))
    return sorted(int(x.base_name) for x in found if x.base_name.isdigit())


def forget(uri: str, name: str) -> None:
    fs, base = at(uri)
    if fs.get_file_info(f"{base}/{name}").is_file:
        fs.delete_file(f"{base}/{name}")


def clear(spark: SparkSession, uri: str) -> None:
    """Deletes a folder, once nothing reads it any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sorted_groups(batches, *keys: str):
    """(key values, table) of each run of equal keys in record batches that are sorted by them; a run is held whole."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, own in enumerate(names):
            if own != before:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield before, pa.Table.from_batches(held)
                held, start, before = [], i, own
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield before, pa.Table.from_batches(held)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys and sorted by them. The number of tasks is stated, so that few rows with much work each aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
