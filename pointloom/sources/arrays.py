"""NumPy archives as tables: arrays of equal first length become columns, scalars are repeated, (n, 3) arrays split."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import batched
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of an archive that is written.
ROWS = 200_000
_AXES = {2: "xy", 3: "xyz"}


def table_of(path: str, length_of: str | None = None) -> pa.Table:
    """The archive's arrays with as many rows as `length_of` (or the longest array), and its scalars."""
    with np.load(path, allow_pickle=False) as archive:
        arrays = {k: archive[k] for k in archive.files}
    n = len(arrays[length_of]) if length_of else max((len(a) for a in arrays.values() if a.ndim), default=0)
    columns: dict[str, pa.Array] = {}
    for name, a in arrays.items():
        if a.ndim == 0:
            columns[name] = pa.array([a.item()] * n)
        elif len(a) == n and a.ndim == 1:
            columns[name] = pa.array(a.astype(np.int64) if a.dtype == np.uint64 else a.astype(np.int32) if a.dtype == np.uint16 else a.astype(np.int16) if a.dtype == np.uint8 else a.astype(np.int64) if a.dtype == np.uint32 else a)
        elif len(a) == n and a.ndim == 2 and a.shape[1] in _AXES:
            stem = "" if name == "xyz" else name.removesuffix("_xyz") + "_"
            for i, axis in enumerate(_AXES[a.shape[1]]):
                columns[f"{stem}{axis}"] = pa.array(a[:, i])
    return pa.table(columns)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = Path(options["path"])
        self.length = options.get("length_of")
        self.files = [str(f) for f in (sorted(path.glob("*.npz")) if path.is_dir() else [path])]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        table = table_of(partition.value, self.length)
        yield from table.append_column("file", pa.array([Path(partition.value).name] * len(table))).to_batches(65536)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, schema):
        self.folder, self.names = folder, [f.name for f in schema]

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        for number, rows in enumerate(batched(iterator, ROWS)):  # one archive for so many rows, so that a task holds no more
            Path(self.folder).mkdir(parents=True, exist_ok=True)
            columns = {n: np.array([r[i] for r in rows]) for i, n in enumerate(self.names)}
            np.savez_compressed(Path(self.folder) / f"part-{TaskContext.get().partitionId():05d}-{number:03d}.npz", **columns)
        return WriterCommitMessage()


class NumpyArchive(DataSource):
    """spark.read.format("npz").option("length_of", ...).load(path); df.write.format("npz").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        own = table_of(_Reader(dict(self.options)).files[0], self.options.get("length_of")).schema
        return from_arrow_schema(own.append(pa.field("file", pa.string())))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema)


def save_archive(path: str, df: DataFrame, scalars: Mapping[str, object] = {}) -> None:
    """A small table (a reference, a calibration) as one archive."""
    rows = df.toPandas()
    np.savez_compressed(path, **{c: rows[c].to_numpy() for c in rows.columns}, **{k: np.array(v) for k, v in scalars.items()})
