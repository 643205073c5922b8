"""Rows of a table in the shared folder, read by tasks a block at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame

# What Spark calls a store and what Arrow calls it.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store that ``uri`` lies in, and the path there."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme:  # a path without a store
        return fs.LocalFileSystem(), uri
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        raise ValueError(f"tasks cannot read {scheme}: name a folder on file, hdfs, s3, gs or abfs in spark.checkpoint.dir") from error


def written_files(table: DataFrame) -> list[str]:
    """The files of a written table; fails early where tasks could not open them."""
    files = sorted(table.inputFiles())
    for uri in files[:1]:
        open_store(uri)
    return files


def read_blocks(
    files: Sequence[str], rows: int, columns: Sequence[str], sorted_by: str | None = None, low: int = 0, high: int = 0
) -> Iterator[pa.Table]:
    """All rows of the files, at most ``rows`` at a time; no more than that is held.

    Given a column that each file is ``sorted_by``, only rows from ``low`` to ``high`` in it.
    """
    for uri in files:
        store, path = open_store(uri)
        with store.open_input_file(path) as file:
            parquet = pq.ParquetFile(file)
            groups = range(parquet.num_row_groups)
            if sorted_by is not None:
                at = parquet.schema_arrow.names.index(sorted_by)
                ranges = [parquet.metadata.row_group(n).column(at).statistics for n in groups]
                groups = [n for n, r in zip(groups, ranges, strict=True) if r is None or not r.has_min_max or r.min <= high and r.max >= low]
            for batch in parquet.iter_batches(batch_size=rows, row_groups=list(groups), columns=list(columns)):
                if sorted_by is not None:
                    first, last = np.searchsorted(batch.column(sorted_by).to_numpy(), (low, high + 1)).tolist()
                    batch = batch.slice(first, last - first)
                if batch.num_rows:
                    yield pa.Table.from_batches([batch])
