"""Landed pages as a resumable stream: an offset is a page number with the name of its window, a partition is a page.

The pages of a window lie below path/page=N as Parquet files, as Spark's writer leaves them, in any file system that
pyarrow opens. A page that is not there when a later one is gives one row that says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MISSING = "missing_page"
_PAGE = re.compile(r"page=(\d+)$")


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PageReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.window = schema, options["path"], options.get("window", "")
        self.most = int(options.get("maxPages", 2**31 - 1))

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def _landed(self) -> list[int]:
        fs, root = self._folder()
        names = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.Directory]
        return sorted(int(m.group(1)) for m in map(_PAGE.search, names) if m)

    def initialOffset(self) -> dict:
        return {"window": self.window, "page": 0}

    def latestOffset(self) -> dict:
        return {"window": self.window, "page": min(max(self._landed(), default=-1) + 1, self.most)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        """A token of another window is refused: its pages are not those of this one."""
        if start["window"] != self.window:
            raise ValueError(f"another_window: the token is of {start['window']!r}, asked is {self.window!r}")
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        fs, root = self._folder()
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/page={partition.number}", allow_not_found=True)) if f.path.endswith(".parquet")]
        columns = [f.name for f in self.schema if f.name not in ("page", "error")]
        schema = to_arrow_schema(self.schema)
        if not files:
            yield pa.RecordBatch.from_pylist([{"page": partition.number, "error": MISSING}], schema=schema)
        for name in files:
            with fs.open_input_file(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=columns):
                    found = {c: batch.column(c).cast(schema.field(c).type) for c in columns}
                    found |= {"page": pa.array([partition.number] * len(batch), pa.int32()), "error": pa.nulls(len(batch), pa.string())}
                    yield pa.RecordBatch.from_arrays([found[f.name] for f in schema], schema=schema)

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    """Format landed_pages; options path, window and maxPages. The schema is the pages' own columns, page int and error string."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        raise ValueError("give the schema of the pages with .schema()")

    def streamReader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)
