"""A folder of transcripts and workbooks as a Spark data source: spark.read.format("loomcode_documents").load(path).

A row for each transcript (text), and for each cell of a workbook under a header (text, sheet, row_no, column); error says why a file could not be read, or is not
admitted, and such a file fails alone. A partition is a group of files of about `group_bytes` (option, 32 MB). Files are opened only if a column is
asked for that lies in them: give the reader a schema with the columns that are wanted, as Spark does not tell a Python source which ones it drops.
A filter on filename or kind is applied to the list of files.

Paths are opened through pyarrow.fs: folders that all machines see, hdfs:// and the stores that it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from loomcode.sources.files import SUFFIXES, file_text, headed_cells

NAME = "loomcode_documents"
SCHEMA = "path string, filename string, kind string, size long, text string, sheet string, row_no int, column string, error string"
INSIDE = {"text", "sheet", "row_no", "column", "error"}
GROUP_BYTES = 32 << 20


def file_system(path: str):
    """(pyarrow's file system, the path in it)."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def kind_of(filename: str) -> str:
    low = filename.lower()
    if low.endswith(".xlsx"):
        return "workbook"
    if low.endswith(SUFFIXES):
        return "transcript"
    return "old Word format" if low.endswith(".doc") else "unknown suffix"


class Files(InputPartition):
    def __init__(self, listed: list[tuple[str, int]]):
        self.listed = listed


class DocumentReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, group_bytes: int):
        self.path, self.names, self.group_bytes, self.tests = path, schema.names, group_bytes, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("filename",), ("kind",)):
                self.tests.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = file_system(self.path)
        listed = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("~$", ".", "_"))]
        listed = [x for x in listed if all({"filename": x.base_name, "kind": kind_of(x.base_name)}[k] in v for k, v in self.tests)]
        groups, size = [[]], 0
        for x in sorted(listed, key=lambda x: x.path):
            if groups[-1] and size + x.size > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append((x.path, x.size))
            size += x.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        inside = bool(INSIDE & set(self.names))
        for path, size in partition.listed:
            name = path.rsplit("/", 1)[-1]
            kind = kind_of(name)
            known = {"path": path, "filename": name, "kind": kind, "size": size}
            for row in self.rows(system, path, name, kind) if inside else ({},):
                both = known | row
                yield tuple(both.get(c) for c in self.names)

    @staticmethod
    def rows(system, path: str, name: str, kind: str) -> Iterator[dict]:
        if kind not in ("workbook", "transcript"):
            yield {"error": kind}
            return
        try:
            with system.open_input_stream(path) as f:
                data = f.read()
            if kind == "transcript":
                found = [{"text": file_text(name, data)}]
            else:
                found = [dict(zip(("sheet", "row_no", "column", "text"), c, strict=True)) for c in headed_cells(data)]
        except Exception as e:  # a broken file fails alone
            found = [{"error": f"{type(e).__name__}: {e}"}]
        yield from found


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options["path"], schema, int(self.options.get("group_bytes", GROUP_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known in a session, and has filters pushed to it, as a reader that takes them requires."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
