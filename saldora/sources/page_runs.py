"""The data source "page_runs": documents of a folder as runs (pdf.RUNS) with path, suffix and size of their file.

    spark.dataSource.register(PageRuns)
    runs = spark.read.format("page_runs").load("file:///inbox").where("suffix = '.pdf' and bytes < 1000000")
    pages = pdf.page_texts(runs)

Files are dealt to input partitions by size (option partitionBytes, 64 MB). Comparisons of suffix and bytes with a value
are pushed to the listing if spark.sql.python.filterPushdown.enabled is set, so that other files are not opened. As a
stream, each batch reads the files that are new since the batch before, by time of change and path (option
filesPerBatch, 1000). A file that cannot be read is a row with an error.

The folder must be in a store that pyarrow knows; others go through files.binary_files and files.pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import datasource as D

from saldora.sources import pdf

SCHEMA = "path string, suffix string, bytes long, " + pdf.RUNS
MB = 2**20
_TESTS = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b}


@dataclass
class Found:
    path: str
    suffix: str
    bytes: int
    time: int  # nanoseconds


@dataclass
class Files(D.InputPartition):
    files: list[Found]

    def __init__(self, files):
        super().__init__(None)
        self.files = files


def listed(folder: str) -> list[Found]:
    """The files below the folder, in order of time and path; hidden ones are left out."""
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    out = []
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = f.path.rsplit("/", 1)[-1]
        if f.type == fs.FileType.File and name[0] not in "._":
            out.append(Found(f.path, "." + name.rsplit(".", 1)[1].lower() if "." in name else "", f.size, f.mtime_ns))
    return sorted(out, key=lambda f: (f.time, f.path))


def dealt(files: list[Found], size: int) -> list[Files]:
    parts, held = [], 0
    for f in files:
        if not parts or held + f.bytes > size:
            parts.append(Files([]))
            held = 0
        parts[-1].files.append(f)
        held += f.bytes
    return parts


def read(folder: str, part: Files):
    from saldora.sources.files import other_pages

    store, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    for f in part.files:
        begin = (f.path, f.suffix, f.bytes)
        try:
            with store.open_input_stream(f.path) as stream:
                data = stream.read()
            if f.suffix == ".pdf":
                for row in pdf.file_runs(f.path, data):
                    yield begin + row
            else:
                for n, text in enumerate(other_pages(f.path, data, True), 1):
                    yield (*begin, f.path, n, 0, None, None, None, None, text, None)
        except Exception as e:  # damage is a row
            yield (*begin, f.path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


class Reader(D.DataSourceReader):
    def __init__(self, options):
        self.folder, self.size, self.tests = options["path"], int(options.get("partitionBytes", 64 * MB)), []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in ("suffix", "bytes"):
                self.tests.append((type(f), column, f.value))
            else:
                yield f

    def partitions(self):
        fit = lambda f: all(_TESTS[kind](getattr(f, column), value) for kind, column, value in self.tests)
        return dealt([f for f in listed(self.folder) if fit(f)], self.size) or [Files([])]

    def read(self, partition):
        return read(self.folder, partition)


class StreamReader(D.DataSourceStreamReader):
    """Offsets are the time and path of the last file of a batch."""

    def __init__(self, options):
        self.folder, self.size, self.most = options["path"], int(options.get("partitionBytes", 64 * MB)), int(options.get("filesPerBatch", 1000))
        self.last = (-1, "")

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        new = [f for f in listed(self.folder) if (f.time, f.path) > self.last][: self.most]
        if new:
            self.last = (new[-1].time, new[-1].path)
        return {"time": self.last[0], "path": self.last[1]}

    def partitions(self, start, end):
        key = lambda o: (o["time"], o["path"])
        self.last = max(self.last, key(end))
        return dealt([f for f in listed(self.folder) if key(start) < (f.time, f.path) <= key(end)], self.size)

    def read(self, partition):
        return read(self.folder, partition)

    def commit(self, end):
        pass


class PageRuns(D.DataSource):
    @classmethod
    def name(cls):
        return "page_runs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)

