"""[UD2, SRC7] Saved answers of meeting portals as a data source: one interface for listing meetings, reading documents and telling health.

    spark.dataSource.register(MeetingAnswers)
    spark.read.format("meeting_answers").option("path", folder).option("what", "meetings").load()

A folder holds one folder a site (its name, or site=name); a site's *.json and *.txt files are answers, each an array of meetings, in the order of
their names; other files are documents. One partition a file, or of many small files a run, so answers are read where Spark puts them; filters
on site and file leave files out before any is opened. A file that can't be read gives a row that says so. Folders may be in any file system that pyarrow opens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from folioflow.sources.listings import portal_meetings

SCHEMAS = {
    "meetings": "site string, file string, list_no int, value string, error string",
    "documents": "site string, file string, content binary, sha256 string, error string",
    "health": "site string, file string, ok boolean, meetings_found int, reason string",
}
ANSWERS = (".json", ".txt")
#: Up to so many files are a partition each; of more, one takes a run of them, so many and so many bytes at most (a larger file goes alone).
PARTITIONS, MOST_FILES, MOST_BYTES = 64, 256, 16 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def saved(path: str, what: str) -> list[tuple[str, str, int]]:
    """(site, file, list_no) of the files of a kind, by file and site; list_no counts a site's answers."""
    return [x[:3] for x in _sized(path, what)]


def _sized(path: str, what: str) -> list[tuple[str, str, int, int]]:
    """As saved(), with each file's bytes."""
    files, folder = _opened(path.rstrip("/"))
    found = []
    for info in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        inside = info.path[len(folder.rstrip("/")) + 1 :].split("/")
        if info.type == fs.FileType.File and len(inside) > 1 and not any(p.startswith((".", "_")) for p in inside):
            if inside[-1].endswith(ANSWERS) != (what == "documents"):
                found.append((inside[0].removeprefix("site="), "/".join(inside), info.size or 0))
    turn: dict[str, int] = {}
    out = []
    for site, file, size in sorted(found, key=lambda x: (x[1].split("/")[-1], x[1])):
        out.append((site, file, turn.setdefault(site, 0), size))
        turn[site] += 1
    return out


def _row(path: str, what: str, site: str, file: str, list_no: int) -> tuple:
    """One file's row; what goes wrong is told in it."""
    files, folder = _opened(path.rstrip("/"))
    try:
        with files.open_input_stream(f"{folder}/{file}") as f:
            data = f.read()
        if what == "documents":
            return site, file, data, hashlib.sha256(data).hexdigest(), None
        text = data.decode("utf-8")
        meetings = json.loads(text)
        if not isinstance(meetings, list):
            raise ValueError("the answer is no list of meetings")
        if what == "health":
            found = sum(isinstance(m, dict) and m.get("id") is not None for m in meetings)
            return site, file, found > 0, found, None if found else "no meeting is listed"
        return site, file, list_no, text, None
    except Exception as e:  # a file may fail in any way
        reason = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}".strip(": ")
        return {"documents": (site, file, None, None, reason), "health": (site, file, False, 0, reason)}.get(what, (site, file, list_no, None, reason))


class _File(InputPartition):
    def __init__(self, site: str, file: str, list_no: int):
        super().__init__((site, file, list_no))


class _Files(InputPartition):
    """Several files; value is a list of theirs."""


def _runs(files: list[tuple[str, str, int, int]]) -> list[InputPartition]:
    runs: list[list] = []
    held, most = 0, min(MOST_FILES, -(-len(files) // PARTITIONS))
    for *file, size in files:
        if not runs or len(runs[-1]) == most or held + size > MOST_BYTES:
            runs.append([])
            held = 0
        runs[-1].append(tuple(file))
        held += size
    return [_File(*x[0]) if len(x) == 1 else _Files(x) for x in runs]


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _Reader(DataSourceReader):
    def __init__(self, path: str, what: str):
        self.path, self.what, self.filters = path, what, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes on tests of site and file; the rest stays with Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("site",), ("file",)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = _sized(self.path, self.what)
        fits = lambda x: all(_TESTS[kind](x[0] if column == "site" else x[1], value) for column, kind, value in self.filters)
        return _runs([x for x in files if fits(x)])

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is not None and partition.value is not None:
            for file in partition.value if isinstance(partition.value, list) else [partition.value]:
                yield _row(self.path, self.what, *file)


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are how many files, in the order of their names, have been read; files have to come in that order."""

    def __init__(self, path: str, what: str, most: int):
        self.path, self.what, self.most = path, what, most

    def initialOffset(self) -> dict:
        return {"files": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = saved(self.path, self.what)[start["files"] : start["files"] + self.most]
        return iter([_row(self.path, self.what, *x) for x in files]), {"files": start["files"] + len(files)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([_row(self.path, self.what, *x) for x in saved(self.path, self.what)[start["files"] : end["files"]]])

    def commit(self, end: dict) -> None:
        pass


class MeetingAnswers(DataSource):
    """Options: path; what (meetings, documents or health); maxFiles a batch of a stream (100)."""

    @classmethod
    def name(cls) -> str:
        return "meeting_answers"

    def _what(self) -> str:
        what = self.options.get("what", "meetings")
        if what not in SCHEMAS or not self.options.get("path"):
            raise ValueError(f"meeting_answers needs a path, and what as one of {', '.join(SCHEMAS)}")
        return what

    def schema(self) -> str:
        return SCHEMAS[self._what()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._what())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"], self._what(), int(self.options.get("maxFiles", "100")))


def answers(spark: SparkSession, path: str, what: str = "meetings") -> DataFrame:
    """The rows of SCHEMAS[what] of a folder of saved answers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MeetingAnswers)
    return spark.read.format("meeting_answers").option("path", path).option("what", what).load()


def listed_meetings(spark: SparkSession, path: str, sites: list[str] | None = None) -> DataFrame:
    """[UD2] site and the columns of portal_meetings() of all saved answers, or those of some sites."""
    rows = answers(spark, path)
    rows = rows if sites is None else rows.where(F.col("site").isin(*sites))
    return portal_meetings(rows.where("value is not null"), ["site"])
