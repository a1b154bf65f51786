"""[SRC21] A sink that exports rows as jsonl, csv, ics or zip: part files under staged names, moved into place when all are written.

    spark.dataSource.register(CivicExport)
    rows.write.format("civic_export").option("path", folder).option("kind", "csv").mode("append").save()

Each task writes its own part, so nothing passes through the driver but names and counts. If a task fails for good, what was staged is deleted and
no part appears; parts of earlier exports stay. csv parts have a head each; a zip part holds one jsonl file; ics rows need uid, starts_at and title."""

from __future__ import annotations

import csv
import datetime
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

KINDS = ("jsonl", "csv", "ics", "zip")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _json(row: dict) -> str:
    return json.dumps({k: _plain(v) for k, v in row.items()}, ensure_ascii=False) + "\n"


def _folded(line: str) -> str:
    """A calendar's line in pieces of at most 75 bytes, each further one after a blank; no character is cut."""
    out, held = [], b""
    for c in line:
        b = c.encode("utf-8")
        if len(held) + len(b) > 75:
            out.append(held)
            held = b" "
        held += b
    return b"\r\n".join([*out, held]).decode() + "\r\n"


def _event(row: dict) -> str:
    escaped = lambda s: str(s).replace("\\", "\\\\").replace(";", "\\;").replace(",", "\\,").replace("\n", "\\n")
    at = row["starts_at"]
    if not isinstance(at, datetime.datetime):
        at = datetime.datetime.fromisoformat(str(at))
    stamp = at.astimezone(datetime.UTC).strftime("%Y%m%dT%H%M%SZ") if at.tzinfo else at.strftime("%Y%m%dT%H%M%S")
    lines = ["BEGIN:VEVENT", f"UID:{escaped(row['uid'])}", f"DTSTART:{stamp}", f"SUMMARY:{escaped(row['title'] or '')}", "END:VEVENT"]
    return "".join(map(_folded, lines))


@dataclass
class Part(WriterCommitMessage):
    staged: str
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, columns: list[str], run: str):
        self.path, self.kind, self.columns, self.run = path.rstrip("/"), kind, columns, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():05d}-{self.run}.{self.kind}"
        staged = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"  # tries of one task don't meet
        n = 0
        try:
            with files.open_output_stream(staged) as raw:
                n = self._fill(raw, iterator)
        except BaseException:
            if files.get_file_info(staged).type == fs.FileType.File:
                files.delete_file(staged)
            raise
        return Part(staged, f"{folder}/{name}", n)

    def _fill(self, raw, iterator: Iterator[pa.RecordBatch]) -> int:
        n = 0
        rows = (row for batch in iterator for row in batch.to_pylist())
        if self.kind == "zip":
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open("rows.jsonl", "w", force_zip64=True) as f:
                for n, row in enumerate(rows, 1):
                    f.write(_json(row).encode())
            return n
        put = lambda text: raw.write(text.encode("utf-8"))
        if self.kind == "csv":
            line = io.StringIO(newline="")
            writer = csv.writer(line)

            def told(values: list) -> str:
                line.seek(0), line.truncate()
                writer.writerow(values)
                return line.getvalue()

            put(told(self.columns))
            for n, row in enumerate(rows, 1):
                put(told([_plain(row[c]) if not isinstance(row[c], (list, dict)) else _json({"v": row[c]})[6:-2] for c in self.columns]))
        elif self.kind == "ics":
            put("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//folioflow//export//EN\r\n")
            for n, row in enumerate(rows, 1):
                put(_event(row))
            put("END:VCALENDAR\r\n")
        else:
            for n, row in enumerate(rows, 1):
                put(_json(row))
        return n

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _opened(self.path)
        for m in filter(None, messages):
            if m.rows:
                files.move(m.staged, m.name)
            else:
                files.delete_file(m.staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _ = _opened(self.path)
        for m in filter(None, messages):
            for path in (m.staged, m.name):
                if files.get_file_info(path).type == fs.FileType.File:
                    files.delete_file(path)


class CivicExport(DataSource):
    """Options: path; kind (jsonl, csv, ics or zip)."""

    @classmethod
    def name(cls) -> str:
        return "civic_export"

    def schema(self) -> str:
        raise NotImplementedError("civic_export only writes")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        kind, path = self.options.get("kind", "jsonl"), self.options.get("path")
        if kind not in KINDS or not path:
            raise ValueError(f"civic_export needs a path, and kind as one of {', '.join(KINDS)}")
        if overwrite:
            raise ValueError("civic_export only appends: parts of earlier exports aren't its own to delete")
        if kind == "ics" and not {"uid", "starts_at", "title"} <= set(schema.names):
            raise ValueError("ics needs the columns uid, starts_at and title")
        return _Writer(path, kind, list(schema.names), uuid.uuid4().hex[:8])


def export(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Exports rows as parts under path."""
    rows.sparkSession.dataSource.register(CivicExport)
    rows.write.format("civic_export").option("path", path).option("kind", kind).mode("append").save()
