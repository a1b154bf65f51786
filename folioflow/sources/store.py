"""[SRC17, SRC18, DT14] A store of files named by their content, and the rows that tell of them.

Files are written where the rows are: each task writes under a staged name, reads it back, and moves it into place. Rows are added
last, so what a failed job leaves is files without rows, which the next run finds in place and records. Folders may be in any file
system that pyarrow opens by its address; listings and hashes of what is stored are Spark's (binaryFile)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.tables import stored_rows

ROWS = "kind string, sha256 string, rel_path string, size long"
#: What kinds and extensions may be made of, and the name that carries a digest.
KIND, EXT = r"[a-z0-9][a-z0-9_-]*", r"[a-z0-9]{1,12}"
NAME = rf"^({KIND})-([0-9a-f]{{64}})\.({EXT})$"


class IntegrityError(RuntimeError):
    """Stored bytes aren't those that their name or row tells."""


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _digest(files: fs.FileSystem, path: str) -> str:
    found = hashlib.sha256()
    with files.open_input_stream(path) as f:
        while data := f.read(1 << 20):
            found.update(data)
    return found.hexdigest()


def _put(files: fs.FileSystem, root: str, name: str, data: bytes, sha: str) -> None:
    """Writes under a staged name, checks what was written, and moves it into place. A file that is there must hold these bytes."""
    path = f"{root}/{name}"
    there = files.get_file_info(path)
    if there.type == fs.FileType.NotFound:
        staged = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        try:
            with files.open_output_stream(staged) as f:
                f.write(data)
            if (written := _digest(files, staged)) != sha:
                raise IntegrityError(f"{name}: what was written hashes to {written}")
            files.move(staged, path)
        finally:
            if files.get_file_info(staged).type != fs.FileType.NotFound:
                files.delete_file(staged)
    elif there.type != fs.FileType.File or (held := _digest(files, path)) != sha:
        raise IntegrityError(f"{name} is no file" if there.type != fs.FileType.File else f"{name} holds other bytes, which hash to {held}; it isn't overwritten")


def store(blobs: DataFrame, root: str, rows_path: str) -> DataFrame:
    """[SRC17] Stores each of blobs (kind, ext, data) as {kind}-{sha256}.{ext} under root, adds the rows (ROWS) that rows_path lacks, and returns all rows.

    The same bytes are one file and one row, however often they come and in however many tasks; nothing is shuffled but rows. Other bytes under a
    name, bytes that are stored under another extension, and kinds or extensions that no name may hold raise IntegrityError, and then no row
    is added. Null data are no blob."""
    spark = blobs.sparkSession
    address = root.rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _opened(address)
        files.create_dir(folder, recursive=True)
        done: set[str] = set()
        for batch in batches:
            out = []
            for kind, ext, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "ext", "data"))):
                if not re.fullmatch(KIND, kind or "") or not re.fullmatch(EXT, ext or ""):
                    raise IntegrityError(f"no file may be named by the kind {kind!r} and the extension {ext!r}")
                sha = hashlib.sha256(data).hexdigest()
                name = f"{kind}-{sha}.{ext}"
                if name not in done:
                    _put(files, folder, name, data, sha)
                    done.add(name)
                    out.append((kind, sha, name, len(data)))
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "sha256", "rel_path", "size"), x)) for x in out], pa.schema([("kind", pa.string()), ("sha256", pa.string()), ("rel_path", pa.string()), ("size", pa.int64())]))

    held = stored_rows(spark, rows_path, spark.createDataFrame([], ROWS))
    given = blobs.where("data is not null").select("kind", "ext", F.col("data").cast("binary").alias("data"))
    digests = given.select("kind", F.sha2("data", 256).alias("sha256"), "ext").distinct()
    known = held.select("kind", "sha256", F.regexp_extract("rel_path", NAME, 3).alias("ext"))
    several = digests.unionByName(known).groupBy("kind", "sha256").agg(F.count_distinct("ext").alias("n"), F.min("ext").alias("a"), F.max("ext").alias("b")).where("n > 1").take(1)
    if several:
        raise IntegrityError(f"the same bytes ({several[0]['sha256']}) are asked for, or stored, as .{several[0]['a']} and .{several[0]['b']}")
    found = given.mapInArrow(put, ROWS).distinct()
    fresh = found.join(held.select("kind", "sha256"), ["kind", "sha256"], "left_anti")
    fresh.write.mode("append").parquet(rows_path)
    return spark.read.schema(ROWS).parquet(rows_path)


def stored_files(like: DataFrame, root: str) -> DataFrame:
    """rel_path, size, sha256 of the files under root, hashed by Spark where they lie; staged names (which begin with a dot) aren't listed."""
    spark = like.sparkSession
    address = root.rstrip("/")
    files, folder = _opened(address)
    there = [x for x in files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    inside = F.regexp_replace(F.col("path"), rf"^.*?\Q{folder.rstrip('/')}\E/", "")
    # binaryFile passes over empty files
    empty = spark.createDataFrame([(x.path[len(folder.rstrip("/")) + 1 :], 0, hashlib.sha256(b"").hexdigest()) for x in there if not x.size], "rel_path string, size long, sha256 string")
    if not any(x.size for x in there):
        return empty
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(address)
    return listed.select(inside.alias("rel_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).unionByName(empty)


def reconcile(rows: DataFrame, root: str) -> DataFrame:
    """[SRC18] finding, rel_path, told, found: rows whose file is missing, files without a row, and files that don't hold the bytes that
    their row, or else their name, tells. It only reports. rows: rel_path, sha256."""
    files = stored_files(rows, root).select("rel_path", F.col("sha256").alias("found"))
    both = rows.select("rel_path", F.col("sha256").alias("told"), F.lit(True).alias("recorded")).join(files, "rel_path", "full_outer")
    named = F.nullif(F.regexp_extract(F.element_at(F.split("rel_path", "/"), -1), NAME, 2), F.lit(""))
    told = F.coalesce("told", named)
    finding = F.when(F.col("found").isNull(), "missing").when(told != F.col("found"), "changed").when(F.col("recorded").isNull(), "unrecorded")
    return both.select(finding.alias("finding"), "rel_path", told.alias("told"), "found").where("finding is not null")


def verified(citations: DataFrame, rows: DataFrame, root: str) -> DataFrame:
    """[DT14] citations (kind, sha256, ...) with verified: a row tells of the artifact, and its file still hashes to the digest that is cited."""
    sound = rows.join(stored_files(rows, root).select("rel_path", F.col("sha256").alias("found")), "rel_path").where("sha256 = found")
    told = sound.select("kind", "sha256", F.lit(True).alias("_sound")).distinct()
    return citations.join(told, ["kind", "sha256"], "left").withColumn("verified", F.coalesce("_sound", F.lit(False))).drop("_sound")
