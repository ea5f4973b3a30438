"""File sources: folders, archives and uploads, as rows (path, content, extension, size_kb)."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import paths as P
from tessera.functions import text as T
from tessera.sources import gitignore
from tessera.sources.encodings import decode

#: Below so many compressed bytes an entry's ratio isn't judged.
RATIO_FLOOR = 4096


class UnsafeArchive(ValueError):
    """An archive over a limit, or with an entry that would leave its folder."""


def _rows(raw: DataFrame, ignore: gitignore.Ignore | None) -> DataFrame:
    """Readable, not ignored, not blank rows of (path, content binary, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, decode(c), n) for p, c, n in zip(*(batch.column(i).to_pylist() for i in range(3))) if ignore is None or not ignore.ignored(p)]
            yield pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "content": [r[1] for r in rows], "n_bytes": [r[2] for r in rows]}, schema=pa.schema([("path", pa.string()), ("content", pa.string()), ("n_bytes", pa.int64())]))

    read = raw.where(P.readable("path")).select("path", "content", "n_bytes").mapInArrow(run, "path string, content string, n_bytes bigint")
    return read.where(T.not_blank("content")).select("path", "content", P.extension("path").alias("extension"), P.size_kb("n_bytes").alias("size_kb"))


def _bytes(spark: SparkSession, fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _walk(listing: Callable, root, ignore: gitignore.Ignore | None) -> tuple[list[str], list]:
    """Files of the supported kinds below ``root``: (paths, statuses of those whose own name begins with ``_`` or ``.``).

    Skipped and ignored folders are never listed.
    """
    plain, named, todo = [], [], [(root, "")]
    while todo:
        at, below = todo.pop()
        for s in listing(at):
            name = s.getPath().getName()
            if s.isDirectory():
                if name not in config.SKIPPED_DIRS and (ignore is None or not ignore.ignored(below + name, True)):
                    todo.append((s.getPath(), f"{below}{name}/"))
            elif name.lower().endswith(config.SUPPORTED_EXTENSIONS):
                if name[0] in "._":
                    named.append(s)
                else:
                    plain.append(s.getPath().toString())
    return plain, named


def _ignore_of(spark: SparkSession, fs, root) -> gitignore.Ignore | None:
    """The rules of the ignore file of ``root``, or of the only folder in it."""
    tops = [s.getPath().getName() for s in fs.listStatus(root)]
    for name in [".gitignore", *(f"{t}/.gitignore" for t in tops if len(tops) == 1)]:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name)):
            return gitignore.from_text(decode(_bytes(spark, fs, spark._jvm.org.apache.hadoop.fs.Path(root, name))))
    return None


def from_directory(spark: SparkSession, root: str, respect_gitignore: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Files below ``root``, their paths relative to it. Longer ones than ``max_bytes`` are passed over unread.

    The driver lists the tree, without what is skipped or ignored; the files are read in tasks, but for those of a name that
    begins with ``_`` or ``.`` (such as ``__init__.py``), which no reader takes: these, small as source files are, come by way of the driver.
    """
    prefix = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = prefix.getFileSystem(spark._jsc.hadoopConfiguration())
    ignore = _ignore_of(spark, fs, prefix) if respect_gitignore else None
    plain, named = _walk(fs.listStatus, prefix, ignore)
    rows = [(s.getPath().toString(), bytearray(_bytes(spark, fs, s.getPath())), s.getLen()) for s in named if max_bytes is None or s.getLen() <= max_bytes]
    found = spark.createDataFrame(rows, "path string, content binary, length bigint")
    if plain:
        found = found.unionByName(spark.read.format("binaryFile").load(plain).select("path", "content", "length"))
    base = fs.makeQualified(prefix).toString().rstrip("/")
    plain = base.split(":", 1)[1].lstrip("/") if ":" in base else base.lstrip("/")
    full = F.regexp_replace("path", r"^[a-z0-9+.-]+:/+", "")
    raw = found.select(F.substring(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), len(plain) + 2, 1 << 30).alias("path"), "content", F.col("length").alias("n_bytes"))
    if max_bytes is not None:
        raw = raw.where(F.col("n_bytes") <= max_bytes)
    return _rows(raw, ignore)


def check_archive(archive: zipfile.ZipFile, settings: config.Settings) -> None:
    """Judge an archive by its directory, before anything of it is unpacked."""
    entries = archive.infolist()
    if len(entries) > settings.max_zip_entries:
        raise UnsafeArchive(f"{len(entries)} entries; {settings.max_zip_entries} are allowed")
    total = 0
    for e in entries:
        total += e.file_size
        if total > settings.max_zip_mb << 20:
            raise UnsafeArchive(f"more than {settings.max_zip_mb} MB unpacked")
        if e.compress_size > RATIO_FLOOR and e.file_size / max(e.compress_size, 1) > settings.max_zip_ratio:
            raise UnsafeArchive(f"{e.filename}: packed more than {settings.max_zip_ratio} times")
        name = e.filename.replace("\\", "/")
        if name.startswith("/") or posixpath.normpath(name).split("/")[0] == ".." or ":" in name.split("/")[0]:
            raise UnsafeArchive(f"{e.filename} leaves the folder")


def unpack(content: bytes, settings: config.Settings) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files of an archive, in memory; its own ignore file applies."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        check_archive(archive, settings)
        names = {e.filename.replace("\\", "/"): e for e in archive.infolist() if not e.is_dir()}
        ignore = None
        if settings.respect_gitignore and (own := gitignore.find_root(list(names))):
            ignore = gitignore.from_text(decode(archive.read(names[own])))
        for name, e in names.items():
            if ignore is None or not ignore.ignored(name):
                yield posixpath.normpath(name), archive.read(e)


def from_archives(raw: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """File rows of archives in rows (content binary); an unsafe archive fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for path, data in unpack(content.as_py(), settings):
                    yield pa.RecordBatch.from_pydict({"path": [path], "content": [data], "n_bytes": [len(data)]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary()), ("n_bytes", pa.int64())]))

    rows = raw.select("content").mapInArrow(run, "path string, content binary, n_bytes bigint")
    return _rows(rows.withColumn("path", P.posix("path")), None)


def from_zip(spark: SparkSession, path: str, settings: config.Settings = config.Settings()) -> DataFrame:
    """File rows of the archives at ``path`` (a file, folder or pattern); one over the upload limit is refused unread."""
    found = spark.read.format("binaryFile").load(path)
    large = found.where(F.col("length") > settings.max_upload_mb << 20).select("path").first()
    if large:
        raise UnsafeArchive(f"{large[0]} has more than {settings.max_upload_mb} MB")
    return from_archives(found, settings)


def from_uploads(spark: SparkSession, uploads: list[tuple[str, bytes]], settings: config.Settings = config.Settings()) -> DataFrame:
    """File rows of uploads (name, content): archives (``.zip``) are unpacked, others need a supported extension only."""
    for name, content in uploads:
        if len(content) > settings.max_upload_mb << 20:
            raise UnsafeArchive(f"{name} has more than {settings.max_upload_mb} MB")
    plain = [(n.replace("\\", "/"), decode(c), len(c)) for n, c in uploads if not n.endswith(".zip")]
    rows = spark.createDataFrame(plain, "path string, content string, n_bytes bigint")
    rows = rows.where(P.extension("path").isin(*config.SUPPORTED_EXTENSIONS) & T.not_blank("content")).select("path", "content", P.extension("path").alias("extension"), P.size_kb("n_bytes").alias("size_kb"))
    packed = [(bytearray(c),) for n, c in uploads if n.endswith(".zip")]
    return rows.unionByName(from_archives(spark.createDataFrame(packed, "content binary"), settings)) if packed else rows
