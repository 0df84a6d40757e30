"""Files in any store that Spark reaches, by its own file systems.

Reports and uploads are small and go through the driver with their digest made on the way. Results are
folders of part files; tasks digest those, and the driver gets one row a file.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

CHUNK = 1 << 20
#: Part files up to this size are digested in tasks, which hold a file whole; the driver streams larger ones.
PART = 512 << 20


def opened(spark: SparkSession, path: str):
    """(file system, its path)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put(spark: SparkSession, chunks, path: str, most_bytes: int | None = None) -> tuple[str, int]:
    """Write chunks of bytes to a file, which has its name only when it is whole: (digest, size). A file
    that is there already is replaced."""
    store, target = opened(spark, path)
    _, part = opened(spark, f"{path}.part")
    digest, size, whole = hashlib.sha256(), 0, False
    out = store.create(part, True)
    try:
        try:
            for chunk in chunks:
                size += len(chunk)
                if most_bytes is not None and size > most_bytes:
                    raise ValueError("Upload exceeds the size limit")
                digest.update(chunk)
                out.write(bytearray(chunk))
        finally:
            out.close()
        store.delete(target, False)
        whole = store.rename(part, target)
        if not whole:
            raise OSError(f"cannot write {path}")
    finally:
        if not whole:
            store.delete(part, False)
    return digest.hexdigest(), size


def put_stream(spark: SparkSession, stream, path: str, most_bytes: int) -> tuple[str, int]:
    return put(spark, iter(lambda: stream.read(CHUNK), b""), path, most_bytes)


def put_text(spark: SparkSession, text: str, path: str) -> tuple[str, int]:
    data = text.encode("utf-8")
    return put(spark, (data[i : i + CHUNK] for i in range(0, len(data), CHUNK)), path)


def read_bytes(spark: SparkSession, path: str):
    """The chunks of a file."""
    store, where = opened(spark, path)
    source = store.open(where)
    try:
        while chunk := bytes(source.readNBytes(CHUNK)):
            yield chunk
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder shows, in order: no hidden names."""
    store, where = opened(spark, folder)
    found = (f.getPath().getName() for f in store.listStatus(where))
    return sorted(n for n in found if n[0] not in "._")


def parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a result folder in order of their names, folders inside included."""
    store, where = opened(spark, folder)
    found = []
    for f in store.listStatus(where):
        name = f.getPath().getName()
        if name[0] not in "._":
            found += parts(spark, f.getPath().toString()) if f.isDirectory() else [(f.getPath().toString(), f.getLen())]
    return sorted(found)


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, digest) of files, made in tasks."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("digest"))


def checksum(spark: SparkSession, path: str) -> tuple[str, int]:
    """Digest and size of a file, or of the part files of a folder: the digest of their digests in the
    order of their names."""
    store, where = opened(spark, path)
    whole = store.getFileStatus(where)
    if whole.isFile():
        return streamed(spark, path), whole.getLen()
    found = parts(spark, path)
    key = lambda p: opened(spark, p)[1].toUri().getPath()
    small = [p for p, size in found if 0 < size <= PART]  # empty files are no rows of a scan
    sums = {key(r["path"]): r["digest"] for r in digests(spark, small).collect()} if small else {}  # a row a file
    sums |= {key(p): streamed(spark, p) for p, size in found if not 0 < size <= PART}
    return hashlib.sha256("".join(sums[key(p)] for p, _ in found).encode()).hexdigest(), sum(size for _, size in found)


def streamed(spark: SparkSession, path: str) -> str:
    digest = hashlib.sha256()
    for chunk in read_bytes(spark, path):
        digest.update(chunk)
    return digest.hexdigest()


def contained(spark: SparkSession, path: str, root: str) -> str:
    """The full path, if it lies below the root in the same store. Dots are resolved; links of a local
    disk are followed."""
    store, where = opened(spark, path)
    full, top = (store.makeQualified(w).toUri().normalize() for w in (where, opened(spark, root)[1]))
    if (full.getScheme(), full.getAuthority()) != (top.getScheme(), top.getAuthority()) or not full.getPath().startswith(top.getPath().rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    if full.getScheme() == "file":
        files.contained(full.getPath(), top.getPath())
    return full.toString()
