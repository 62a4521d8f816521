"""ZIP archives as rows of entries, and the lookup of entries by the names that references use."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "book_id string, pos int, name string, method int, csize long, usize long, data binary, error string"
#: Stored and deflated entries can be read.
METHODS = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)


def opened(content: bytes) -> zipfile.ZipFile:
    """An archive; of one whose directory breaks off, the entries up to there. Without an end record it is none."""
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        end = content.rfind(b"PK\5\6")
        if end < 0 or end + 20 > len(content):
            raise
    start = at = struct.unpack_from("<I", content, end + 16)[0]
    count = 0
    while content[at : at + 4] == b"PK\1\2" and at + 46 <= len(content):
        after = at + 46 + sum(struct.unpack_from("<3H", content, at + 28))
        if after > len(content):
            break
        count, at = count + 1, after
    whole = content[:at] + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, count, count, at - start, start, 0)
    return zipfile.ZipFile(io.BytesIO(whole))


def scan_archive(content: bytes | None, wanted: str | None = None) -> Iterator[tuple]:
    """(pos, name, method, csize, usize, data, error) of each entry that isn't a folder; data only if its name is wanted."""
    import re

    try:
        z = opened(content or b"")
    except (zipfile.BadZipFile, ValueError, OSError, struct.error) as e:
        yield (0, None, None, None, None, None, f"not an archive: {e}")
        return
    for i, e in enumerate(x for x in z.infolist() if not x.is_dir()):
        data = error = None
        if e.compress_type not in METHODS:
            error = f"compression method {e.compress_type} is not supported"
        elif wanted is None or re.search(wanted, e.filename):
            try:
                data = z.read(e)
            except Exception as x:  # one broken entry is that entry's error
                error = f"{type(x).__name__}: {x}"
        yield (i, e.filename, e.compress_type, e.compress_size, e.file_size, data, error)


def zip_entries(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """Entries of ``files(book_id, content)``; ``wanted``, a regex of names, keeps other entries from being inflated.

    A file that is no archive gives one row with an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            for book, content in zip(b.column(0), b.column(1), strict=True):
                rows = [(book.as_py(), *r) for r in scan_archive(content.as_py(), wanted)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select(F.col("book_id").cast("string"), "content").mapInArrow(run, SCHEMA)


def _decoded(name: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def resolve(refs: DataFrame, entries: DataFrame, path: str = "path") -> DataFrame:
    """``refs(book_id, path, ...)`` with ``entry``: the name of the entry that a path means, or null.

    Tried in turn: the name itself, any case, decoded, decoded in any case; of several in any case the first counts.
    """
    names = entries.where("name is not null").select("book_id", "name", "pos")
    first = names.withColumn("low", F.lower("name")).withColumn("k", F.row_number().over(Window.partitionBy("book_id", "low").orderBy("pos"))).where("k = 1")
    exact = names.select("book_id", F.col("name").alias("_key"), F.col("name").alias("_hit"))
    low = first.select("book_id", F.col("low").alias("_key"), F.col("name").alias("_hit"))
    bare = F.regexp_replace(F.col(path), "^/+", "")
    out = refs
    for i, (keys, key) in enumerate(((exact, bare), (low, F.lower(bare)), (exact, _decoded(bare)), (low, F.lower(_decoded(bare))))):
        out = out.withColumn("_key", key).join(keys.withColumnRenamed("_hit", f"_hit{i}").dropDuplicates(["book_id", "_key"]), ["book_id", "_key"], "left").drop("_key")
    return out.withColumn("entry", F.coalesce(*[f"_hit{i}" for i in range(4)])).drop(*[f"_hit{i}" for i in range(4)])


def read_resource(files: DataFrame, href: str) -> DataFrame:
    """(book_id, name, data) of one entry of each archive; nothing for blank names and those with '..' in them."""
    parts = href.replace("\\", "/").split("/")
    if not href.strip() or ".." in parts:
        return zip_entries(files.limit(0)).select("book_id", "name", "data")
    entries = zip_entries(files)
    hit = resolve(entries.select("book_id").distinct().withColumn("path", F.lit(href)), entries).where("entry is not null")
    return hit.select("book_id", F.col("entry").alias("name")).join(entries.select("book_id", "name", "data"), ["book_id", "name"])
