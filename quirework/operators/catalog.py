"""The book catalog: versioned Parquet tables with insert, update, delete, migration and lookups."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.text import cover_url, file_kind, strip
from quirework.plans.staging import stage

#: The columns of a catalog row.
COLUMNS = ("title", "author", "description", "cover_img", "source_path", "stored_path", "file_name", "size", "file_type", "directory_entries", "created_at")
SCHEMA = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.StringType()) for c in COLUMNS)])
#: What an update may set.
UPDATABLE = ("title", "author", "description", "cover_img", "directory_entries")


def migrate(df: DataFrame) -> DataFrame:
    """The catalog's columns of any older table; what it lacks is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def list_books(books: DataFrame) -> DataFrame:
    return books.orderBy(F.desc("created_at"), F.desc("id"))


def get_book(books: DataFrame, book_id: int) -> DataFrame:
    return books.where(F.col("id") == book_id)


def insert_books(books: DataFrame, new: DataFrame) -> DataFrame:
    """The table with new rows: missing values are '', ids go on from the largest one in the order of created_at, stored_path.

    Only new rows are numbered.
    """
    top = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).select("m").scalar()
    ordered = numbered(migrate(new).fillna("", list(COLUMNS)), F.asc("created_at"), F.asc("stored_path"))
    return migrate(books).unionByName(migrate(ordered.withColumn("id", top + F.col("_place"))))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds _place, from 1, by an order of all rows; no partition holds more than its range of them.

    The ranges are written once: bounds come from a sample and small ranges are merged, so that a second run of the same
    plan, for the counts, would have others.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("_row", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_row", 33).alias("_p")).agg(F.count("*").alias("_n"))
    # One row for each partition
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    joined = placed.withColumn("_p", F.shiftright("_row", 33)).join(F.broadcast(before), "_p")
    return joined.withColumn("_place", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_row", "_before")


def listed(books: DataFrame) -> DataFrame:
    """All books with their place in the order of list_books."""
    return numbered(books, F.desc("created_at"), F.desc("id")).withColumnRenamed("_place", "place")


def by_content(files: DataFrame) -> DataFrame:
    """(name, n, first_id, bytes) of ``files(id, data)``: one for each content, named by its SHA-1; where a store writes it once."""
    return files.groupBy(F.sha1("data").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max(F.octet_length("data")).cast("long").alias("bytes"))


def resolve_cover(new: Column, old: Column, is_ebook: Column) -> Column:
    """A blank new cover of an e-book keeps the old one; others are trimmed."""
    return F.when(new.isNull(), old).when((strip(new) == "") & is_ebook, old).otherwise(strip(new))


def update_books(books: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after partial updates: ``changes`` has an id and any of UPDATABLE; null means no change."""
    given = [c for c in UPDATABLE if c in changes.columns]
    joined = books.join(changes.select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in given]), "id", "left")
    ebook = file_kind(F.coalesce("stored_path", F.lit(""))) != ""
    value = {c: resolve_cover(F.col("_new_cover_img"), F.col("cover_img"), ebook) if c == "cover_img" else F.coalesce(f"_new_{c}", c) for c in given}
    return joined.select(*[value.get(f.name, F.col(f.name)).alias(f.name) for f in SCHEMA])


def delete_books(books: DataFrame, ids: DataFrame) -> DataFrame:
    return books.join(ids.select("id"), "id", "left_anti").select(*SCHEMA.names)


def default_cover(row_id: Column, cover: Column, stored_path: Column) -> Column:
    """E-books without a cover get the address of the one in the file."""
    blank = F.coalesce(cover, F.lit("")) == ""
    return F.when(blank & (file_kind(stored_path) != ""), F.concat(F.lit("/book-cover?id="), row_id.cast("string"))).otherwise(F.coalesce(cover, F.lit("")))


def enrich(books: DataFrame, parsed: DataFrame) -> DataFrame:
    """Blank titles, authors and descriptions from ``parsed(id, title, author, description)``."""
    names = ("title", "author", "description")
    joined = books.join(parsed.select("id", *[F.col(n).alias(f"_p_{n}") for n in names]), "id", "left")
    fill = {n: F.coalesce(F.when(F.col(n) != "", F.col(n)), F.col(f"_p_{n}"), F.lit("")) for n in names}
    return joined.select(*[fill.get(f.name, F.col(f.name)).alias(f.name) for f in SCHEMA])


def as_api(books: DataFrame, base: str = "") -> DataFrame:
    """Rows as clients see them: camel case, '' for null, covers resolved, the source kept."""
    camel = lambda c: "".join(p if i == 0 else p.title() for i, p in enumerate(c.split("_")))
    out = [F.coalesce(c, F.lit("")).alias(camel(c)) for c in COLUMNS if c != "cover_img"]
    cover = F.coalesce("cover_img", F.lit(""))
    return books.select("id", *out, cover_url(cover, base).alias("coverImg"), cover.alias("coverImgSource"))


class Catalog:
    """A catalog in a folder: each change writes a new version, and readers take the newest. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self.fs.exists(self.fs_path):
            return []
        done = [s.getPath() for s in self.fs.listStatus(self.fs_path)]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit() and self.fs.exists(path(p, "_SUCCESS")))

    def books(self) -> DataFrame:
        v = self.versions()
        return migrate(self.spark.read.parquet(f"{self.folder}/v{v[-1]}")) if v else self.spark.createDataFrame([], SCHEMA)

    def _write(self, df: DataFrame) -> DataFrame:
        v = (self.versions() or [0])[-1] + 1
        df.write.parquet(f"{self.folder}/v{v}")
        return self.books()

    def insert(self, new: DataFrame) -> DataFrame:
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        stamped = new if "created_at" in new.columns else new.withColumn("created_at", F.lit(now))
        return self._write(insert_books(self.books(), stamped))

    def update(self, changes: DataFrame) -> DataFrame:
        return self._write(update_books(self.books(), changes))

    def delete(self, ids: DataFrame) -> DataFrame:
        return self._write(delete_books(self.books(), ids))

    def get(self, book_id: int) -> DataFrame:
        return get_book(self.books(), book_id)

    def list(self) -> DataFrame:
        return list_books(self.books())
