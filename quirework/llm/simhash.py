"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius. Two fingerprints within the radius share
such a variant, so a shuffle on variants finds every pair; at radius 2 a variant is met by 65 distinct fingerprints
at most, whatever the data, because copies are folded into one fingerprint first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, connected_components

BITS = 64
#: The ids of the shingle hash.
SEED = 42


def votes(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    on = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for null, empty and blank texts.

    A-Z is lower-cased, words are runs of anything but space and U+0009..U+000D, shingles count as often as they occur.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle)), strict=False)) if len(parts) >= shingle else [b" ".join(parts)]
    return votes(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def ball(fp: Column, radius: int) -> Column:
    """Array of all fingerprints within ``radius`` bits of fp."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]
    return F.array(*[fp.bitwiseXOR(F.lit(m - (1 << BITS) if m >> 63 else m).cast("long")) for m in masks])


def ball_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links within ``radius`` bits that connect all rows of ``distinct(fp)`` that are so near."""
    met = distinct.select("fp", F.explode(ball(F.col("fp"), (radius + 1) // 2)).alias("variant"))
    # All members of a variant's ball are linked through its smallest one only if that one is within the radius; at
    # half of 2 any two members are. At radius 1 the check below drops what is not, and each pair meets at its own ends.
    least = met.withColumn("b", F.min("fp").over(Window.partitionBy("variant"))) if radius == 2 else met.withColumn("b", F.col("variant"))
    pairs = least.where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    if radius == 1:
        pairs = pairs.join(distinct.select(F.col("fp").alias("b")), "b", "left_semi")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; component_id is the smallest id that links reach, its own included.

    Texts without words have fingerprint zero and are linked like any other. Repeated rows and ties fall together;
    null ids are kept and get the smallest known id of their group (null if there is none). Empty input: empty result.
    Radius 2 (or 1) is supported exactly; the ball of half of it has 65 members.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.save(fingerprints(docs, id_col, text_col, shingle), "fps")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    parts = connected_components(ball_links(distinct, radius), scratch)
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = scratch.save(named, "named")
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = named.join(firsts, "component").select("fp", "component_id")
    return fps.join(names, "fp").select("id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 2) -> DataFrame:
    """``docs(doc_id, text, ...)`` without all but one document of each group of near-duplicates.

    The smallest doc_id stays, null being the largest; of rows that tie, the one whose texts' hash is smallest, and of
    rows that repeat all that, one. Texts without words are one group.
    """
    key = F.xxhash64("doc_id", "text", F.lit(5))
    keyed = docs.withColumn("_qw_key", key)
    slim = keyed.select("_qw_key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_qw_key").alias("_qw_place"), "text")
    # The place is the id by which groups are named: its smallest member is the one that stays
    groups = near_duplicates(slim, "_qw_place", "text", shingle, radius)
    stay = groups.select(F.col("component_id._qw_key").alias("_qw_key")).distinct()
    kept = keyed.join(stay, "_qw_key", "left_semi")
    return kept.dropDuplicates(["_qw_key"]).select(*docs.columns)
