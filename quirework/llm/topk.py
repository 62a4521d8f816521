"""Exact top-k search by BM25: an inverted index with block maxima, pruned by block-max WAND in each shard.

A first pass indexes every document and all its terms: some hundred documents become one segment, a row with their ids
and lengths, the sorted terms, their postings by blocks of aligned document numbers, and for each block of a term the
largest count and the shortest document, written with the index. Document count, average length and document
frequencies are sums over all segments. A second pass scores with these global figures: from the blocks' maxima alone a
shard bounds what each block of documents can score for a query, and only blocks whose bound reaches the k-th best score
so far have their postings read. The shards' best are merged. Queries are taken in blocks of a bounded number.

Scores are sums of whole millionths, one for each posting, so that ties are exact and the order of sums is no matter.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch

K1, B = 1.2, 0.75
#: Documents in a block and in a segment, and queries that are read by the driver at a time.
BLOCK, SEGMENT, QUERIES = 64, 512, 2000


def terms(text: str | None) -> list[bytes]:
    """Words, split at space and U+0009..U+000D, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def idf(n: int, df: int) -> float:
    return math.log(1.0 + (n - df + 0.5) / (df + 0.5))


_ARRAYS = {"lengths": np.int32, "ends": np.int32, "places": np.uint16, "tfs": np.int32, "block_ends": np.int32, "block_numbers": np.uint16, "block_tfs": np.int32, "block_lengths": np.int32}


def segment_of(texts: list[str | None]) -> dict[str, bytes]:
    """The index of some documents: terms, joined by line ends, and the arrays of _ARRAYS.

    ends and block_ends are by term: up to where its postings, and its blocks, go. A block's postings are those whose
    places, document numbers, fall into it.
    """
    number: dict[bytes, int] = {}
    lengths = np.zeros(len(texts), np.int32)
    term, place, tf = array("q"), array("i"), array("i")
    for i, text in enumerate(texts):
        counts = Counter(terms(text))
        lengths[i] = counts.total()
        term.extend(number.setdefault(t, len(number)) for t in counts)
        place.extend(repeat(i, len(counts)))
        tf.extend(counts.values())
    names = sorted(number)
    rank = np.empty(len(names), np.int64)
    rank[[number[t] for t in names]] = np.arange(len(names))
    by = rank[np.array(term, np.int64)] if term else np.zeros(0, np.int64)
    order = np.argsort(by, kind="stable")
    by, places, tfs = by[order], np.array(place, np.int32)[order], np.array(tf, np.int32)[order]
    key = by * (1 + len(texts) // BLOCK) + places // BLOCK
    first = np.flatnonzero(np.diff(key, prepend=-1))
    arrays = {
        "lengths": lengths, "ends": np.cumsum(np.bincount(by, minlength=len(names))), "places": places, "tfs": tfs,
        "block_ends": np.cumsum(np.bincount(by[first], minlength=len(names))), "block_numbers": places[first] // BLOCK,
        "block_tfs": np.maximum.reduceat(tfs, first) if len(first) else tfs, "block_lengths": np.minimum.reduceat(lengths[places], first) if len(first) else tfs,
    }
    return {"terms": b"\n".join(names)} | {c: np.ascontiguousarray(x, _ARRAYS[c]).tobytes() for c, x in arrays.items()}


def build_segments(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per segment: ids, terms, the arrays of _ARRAYS, and n and total, its documents and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SEGMENT):
                b = whole.slice(at, SEGMENT)
                made = segment_of(b.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([b.column(0)]))
                total = int(np.frombuffer(made["lengths"], np.int32).sum(dtype=np.int64))
                yield pa.record_batch([ids, *(pa.array([x], pa.binary()) for x in made.values()), pa.array([b.num_rows], pa.int64()), pa.array([total], pa.int64())], names=["ids", *made, "n", "total"])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"{c} binary" for c in ("terms", *_ARRAYS))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"ids array<{kind}>, {columns}, n long, total long")


class Segment:
    """One segment, of which postings are read block by block."""

    def __init__(self, terms: bytes, idfs: dict[bytes, float], average: float, ids: list | None = None, **arrays: bytes):
        self.names = terms.split(b"\n") if terms else []
        self.ids, self.idfs, self.average = ids or [], idfs, average
        for c, raw in arrays.items():
            setattr(self, c, np.frombuffer(raw, _ARRAYS[c]))
        self.n_blocks = -(-len(self.ids) // BLOCK)

    def find(self, term: bytes) -> int | None:
        at = bisect_left(self.names, term)
        return at if at < len(self.names) and self.names[at] == term else None

    def frequency(self, at: int) -> int:
        return int(self.ends[at] - (self.ends[at - 1] if at else 0))

    def impact(self, term: bytes, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Millionths; never less for a larger count or a shorter document."""
        tf = tf.astype(np.float64)
        return np.floor(1e6 * self.idfs[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.average)) + 0.5).astype(np.int64)

    def search(self, query: dict[bytes, int], best: list, k: int, counts: list[int]) -> None:
        """Improves ``best``, a heap of at most k of (score, order of the id, id); counts: blocks of postings read, and all."""
        bounds, held = np.zeros(self.n_blocks, np.int64), []
        for t, n in query.items():
            if (at := self.find(t)) is None:
                continue
            lo, hi = (int(self.block_ends[at - 1]) if at else 0), int(self.block_ends[at])
            bounds[self.block_numbers[lo:hi]] += n * self.impact(t, self.block_tfs[lo:hi], self.block_lengths[lo:hi])
            held.append((t, n, at, lo, hi))
            counts[1] += hi - lo
        for b in np.argsort(-bounds, kind="stable").tolist():
            # A block whose maxima only equal the k-th best may hold a tie with a smaller id
            if not bounds[b] or len(best) == k and bounds[b] < best[0][0]:
                break
            base, score = b * BLOCK, np.zeros(BLOCK, np.int64)
            for t, n, at, lo, hi in held:
                here = lo + int(np.searchsorted(self.block_numbers[lo:hi], b))
                if here < hi and self.block_numbers[here] == b:
                    counts[0] += 1
                    s, e = (int(self.ends[at - 1]) if at else 0), int(self.ends[at])
                    s, e = s + np.searchsorted(self.places[s:e], [base, base + BLOCK])
                    place = self.places[s:e]
                    score[place - base] += n * self.impact(t, self.tfs[s:e], self.lengths[place])
            for i in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)).tolist():
                hit = (int(score[i]), _Late(self.ids[base + i]))
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)


class _Late:
    """Ids so ordered that a smaller one is better; null is the worst."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: _Late) -> bool:
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Late) and self.id == other.id


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score) for ``queries(query_id, text)``: the k best rows of ``docs`` that share a term.

    Scores are in millionths; ties go to the smaller id, null ids come last, and repeated rows are hits of their own.
    Null and empty texts on either side match nothing, and neither do queries with a null id; a term that a query
    repeats counts as often. Queries are the stated side: the driver reads QUERIES of them at a time; documents never.
    Other columns of either side are of no matter. Empty input: empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "topk")
    segments = scratch.save(build_segments(docs, id_col, text_col), "segments")
    n, total = segments.agg(F.sum("n"), F.sum("total")).first()
    average = (total or 0) / n if n and total else 1.0
    asked = queries.where("query_id is not null").select("query_id", "text")
    blocks = max(1, -(-asked.count() // QUERIES))
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ("ids", "terms", *_ARRAYS)
    found = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        numbered = [(r.query_id, {t: c for t, c in sorted(Counter(terms(r.text)).items())}) for r in part]
        vocabulary = sorted({t for _, q in numbered for t in q})

        def frequencies(batches: Iterator[pa.RecordBatch], vocabulary=vocabulary) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                    seg = Segment(row["terms"], {}, 1.0, ends=row["ends"])
                    hits = [(i, seg.frequency(at)) for i, t in enumerate(vocabulary) if (at := seg.find(t)) is not None]
                    yield pa.record_batch([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["t", "df"])

        df = {r.t: r.df for r in segments.select("terms", "ends").mapInArrow(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}
        idfs = {t: idf(n or 0, int(df.get(i, 0))) for i, t in enumerate(vocabulary)}

        def run(batches: Iterator[pa.RecordBatch], numbered=numbered, idfs=idfs) -> Iterator[pa.RecordBatch]:
            best: dict = {i: [] for i in range(len(numbered))}
            counts = [0, 0]
            for b in batches:
                for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                    seg = Segment(row["terms"], idfs, average, row["ids"], **{c: row[c] for c in _ARRAYS})
                    for i, (_, q) in enumerate(numbered):
                        seg.search(q, best[i], k, counts)
            hits = [(numbered[i][0], h.id, s) for i, held in best.items() for s, h in held]
            if hits:
                yield pa.record_batch([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.int64())], names=["query_id", "id", "score"])

        found.append(scratch.save(segments.select(*columns).mapInArrow(run, f"query_id long, id {kind}, score long"), f"hits{block}"))
    scratch.drop("segments")
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
