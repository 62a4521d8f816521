"""Hierarchical multi-length packing of token sequences.

Context sizes are tiers (powers of two). A document gives as many full windows of the largest tier as it holds; the
rest is routed to the smallest tier that takes it. Windows are opened longest document first, each in its own tier, and
the gap is filled from shorter tiers: the longest piece that fits, again and again, and at last a cut of the shortest
piece. Thus every window is exactly full; only what is left at the end of a partition is dealt out to sequences whose
lengths are the powers of two of its size, which need no padding either. Windows of one tier are gathered in step
groups of equal token totals.

Each input partition packs its own documents in one pass, so there is no shuffle, no hot key and no global counter, and
a partition that is lost is packed again alike.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Before a space that follows something else than white space, no token spans the cut.
_CUT = re.compile(r"(?<=\S)(?= )")
_TWO = re.compile(r"\s ")
#: Longest part, in characters, that is remembered; a text without spaces is one part, which seldom comes again.
LONGEST = 64
#: Characters that both libraries class alike for certain.
_PLAIN = re.compile("[\n\x20-\x7eÀ-ɏ]*")


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes.

    Texts are cut where no token can span, and short parts are remembered (``max_parts`` and LONGEST bound the memory, not the result).
    With ``ranks_file`` and ``pattern``, the same vocabulary as ranks, plain parts take the faster library; parts with
    special strings or other characters always take the tokenizers library.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None, max_parts: int = 200_000):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_file and pattern:
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.max_parts = max_parts
        self.heads = _Parts(self, "")
        self.tails = _Parts(self, " ")

    def ids(self, part: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(part) and not any(s in part for s in self.special):
            return self.fast.encode_ordinary(part)
        return self.slow.encode(part, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        for p in (self.heads, self.tails):
            if len(p) > self.max_parts:
                p.clear()
        if not text:
            return b""
        if _TWO.search(text):
            return b"".join(map(self.heads.__getitem__, _CUT.split(text)))
        head, *tail = text.split(" ")
        return self.heads[head] + b"".join(map(self.tails.__getitem__, tail))


class _Parts(dict):
    """Ids by part; a part may stand for itself with one space before it."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.ids(self.before + part) if self.before + part else []
        out = b"".join(x.to_bytes(4, "little") for x in ids)
        if len(part) <= LONGEST:
            self[part] = out
        return out


class Packer:
    """Packs the documents of one partition; ``rows`` gathers (doc, start, length, crc, doc_tokens, sequence, offset, tier, step)."""

    def __init__(self, first_id: int, tiers: tuple[int, ...], pool_tokens: int, step_tokens: int):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers = sorted(tiers)
        self.pool: list[tuple] = []  # (length, order, doc, start, doc tokens, ids), sorted
        self.held = self.order = self.sequences = self.steps = 0
        self.first_id, self.pool_tokens, self.step_tokens = first_id, pool_tokens, step_tokens
        self.open_steps: dict[int, list[int]] = {}
        self.rows: list[tuple] = []

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, doc, ids: bytes) -> None:
        n, top = len(ids) // 4, self.tiers[-1]
        whole = n - n % top
        for at in range(0, whole, top):
            self._emit([(top, 0, doc, at, n, ids[4 * at : 4 * (at + top)])], top)
        if whole < n:
            self._hold(doc, whole, n, ids[4 * whole :])
        if self.held >= self.pool_tokens:
            self._pack(last=False)

    def close(self) -> None:
        self._pack(last=True)

    def _hold(self, doc, start: int, total: int, ids: bytes) -> None:
        insort(self.pool, (len(ids) // 4, self.order, doc, start, total, ids), key=lambda p: p[:2])
        self.order += 1
        self.held += len(ids) // 4

    def _take(self, at: int) -> tuple:
        piece = self.pool.pop(at)
        self.held -= piece[0]
        return piece

    def _head(self, piece: tuple, n: int) -> tuple:
        """The first n tokens of a piece; the rest goes back to the pool."""
        length, order, doc, start, total, ids = piece
        if n < length:
            self._hold(doc, start + n, total, ids[4 * n :])
        return (n, order, doc, start, total, ids[: 4 * n])

    def _pack(self, last: bool) -> None:
        while self.pool:
            window = [self._take(len(self.pool) - 1)]
            size = self.tier(window[0][0])
            gap = size - window[0][0]
            while gap and self.pool:
                at = bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
                piece = self._take(at) if at >= 0 else self._head(self._take(0), gap)
                window.append(piece)
                gap -= piece[0]
            if not gap:
                self._emit(window, size)
            elif last:
                self._tail(window)
            else:
                for p in window:
                    self._hold(*p[2:])
                return

    def _tail(self, window: list[tuple]) -> None:
        """Deals what is left out to sequences of the powers of two of its size."""
        rest = sum(p[0] for p in window)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            rest -= size
            out = []
            while size:
                length, order, doc, start, total, ids = window.pop(0)
                n = min(length, size)
                out.append((n, order, doc, start, total, ids[: 4 * n]))
                if n < length:
                    window.insert(0, (length - n, order, doc, start + n, total, ids[4 * n :]))
                size -= n
            self._emit(out, self.tiers[0] if sum(p[0] for p in out) < self.tiers[0] else sum(p[0] for p in out))

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        size = sum(p[0] for p in pieces)
        step = self.open_steps.get(tier)
        if step is None or step[1] < size:
            step = self.open_steps[tier] = [self.first_id + self.steps, self.step_tokens]
            self.steps += 1
        step[1] -= size
        at = 0
        for n, _, doc, start, total, ids in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.first_id + self.sequences, at, tier, step[0]))
            at += n
        self.sequences += 1


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", eos: int = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), ranks_file: str | None = None, pattern: str | None = None, pool_tokens: int = 1 << 19, step_sequences: int = 8) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    A null or empty text is the end id alone. Rows are packed one by one, so repeated rows and null ids are packed as
    often as they occur; long texts are cut into windows. Empty input: empty result. Sequences are exactly full, of a
    tier's length or, at a partition's end, of a smaller power of two; all of a tier's step groups but its last in a
    partition hold ``step_sequences`` times the largest tier in tokens.
    """
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
    end = eos.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file, ranks_file, pattern)
        packer = Packer(TaskContext.get().partitionId() << 36, tiers, pool_tokens, step_sequences * max(tiers))
        id_type = pa.null()

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            return pa.record_batch([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", *names])

        for b in batches:
            id_type = b.schema.field(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, encoder.encode(text or "") + end)
            if packer.rows:
                yield out()
        packer.close()
        if packer.rows:
            yield out()

    schema = f"id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
