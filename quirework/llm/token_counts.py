"""Token counts of whole texts: batched encoding in Arrow functions that return lengths only.

Texts are cut before runs of spaces. No piece of the vocabulary holds a space mark after another character (checked
when a model is loaded), so no merge crosses such a cut and the counts of the parts add up to the count of the text.
Distinct parts of a batch are encoded in one library call; batches are balanced by bytes, not by rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_RUNS = re.compile(" *[^ ]+| +$")


#: Longest part, in characters, that is remembered; a text without spaces is one part, which seldom comes again.
LONGEST = 64


class PieceCounter:
    """Counts tokens as the sentencepiece library does for whole texts, remembering the counts of short parts.

    ``max_parts`` and LONGEST bound the memory of what is remembered; they never change a count.
    """

    def __init__(self, model_file: str, max_parts: int = 300_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.encode("a", out_type=str)[0][0] == MARK and self.sp.encode("a  b ", out_type=str)[-1] == MARK
        self.max_parts = max_parts
        self.known: dict[str, int] = {"": 1}

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts of a text that isn't empty, each without the one space that the library puts before a text."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in _RUNS.findall(" " + text)]
        return text.split(" ")

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        if len(self.known) > self.max_parts:
            self.known = {"": 1}
        cut = [self.parts(t) if t else [] for t in texts]
        new = list({p for c in cut for p in c if p not in self.known})
        found = dict(zip(new, map(len, self.sp.encode(new, num_threads=1)), strict=True))
        long = {p: n for p, n in found.items() if len(p) > LONGEST}
        self.known.update(found.items() - long.items() if long else found)
        return [sum(map(self.known.__getitem__, c)) if long.keys().isdisjoint(c) else sum(long[p] if p in long else self.known[p] for p in c) for c in cut]


def by_bytes(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a larger row is alone."""
    begin = total = end = 0
    for end, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, end
            begin, total = end, 0
        total += n
    if total or begin <= end:
        yield begin, end + 1


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``; null texts count as empty (0, 0, false).

    Rows are independent: repeated rows, ties and null ids are kept as they are. Empty input: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n: list[int] = []
            for i, j in by_bytes(sizes, batch_bytes) if texts else ():
                n += counter.counts(texts[i:j])
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
