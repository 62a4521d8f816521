"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel compares words by their subsequences of three letters (a word's ends count as letters) within a span, each
weighted by a decay to the power of its gaps, over a norm that depends on a word's length. Letters that are spelled
apart or with signs between them are drawn together, usual stand-ins are read as letters, and letters inserted into an
insult only weaken its gaps.

Training is on the labels of texts, by latent words: a toxic text is toxic for its worst words, and no word of another
text is. Rounds alternate between choosing each toxic text's worst words, at first by how much oftener toxic texts have
them, later by the machine, and fitting a squared-hinge machine that sets these apart from the words of other texts,
those that the last machine found worst included. Words become their kernel values with the landmarks, whitened
(Nyström). As the kernel is a product of explicit features, the machine collapses to one weight for each subsequence, so
that scoring a whole text takes a few vector operations for each letter. A text's score is a logistic function of the
margins of its three worst words, and of how many words it has, since a long text has more of them that look bad by
chance; its weights are fitted to labelled texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Alphabet: 0 separates words, 63 is no letter; 1-26 are a-z, the rest other letters, those beyond Latin-1 hashed.
SIZE, OTHER = 64, 63
#: Longest distance between the first and the third letter, and the weight of one skipped letter.
SPAN, DECAY = 5, 0.6
#: Usual stand-ins for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _table() -> np.ndarray:
    out = np.full(0x10000, OTHER, np.uint8)
    for cp in range(0xC0, 0x10000):
        if chr(cp).isalpha():
            out[cp] = 27 + (cp % 32 if cp < 0x100 else (cp * 40503 >> 3) % 36)
    for i in range(26):
        out[97 + i] = 1 + i
    for a, b in STAND_INS.items():
        out[ord(a)] = 1 + ord(b) - 97
    for cp in map(ord, " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　"):
        out[cp] = 0
    out[0x2000:0x200B] = 0
    return out


TABLE = _table()
PAIRS = [(i, j) for j in range(2, SPAN + 1) for i in range(1, j)]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words of some texts, with blanks around each word; where words begin and end; and each word's text."""
    low = [(t if t.isascii() else unicodedata.normalize("NFKC", t)).lower() for t in texts]
    x = np.frombuffer(("\n" + "\n\n\n".join([*low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = TABLE[np.where(x < 0x10000, x, 0x4E00 + (x & 0xFFF))]
    ends = 1 + np.cumsum([len(t) + 3 for t in low], dtype=np.int64)
    keep = code != OTHER
    code, ends = code[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    blank = code == 0
    # Spaces between single letters go, so that letters spelled apart are one word
    gap = blank.copy()
    gap[:2] = gap[-2:] = False  # a text's own ends are wider
    gap[2:-2] &= blank[:-4] & blank[4:] & ~blank[1:-3] & ~blank[3:-1]
    code, ends, blank = code[~gap], np.concatenate([[0], np.cumsum(~gap)])[ends], blank[~gap]
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stop = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    return code, start, stop, np.searchsorted(ends, start, "right")


def norms(n: np.ndarray) -> np.ndarray:
    """The norm of words of n letters: as if none of their subsequences occurred twice."""
    total = np.zeros(len(n))
    for i, j in PAIRS:
        total += np.maximum(0, n + 2 - j) * DECAY ** (2 * (j - 2))
    return np.sqrt(np.maximum(total, 1e-12))


def weigh(code: np.ndarray, start: np.ndarray, stop: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By word, the sum of the weights (one or several for each subsequence) of its subsequences, over its norm."""
    if not len(start):
        return np.zeros((0, *weights.shape[1:]), np.float32)
    # How many letters of the word there are from each place on: the blank before it and the one after it are two
    left = np.zeros(len(code), np.int64)
    n = stop - start + 1
    at = np.repeat(start - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left[at] = np.repeat(stop + 1, n) - at
    c = code.astype(np.int32)
    out = np.zeros((len(code), *weights.shape[1:]), np.float32)
    for i, j in PAIRS:
        if len(code) > j:
            ok = np.flatnonzero(left[: len(code) - j] > j)
            out[ok] += np.float32(DECAY ** (j - 2)) * weights[(c[ok] * SIZE + c[ok + i]) * SIZE + c[ok + j]]
    return np.add.reduceat(out, np.stack([start - 1, stop], 1).ravel())[::2] / norms(stop - start).reshape(-1, *[1] * (weights.ndim - 1)).astype(np.float32)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight over the word's norm) of words that are given with their ends, in order of words."""
    sizes = np.array([len(w) for w in words], np.int64)
    code = _codes("".join(words)).astype(np.int32)
    at = np.arange(len(code))
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - at
    norm = norms(sizes - 2)
    rows, grams, weights = [], [], []
    for i, j in PAIRS:
        ok = np.flatnonzero(left > j)
        rows.append(word[ok])
        grams.append((code[ok] * SIZE + code[ok + i]) * SIZE + code[ok + j])
        weights.append(DECAY ** (j - 2) / norm[word[ok]])
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(grams)[order], np.concatenate(weights)[order].astype(np.float32)


#: How many of a text's worst words its score is made of, the least margin that is told from none, and what counts as full.
WORST, FLOOR, FULL = 3, -0.5, 1.0


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE**3, np.float32))
    bias: float = -1.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(WORST + 1))
    offset: float = -3.0

    def worst(self, texts: list[str], tell: bool = False) -> tuple[np.ndarray, list[list[str]]]:
        """The margins of each text's worst distinct words, FLOOR where there are none, and less the log of its words; with ``tell`` the words themselves."""
        out = np.full((len(texts), WORST + 1), FLOOR)
        named: list[list[str]] = [[] for _ in texts]
        code, start, stop, doc = words_of(texts)
        margin = weigh(code, start, stop, self.weights).astype(np.float64) + self.bias
        out[:, WORST] = -np.log1p(np.bincount(doc, minlength=len(texts)))
        margin = np.round(margin, 6)
        ok = np.flatnonzero(margin > FLOOR)
        order = ok[np.lexsort((-margin[ok], doc[ok]))]
        # Words of one margin count as one word
        d, m = doc[order], margin[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1])
        order, d, m = order[new], d[new], m[new]
        rank = np.arange(len(d)) - np.searchsorted(d, d, "left")
        top = rank < WORST
        out[d[top], rank[top]] = np.minimum(m[top], FULL)
        if tell:
            for k, i in zip(order[top].tolist(), d[top].tolist(), strict=True):
                named[i].append(code[start[k] - 1 : stop[k] + 1].tobytes().decode("latin-1").translate(_SHOWN))
        return out, named

    def scores(self, texts: list[str]) -> np.ndarray:
        margins, _ = self.worst(texts)
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.offset, -30, 30)))


def in_blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def fit_machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; y is -1 or 1."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6
    for _ in range(rounds):
        hit = y * (x @ w) < 1
        a = x[hit] * cost[hit, None]
        new = np.linalg.solve(a.T @ x[hit] + np.diag(reg), a.T @ y[hit])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_link(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic link on the worst words' margins, with Platt's targets, by projected Newton steps; slopes are never negative."""
    pos, neg = label.sum(), (1 - label).sum()
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([margins, np.ones((len(margins), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    free = np.ones(len(w), bool)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - t)) + ridge * w
        # A slope that is 0 and would fall stays there
        free[:-1] = (w[:-1] > 0) | (slope[:-1] < 0)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        new = w - np.clip(step, -1, 1)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def labelled_sample(labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic) of at most ``most`` training documents of each label, by hash order; and how many there are of each."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    part = lambda k: train.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return part(0).union(part(1)), {int(r.toxic): r["count"] for r in train.groupBy("toxic").count().collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, landmarks: int = 256, instances: int = 6000, rounds: int = 4) -> Model:
    """Fits on a bounded sample of labelled rows: ``most`` documents of each label; ``instances`` distinct words of each kind.

    Rows whose crc32(doc_id) mod 5 is 0 are never used, nor are null ids, null texts and labels other than 0 and 1; rows
    that repeat an id count as often as they are there, and of several labels of an id the largest holds. Ties go by
    hash and then by name. Without both labels, as with empty tables, the model calls nothing toxic.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen, known = labelled_sample(labels, most)
    sample = scratch.save(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in in_blocks(whole.column(0).to_pylist()):
                b = whole.slice(i, j - i)
                texts = b.column(0).to_pylist()
                code, start, stop, doc = words_of(texts)
                letters = code.tobytes().decode("latin-1")
                found: list[set[str]] = [set() for _ in texts]
                for s, e, d in zip(start.tolist(), stop.tolist(), doc.tolist(), strict=True):
                    found[d].add(letters[s - 1 : e + 1].translate(_SHOWN))
                yield pa.record_batch([pa.array([sorted(f) for f in found], pa.list_(pa.string())), b.column(1)], names=["words", "toxic"])

    bags = scratch.save(sample.mapInArrow(cut, "words array<string>, toxic int"), "bags")
    size = dict(bags.groupBy("toxic").count().collect())
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model()
    counts = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    counts = scratch.save(counts, "words")
    lift = F.col("t") * F.log((F.col("t") / bad) / ((F.col("n") - F.col("t") + 0.5) / good))
    first = counts.where("t > 1").withColumn("lift", lift).where("lift > 0").orderBy(F.desc("lift"), "word").limit(instances).select("word", "lift").collect()
    # Of so many words, some have a smaller lift by chance
    least = np.log(max(2, counts.count()))
    first = [r for r in first if r.lift > least] or first[:20]
    if not first:
        return Model()
    # Round 0: the word of each toxic text that toxic texts have most of
    rank = {r.word: r.lift for r in first}
    guilty = _latent(bags.where("toxic = 1").select("words"), rank)
    others = counts.where("n > t").select("word", (F.col("n") - F.col("t")).alias("c"))
    innocent = {r.word: r.c for by in (F.desc("c"), F.xxhash64("word")) for r in others.orderBy(by, "word").limit(instances // 3).collect()}
    # Words of the first choice that other texts have too
    shared = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in guilty], "word string"))
    innocent |= {r.word: r.c for r in others.join(shared, "word").collect()}
    model = Model()
    for k in range(rounds):
        model.weights, model.bias = _machine(guilty, innocent, landmarks)
        if k < rounds - 1:
            innocent |= _worst_innocent(others, model, instances // 3)
            again = {w: n for w, n in _again(sample, model).items() if n * good > 2 * innocent.get(w, 0) * bad}
            guilty = again or guilty
    link = sample.mapInArrow(_margin_runner(model), "toxic int, margins array<double>").toPandas()
    label = link["toxic"].to_numpy().astype(float)
    # Both labels weigh as in the whole labelled table
    each = {k: known.get(k, 0) / max(1, size.get(k, 0)) for k in (0, 1)}
    weight = np.where(label == 1, each[1], each[0])
    model.slopes, model.offset = fit_link(np.stack(link["margins"].to_numpy()), label, weight / weight.mean())
    return model


def _latent(bags: DataFrame, rank: dict[str, float]) -> dict[str, int]:
    """How many texts have a word as their first or second by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [sorted((w for w in words if w in rank), key=lambda w: (-rank[w], w))[:2] for words in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([w for x in best for w in x], pa.string())], names=["word"])

    found = bags.mapInArrow(run, "word string").groupBy("word").count().collect()
    return {r.word: r["count"] for r in found}


def _again(sample: DataFrame, model: Model) -> dict[str, int]:
    """How many toxic texts have a word among the two that a machine finds worst, of words that it calls toxic.

    A text without such a word may be labelled by mistake, and is left out of the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in in_blocks(texts):
                margins, words = model.worst(texts[i:j], True)
                yield pa.record_batch([pa.array([w for m, x in zip(margins, words, strict=True) for k, w in enumerate(x[:2]) if m[k] > 0], pa.string())], names=["word"])

    found = sample.where("toxic = 1").select("text").mapInArrow(run, "word string").groupBy("word").count().collect()
    return {r.word: r["count"] for r in found}


def _worst_innocent(others: DataFrame, model: Model, most: int) -> dict[str, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            if words:
                margin = _kernel(words, model.weights).astype(float) + model.bias
                yield pa.record_batch([b.column(0), b.column(1), pa.array(margin)], names=["word", "c", "margin"])

    worst = others.mapInArrow(run, "word string, c long, margin double").where("margin > -1").orderBy(F.desc("margin"), "word").limit(most)
    return {r.word: r.c for r in worst.collect()}


def _disguised(word: str) -> list[str]:
    """A word, given with its ends, with one letter inserted or left out, for each place inside it."""
    places = range(2, len(word) - 1)
    return [word[:i] + chr(0x4E00 + 1 + (7 * i + len(word)) % 26) + word[i:] for i in places] + [word[:i] + word[i + 1 :] for i in places if len(word) > 6]


def _machine(guilty: dict[str, int], innocent: dict[str, int], landmarks: int) -> tuple[np.ndarray, float]:
    """The weight of each subsequence, and the bias, of a machine on the landmarks' kernel values.

    Landmarks are the words that most toxic texts are toxic for and, of a fourth of their number, those of other texts
    that are most like them.
    """
    by_count = sorted(guilty, key=lambda w: (-guilty[w], w))
    marks = by_count[: landmarks * 3 // 4]
    row, gram, weight = subsequences(marks)
    known, column = np.unique(gram, return_inverse=True)
    basis = np.zeros((len(known), landmarks), np.float32)
    np.add.at(basis, (column, row), weight)
    near = sorted((w for w in innocent if w not in guilty), key=lambda w: (-innocent[w], w))
    if near:
        like = _values(near, known, basis).max(axis=1)
        marks = marks + [near[i] for i in np.argsort(-like, kind="stable")[: landmarks - len(marks)]]
        row, gram, weight = subsequences(marks)
        known, column = np.unique(gram, return_inverse=True)
        basis = np.zeros((len(known), len(marks)), np.float32)
        np.add.at(basis, (column, row), weight)
    basis = basis[:, : len(marks)]
    value, vector = np.linalg.eigh((basis.T @ basis).astype(float))
    white = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    # A disguise counts as a part of its word
    hidden = {d: guilty[w] / len(w) for w in by_count[:200] for d in _disguised(w) if d not in guilty and d not in innocent}
    rows = [*guilty, *hidden, *innocent]
    z = _values(rows, known, basis).astype(float) @ white
    y = np.array([1.0] * (len(guilty) + len(hidden)) + [-1.0] * len(innocent))
    # A word that both kinds of texts have stands on both sides
    parts = [np.sqrt(np.array([*x.values()], float)) for x in (guilty, hidden, innocent)]
    cost = np.concatenate([part * share / max(part.sum(), 1e-9) for part, share in zip(parts, (0.7, 0.3, 1.0), strict=True)])
    w, bias = fit_machine(z, y, cost)
    out = np.zeros(SIZE**3, np.float32)
    out[known] = basis @ (white @ w)
    return out, bias


def _values(words: list[str], known: np.ndarray, basis: np.ndarray, block: int = 40_000) -> np.ndarray:
    """Kernel values of words, given with their ends, with the landmarks whose features by subsequence are ``basis``."""
    place = np.full(SIZE**3, -1, np.int32)
    place[known] = np.arange(len(known))
    out = np.zeros((len(words), basis.shape[1]), np.float32)
    for begin, end in in_blocks(words, block // len(PAIRS)):
        row, gram, weight = subsequences(words[begin:end])
        at = place[gram]
        row, at, weight = row[at >= 0], at[at >= 0], weight[at >= 0]
        for i in range(0, len(row), block):  # a word may be longer than a block
            cut = slice(i, i + block)
            first = np.flatnonzero(np.diff(row[cut], prepend=-1))
            out[begin + row[cut][first]] += np.add.reduceat(basis[at[cut]] * weight[cut, None], first)
    return out


def _kernel(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sums of weights of words that are given with their ends."""
    row, gram, weight = subsequences(words)
    return np.bincount(row, weight * weights[gram], len(words))


#: Letters' numbers as characters that sort and print well, and back.
_SHOWN = {i: 0x4E00 + i for i in range(SIZE)}


def _codes(word: str) -> np.ndarray:
    return np.array([ord(c) - 0x4E00 for c in word], np.uint8)


def _margin_runner(model: Model):
    """Arrow function: text and label to the label and the worst margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in in_blocks(texts):
                yield pa.record_batch([b.column(1).slice(i, j - i), pa.array(model.worst(texts[i:j])[0].tolist(), pa.list_(pa.float64()))], names=["toxic", "margins"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row of ``docs``; null, empty and blank texts have the score of a text without words.

    Rows are independent: repeated rows, ties and null ids are kept; whole texts are scored in blocks of about 1 MB.
    Empty input: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            parts = [model.scores(texts[i:j]) for i, j in in_blocks(texts)]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
