"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Everything is a DataFrame operation. The n-grams are words, word pairs and the last three characters of words, each
hashed to one of a fixed number of buckets. The corpus multinomial counts every n-gram of every document; the target
multinomial counts those of trusted labelled documents. A document's score is the mean log ratio of its n-grams, and
one threshold, a low quantile of trusted documents that the target counts didn't see, decides on every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, Scratch

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in the windows in which repeats count.
WINDOW = 5
#: What is counted in every text, and what else is told of it.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ("llr", "base_failed", "kept")


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _with_hashes(df: DataFrame) -> DataFrame:
    """Adds _qw_s, _qw_t with spaces for all that separates words, _qw_w, the words, and _qw_h, their hashes."""
    # Splitting at one plain character needs no regex
    df = df.withColumn("_qw_s", _without(F.col("_qw_t"), SPACE_CHARS[1:], " ")).withColumn("_qw_w", F.array_remove(F.split("_qw_s", " "), ""))
    return df.withColumn("_qw_h", F.transform("_qw_w", lambda w: F.xxhash64(w)))


def _upto(n: Column) -> Column:
    """Array 0 .. n - 1, empty if n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def base_counts(df: DataFrame) -> DataFrame:
    """Adds the columns of COUNTS of _qw_t, with _qw_ before their names; needs _qw_s, _qw_w and _qw_h.

    Windows of words are compared by 64-bit hashes. Texts without words have zeros.
    """
    df = df.withColumn("_qw_n_words", F.size("_qw_h").cast("long"))
    df = df.withColumn("_qw_word_chars", F.length(F.replace("_qw_s", F.lit(" "), F.lit(""))).cast("long"))
    df = df.withColumn("_qw_n_symbols", (F.length("_qw_t") - F.length(_without(F.col("_qw_t"), SYMBOLS))).cast("long"))
    lines = F.filter(F.split("_qw_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumn("_qw_lines", lines).withColumn("_qw_n_dup_lines", (F.size("_qw_lines") - F.size(F.array_distinct("_qw_lines"))).cast("long")).drop("_qw_lines")
    # Windows; the few texts in which one occurs twice sort theirs by hash and look at the neighbours
    at = lambda i, k: F.get("_qw_h", i + k)
    df = df.withColumn("_qw_win", F.transform(_upto(F.size("_qw_h") - (WINDOW - 1)), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))))
    repeats = F.size(F.array_distinct("_qw_win")) < F.size("_qw_win")
    df = df.withColumn("_qw_sorted", F.when(repeats, F.array_sort(F.transform("_qw_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter("_qw_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_qw_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_qw_sorted", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_qw_pos", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_qw_pos", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_qw_pos", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("_qw_n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_qw_win", "_qw_sorted", "_qw_pos")


def grams() -> Column:
    """Array of the hashes of all n-grams; needs _qw_w and _qw_h."""
    pair = F.transform(_upto(F.size("_qw_h") - 1), lambda i: F.xxhash64(F.get("_qw_h", i), F.get("_qw_h", i + 1)))
    return F.concat("_qw_h", pair, F.transform("_qw_w", lambda w: F.xxhash64(F.right(w, F.lit(3)))))


def bucket(h: Column, n_buckets: int) -> Column:
    """The bucket of a hash; the number of buckets is a power of two."""
    return h.bitwiseAND(F.lit(n_buckets - 1)).cast("int")


def trusted_ids(labels: DataFrame, folds: int = 5, held: bool = False) -> DataFrame:
    """The ids of all documents labelled good and not toxic, of the counted or the held-out folds."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    return good.where((part == 0) if held else (part != 0)).select("doc_id")


#: Ids, at most, that are broadcast to the documents; more of them are joined.
FEW = 4_000_000


def _spread(ids: DataFrame) -> DataFrame:
    """``ids`` of a written table, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def ratios(docs: DataFrame, trusted: DataFrame, scratch: Scratch, n_buckets: int, weight: float) -> DataFrame:
    """(bucket, ratio): log of target frequency against corpus frequency, shrunk towards 0 where the corpus has little.

    Counts cover every document, and every one of ``trusted``; they are written once, as both their totals and the
    ratios read them. Without documents, or trusted ones, there is nothing to tell apart.
    """
    trusted = scratch.save(trusted, "trusted")
    flagged = docs.select(F.col("doc_id"), _text(F.col("text")).alias("_qw_t")).join(_spread(trusted).withColumn("_qw_good", F.lit(1)), "doc_id", "left")
    every = _with_hashes(flagged).select("_qw_good", F.explode(grams()).alias("h"))
    counts = every.groupBy(bucket(F.col("h"), n_buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.count("_qw_good").alias("target"))
    counts = scratch.save(counts, "counts")
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    share = totals.select(F.col("all_target") / F.col("all_raw")).scalar()
    return counts.select("bucket", F.log((F.col("target") + weight) / (F.col("raw") * share + weight)).alias("ratio"))


def _score(hashes: Column, table: Column, n_buckets: int) -> Column:
    """Mean ratio: the ratios are summed as whole thousandths, so that a score doesn't depend on an order."""
    total = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.get(table, bucket(h, n_buckets)))
    return F.when(F.size(hashes) > 0, total / 1000.0 / F.size(hashes)).otherwise(0.0)


class QualityModel:
    """The ratios by bucket (a table of ``n_buckets`` rows at most) and the threshold."""

    def __init__(self, docs: DataFrame, labels: DataFrame, scratch: Scratch, n_buckets: int = 1 << 16, quantile: float = 0.005, margin: float = 0.1, weight: float = 5.0):
        self.n_buckets = n_buckets
        raw = ratios(docs, trusted_ids(labels), scratch, n_buckets, weight)
        self.table = scratch.save(raw, "ratios")
        listed = self._listed()
        #: A constant of the plan: Catalyst folds the cast into one array literal.
        self.array = F.split(F.lit(listed), ",").cast("array<int>")
        held = _spread(scratch.save(trusted_ids(labels, held=True), "held"))
        scores = self.scored(docs.select("doc_id", "text").join(held, "doc_id", "left_semi")).select(F.col("_qw_llr").alias("llr"))
        low = scores.agg(F.percentile("llr", quantile)).first()[0]
        #: Without trusted documents nothing is rejected by score.
        self.threshold = float("-inf") if low is None else low - margin

    def _listed(self) -> str:
        """All ratios in bucket order, in thousandths, joined by commas; its length is bounded by the number of buckets."""
        spark = self.table.sparkSession
        full = spark.range(0, self.n_buckets, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(self.table, "bucket", "left")
        rows = full.agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce(F.round(F.col("ratio") * 1000), F.lit(0)).cast("int").alias("r")))).alias("x"))
        return rows.select(F.array_join(F.col("x.r").cast("array<string>"), ",")).first()[0]

    def scored(self, docs: DataFrame) -> DataFrame:
        """Adds _qw_t, _qw_s, _qw_w, _qw_h and _qw_llr to rows that have a column text."""
        df = _with_hashes(docs.withColumn("_qw_t", _text(F.col("text"))))
        return df.withColumn("_qw_grams", grams()).withColumn("_qw_llr", _score(F.col("_qw_grams"), self.array, self.n_buckets)).drop("_qw_grams")

    def judge(self, docs: DataFrame, prefix: str = "_qw_") -> DataFrame:
        """``docs`` and the columns of COUNTS and VERDICT, with ``prefix`` before their names.

        Every row is judged by its text alone: nulls and empty texts have no words and fail the base rules, rows that
        repeat get the same verdict, a score that equals the threshold is kept. Long texts are read whole. All columns
        of ``docs`` stay as they are; names that begin with _qw_ are reserved. Empty input: empty result.
        """
        if clash := {prefix + c for c in COUNTS + VERDICT} & set(docs.columns):
            raise ValueError(f"columns {sorted(clash)} are there; choose another prefix")
        df = base_counts(self.scored(docs))
        failed = (F.col("_qw_n_words") < 10) | (100 * F.col("_qw_n_repeat_words") > 20 * F.col("_qw_n_words"))
        df = df.withColumn("_qw_base_failed", failed).withColumn("_qw_kept", ~F.col("_qw_base_failed") & (F.col("_qw_llr") >= F.lit(self.threshold)))
        return df.select(*docs.columns, *[F.col(f"_qw_{c}").alias(prefix + c) for c in COUNTS + VERDICT])
