"""Mixing to target weights by soft membership.

A classifier that is fitted to a labelled table predicts each document's posteriors over the domains. Projected
gradient steps then find document rates, never negative, whose expected token totals by domain come as near to the
targets as least squares can, while rates stay near one. A step's gradient depends on a document only through its
posteriors, so the steps add up to one number for each domain: rates are 1 less the posteriors times these, or 0.
Each step is scaled by the inverse of the curvature, a Gram matrix of the posteriors of all documents with a rate over 0,
and taken until the gradient vanishes. Errors and curvature are sums over all documents, by one distributed aggregate
for each step; the driver holds a few numbers for each domain. Posteriors are kept in hundredths, and documents with the
same ones are added up first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch

#: Buckets of hashed byte 4-grams.
BUCKETS = 2048


def histograms(texts: list[bytes], block: int = 1 << 22) -> np.ndarray:
    """By text, the square roots of the shares of its byte 4-grams' buckets; zeros for fewer than four bytes."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, t in zip(out, texts, strict=True):
        for at in range(0, max(0, len(t) - 3), block):
            x = np.frombuffer(t[at : at + block + 3], np.uint8).astype(np.uint32)
            code = x[:-3] | (x[1:-2] << 8) | (x[2:-1] << 16) | (x[3:] << 24)
            row += np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=BUCKETS)
        if len(t) > 3:
            np.sqrt(row / (len(t) - 3), out=row)
    return out


def hundredths(p: np.ndarray) -> np.ndarray:
    """Rows of shares as whole hundredths that add up to 100: the largest remainders are rounded up."""
    low = np.floor(p * 100)
    order = np.argsort(low - p * 100, axis=1, kind="stable")
    up = np.arange(p.shape[1]) < (100 - low.sum(axis=1))[:, None]
    np.put_along_axis(low, order, np.take_along_axis(low, order, 1) + up, 1)
    return low.astype(np.int64)


class DomainClassifier:
    """Softmax regression on histograms."""

    def __init__(self, domains: list[str], weights: np.ndarray):
        self.domains, self.weights = domains, weights

    @classmethod
    def fit(cls, docs: DataFrame, labelled: DataFrame, most: int = 1000, rounds: int = 300, ridge: float = 1e-4) -> DomainClassifier:
        """``labelled(doc_id, domain)``: at most ``most`` documents of each domain, by hash order, are used."""
        known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
        counts = known.groupBy("domain").agg(F.count("*").alias("n"))
        # By hash order; what can't be among the first is left out before the rows of a domain meet
        order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        early = known.join(F.broadcast(counts), "domain").where(order * F.col("n") <= (2.0 * most + 100) * (1 << 30))
        rank = F.row_number().over(Window.partitionBy("domain").orderBy(order, "doc_id"))
        chosen = early.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "domain")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = histograms([(t or "").encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()])
                yield pa.record_batch([b.column(1), pa.array([r.astype(np.float16).tobytes() for r in h], pa.binary())], names=["domain", "h"])

        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "domain").mapInArrow(run, "domain string, h binary").toPandas().sort_values(["domain", "h"])
        names = sorted(rows["domain"].unique())
        if not names:
            return cls(["all"], np.zeros((BUCKETS + 1, 1), np.float32))
        x = np.stack([np.frombuffer(h, np.float16) for h in rows["h"]]).astype(np.float32)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        y = (rows["domain"].to_numpy()[:, None] == np.array(names)).astype(np.float32)
        cost = (y / y.sum(axis=0)).sum(axis=1, keepdims=True) / len(names)
        # Accelerated gradient descent; rows have a norm of at most the square root of 2
        w = last = np.zeros((x.shape[1], len(names)), np.float32)
        for k in range(rounds):
            ahead = w + (k / (k + 3)) * (w - last)
            z = x @ ahead
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w, last = ahead - len(names) * (x.T @ ((p - y) * cost) + ridge * ahead), w
        # All domains weighed alike so far; posteriors are those of domains as frequent as they are labelled
        often = {r.domain: r.n for r in counts.collect()}
        w[-1] += np.log(np.array([often[d] for d in names], float) / sum(often[d] for d in names) * len(names))
        return cls(names, w)

    def posteriors(self, docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
        """The columns ``carry`` of each row of ``docs``, _qw_tokens (words) and _qw_posteriors (hundredths by domain)."""
        weights = self.weights.astype(np.float32)
        n = len(carry)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(n).to_pylist()]
                    z = histograms(texts) @ weights[:-1] + weights[-1]
                    p = np.exp((z - z.max(axis=1, keepdims=True)).astype(float))
                    p = hundredths(p / p.sum(axis=1, keepdims=True))
                    yield pa.record_batch([*b.columns[:n], pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.int64()))], names=[*carry, "_qw_tokens", "_qw_posteriors"])

        schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("_qw_tokens", T.LongType()), T.StructField("_qw_posteriors", T.ArrayType(T.LongType()))])
        return docs.select(*carry, F.col(text_col).alias("_qw_text")).mapInArrow(run, schema)


def rate(posteriors: Column, prices: list[float]) -> Column:
    """The rate of a document, given the sum of the steps for each domain."""
    off = F.lit(0.0)
    for i, x in enumerate(prices):
        off = off + F.get(posteriors, F.lit(i)) / 100.0 * F.lit(x)
    return F.greatest(F.lit(0.0), 1.0 - off)


def fit_rates(members: DataFrame, targets: list[float], scratch: Scratch, pull: float = 1e-5, rounds: int = 100, close: float = 1e-9) -> tuple[list[float], list[float]]:
    """The sums of steps, and the expected shares they reach, for ``members(posteriors, n_tokens)``; targets are shares by domain.

    What is least is half the sum of the squared errors of the shares, each over what its domain has or shall have, and
    ``pull`` halves of the mean squared distance of the rates from one. Targets that no rates can meet are met as near as
    that allows; domains without any expected tokens get none. Steps are halved while they don't help; an optimum that
    isn't reached in ``rounds`` rounds is an error. Without tokens all rates are one.
    """
    held = scratch.save(members.groupBy("posteriors").agg(F.sum("n_tokens").alias("n_tokens")), "groups")
    width = len(targets)
    total = held.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return [0.0] * width, list(targets)
    p = [F.get("posteriors", F.lit(i)) / 100.0 for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]

    def at(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected shares under some rates, and how they fall with the prices."""
        r = rate(F.col("posteriors"), prices.tolist())
        w = F.col("n_tokens") / float(total)
        row = held.agg(*[F.sum(w * r * x) for x in p], *[F.sum(F.when(r > 0, w * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]).first()
        gram = np.zeros((width, width))
        for (i, j), x in zip(pairs, row[width:], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(row[:width]), gram

    aim = np.array(targets)
    prices = np.zeros(width)
    got, gram = at(prices)
    scale = pull * np.maximum(np.maximum(got, aim), 1e-9)
    left = prices * scale - (got - aim)
    for _ in range(rounds):
        if np.abs(left).max() <= close:
            break
        step = np.linalg.solve(gram + np.diag(scale), left)
        for k in range(30):
            new = prices - step / 2**k
            now, curve = at(new)
            rest = new * scale - (now - aim)
            if np.abs(rest).max() <= close or np.linalg.norm(rest) < np.linalg.norm(left):
                break
        else:
            # No shorter step helps at this precision
            if np.abs(left).max() <= 1e-6:
                break
            raise RuntimeError("rates did not settle")
        prices, got, gram, left = new, now, curve, rest
    else:
        raise RuntimeError(f"rates did not settle in {rounds} rounds")
    return [float(f"{x:.9g}") for x in prices], got.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], carry: list[str], pull: float = 1e-5) -> tuple[DataFrame, list[str], list[float], list[float]]:
    """(rows, domains, targets, shares): the columns ``carry`` of ``docs(doc_id, text, ...)``, _qw_tokens, _qw_posteriors and _qw_rate.

    ``targets`` are weights by domain, scaled to one over the domains that the labelled table has; a domain without a
    target gets none. The shares are those expected of the rates. Null, empty and short texts get the posteriors of an
    empty histogram and are rated like others; repeated rows, ties and null ids are rows of their own. Without labels all
    rows are of one domain and rates are one. Empty input: empty result. Names that begin with _qw_ are reserved.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    model = DomainClassifier.fit(docs, labelled)
    aims = [float(targets.get(d, 0.0)) for d in model.domains]
    aims = [a / sum(aims) for a in aims] if sum(aims) > 0 else [1 / len(aims)] * len(aims)
    members = scratch.save(model.posteriors(docs, carry), "members")
    prices, shares = fit_rates(members.select(F.col("_qw_posteriors").alias("posteriors"), F.col("_qw_tokens").alias("n_tokens")), aims, scratch, pull)
    return members.withColumn("_qw_rate", rate(F.col("_qw_posteriors"), prices)), model.domains, aims, shares


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): clean, toxic or junk, as the labels have it."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain"))


def copies() -> Column:
    """How often a rated row is taken: its rate, rounded up or down by a hash of its id and its tokens."""
    share = F.pmod(F.xxhash64("doc_id", "_qw_tokens", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("_qw_rate") + share).cast("int")


#: Weights by domain of the registered query and of the pipeline.
TARGETS = {"clean": 0.93, "toxic": 0.06, "junk": 0.01}


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says: the rate's whole part, and once more by a hash of id and tokens.

    Rows of nulls, ties, repeated rows, empty tables and clashing names are as in mix.
    """
    rows, _, _, _ = mix(docs, quality_domains(labels), targets or TARGETS, docs.columns)
    return rows.withColumn("_qw_copy", F.explode(F.array_repeat(F.lit(1), copies()))).select(*docs.columns)
