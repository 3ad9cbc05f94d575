"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents are the positives, any documents of the learning
fold are the unlabelled set; nobody says which documents are clean. A linear
classifier over the presence of words and word beginnings minimises the class-prior-corrected risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with logistic loss and soft-thresholded (L1) steps. ``members`` classifiers
share the positives and have an unlabelled set of their own; each is trained
with numpy in a task of its own, and their scores are averaged.

The fit sees a bounded sample (``max_pos`` positives, ``max_unl`` unlabelled
documents per member, the first by a hash of doc_id), as numbers of features
and not as texts; the class prior is counted over all labels of the fold, and
every document is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gridwright.llm.common import fold, fresh, text_key, written

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_POS, MAX_UNL, MEMBERS = 2000, 4000, 3
STEMS = (3, 4, 5, 6, 7)
PURITY = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words and, as insults are inflected and compounded, word beginnings
    of 3 to 7 letters (marked ``^``)."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*[["^" + w[:k] for w in words if len(w) > k] for k in STEMS])


class Known:
    """A fixed set of features, looked up in texts without building all theirs."""

    def __init__(self, names):
        self.words = frozenset(x for x in names if x[0] != "^")
        self.stems = [(k, frozenset(x[1:] for x in names if x[0] == "^" and len(x) == k + 1)) for k in STEMS]

    def within(self, text: str | None) -> set[str]:
        words = set(_WORD.findall((text or "").lower()))
        hit = words & self.words
        for k, beginnings in self.stems:
            if beginnings:
                hit.update("^" + b for b in beginnings.intersection([w[:k] for w in words if len(w) > k]))
        return hit


def nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, l1: float = 5e-5, steps: int = 500,
         rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier by full-batch Adam on the
    non-negative risk. While the negative part of the risk is below zero the
    step climbs it instead, as the method says."""
    w, b = np.zeros(xp.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        sp, su = sig(xp @ w + b), sig(xu @ w + b)
        loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()  # noqa: E731  of "negative"
        neg = loss(su) - prior * loss(sp)
        gp, gu = (sp - 1) / len(sp), su / len(su)  # derivative of the "positive" loss on P, "negative" on U
        if neg >= 0:
            dp, du = prior * gp - prior * sp / len(sp), gu
        else:
            dp, du = prior * sp / len(sp), -gu
        g = np.r_[xp.T @ dp + xu.T @ du, dp.sum() + du.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        scale = rate / (np.sqrt(v[:-1] / (1 - 0.999 ** t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale, 0)
        b -= step[-1]
    return w, float(b)


def feature_keys(text: str | None) -> np.ndarray:
    """The 64-bit numbers of the features, sorted."""
    return np.sort(np.array([xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in features(text)], np.uint64))


def _fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[dict[int, float], float]:
    """One classifier: weights of feature numbers, and intercept."""
    df, n = _counts(pos), len(pos)
    least = max(3, n // 50)
    col = np.array(sorted(k for k, c in df.items() if c >= least), np.uint64)
    rows = [[np.flatnonzero(np.isin(col, r, assume_unique=True)) for r in part] for part in (pos, unl)]
    cp, cu = (np.bincount(np.concatenate([np.empty(0, int), *r]), minlength=len(col)) for r in rows)
    # What enters the fit is clearly (4 sigma) commoner among the positives, and by the class prior most
    # documents that have it are positive: weaker signs only add up in long texts.
    m = len(unl)
    both = (cp + cu) / (n + m)
    clear = cp / n - cu / m > 4 * np.sqrt(both * (1 - both) * (1 / n + 1 / m))
    use = np.flatnonzero(clear & (prior * cp / n * m >= PURITY * (cu + 1)))
    xp, xu = (np.array([np.isin(use, r) for r in part], float).reshape(len(part), len(use)) for part in rows)
    w, b = nnpu(xp, xu, prior)
    return {int(col[k]): float(v) for k, v in zip(use, w) if v}, b


def _counts(rows: list[np.ndarray]) -> dict[int, int]:
    """In how many rows each number stands; numbers of one row only are left out."""
    keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *rows]), return_counts=True)
    return dict(zip(keys[counts > 1].tolist(), counts[counts > 1].tolist()))


def train(docs: DataFrame, labels: DataFrame, max_pos: int = MAX_POS, max_unl: int = MAX_UNL,
          members: int = MEMBERS) -> list[tuple[dict[str, float], float]]:
    """``members`` times (word weights, intercept). Without a confirmed toxic
    document in the fold there is nothing to learn: one member that scores 0."""
    mine = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    known = (labels.filter(mine & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    stats = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("p")).first()
    if not stats["p"]:
        return [({}, -40.0)]
    prior = min(0.5, stats["p"] / stats["n"])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.filter("toxic = 1").orderBy(*order).limit(max_pos).select("doc_id", F.lit(-1).alias("part"))
    unl = (docs.filter(mine & F.col("doc_id").isNotNull()).select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")).limit(max_unl * members)
           .select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(members)).cast("int").alias("part")))
    sample = written(pos.unionByName(unl), "toxicity-ids")  # at most max_pos + members * max_unl ids
    # one row for a text of an id: repeated rows would otherwise all enter the fit
    picked = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("part", "doc_id")
              .agg(F.min(F.struct(text_key(F.col("text")).alias("tk"), "text")).alias("x")).select("part", "doc_id", "x.tk", "x.text"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column(3).to_pylist()):  # a row at a time: a long text has many
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in b.columns[:3]), pa.array([feature_keys(t).tobytes()], pa.binary())],
                                                 names=["part", "doc_id", "tk", "keys"])

    keys = written(picked.mapInArrow(numbers, "part int, doc_id bigint, tk bigint, keys binary"), "toxicity-features")
    each = keys.select(F.explode(F.when(F.col("part") >= 0, F.array("part")).otherwise(
        F.array(*[F.lit(k) for k in range(members)]))).alias("member"), (F.col("part") < 0).alias("pos"), "doc_id", "tk", "keys")

    def fit(rows):
        import pandas as pd
        rows = rows.sort_values(["pos", "doc_id"])
        rows = rows[~rows["pos"] | ~rows.duplicated(["pos", "tk"])]  # copies of one document confirm nothing new
        p, u = ([np.frombuffer(k, np.uint64) for k in rows.loc[rows["pos"] == v, "keys"]] for v in (True, False))
        if not p or not u:
            return pd.DataFrame({"member": [], "number": [], "weight": []})
        w, b = _fit(p, u, prior)
        number = pd.array([None, *np.array([*w], np.uint64).astype(np.int64).tolist()], dtype="Int64")  # never as floats
        return pd.DataFrame({"member": int(rows["member"].iloc[0]), "number": number, "weight": [b, *w.values()]})

    model = each.groupBy("member").applyInPandas(fit, "member int, number bigint, weight double").collect()
    names = _names(picked.select("text"), {r["number"] for r in model} - {None})
    out: dict[int, tuple[dict, float]] = {}
    for r in model:  # as many rows as the classifiers kept features
        w, b = out.get(r["member"], ({}, 0.0))
        out[r["member"]] = (w, r["weight"]) if r["number"] is None else ({**w, names[r["number"]]: r["weight"]}, b)
    return [out[k] for k in sorted(out)] or [({}, -40.0)]


def _names(texts: DataFrame, numbers: set[int]) -> dict[int, str]:
    """The features of ``texts`` that have these numbers."""
    wanted = np.sort(np.array([*numbers], np.int64).astype(np.uint64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, str] = {}
        for b in batches:
            for t in b.column(0).to_pylist() if len(found) < len(wanted) else ():
                for x in features(t):
                    k = xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
                    if k in known:
                        found[k] = x
        at = np.array([*found], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found.values(), pa.string())], names=["number", "name"])

    known = frozenset(wanted.tolist())
    if not known:
        return {}
    return dict(texts.mapInArrow(find, "number bigint, name string").groupBy("number").agg(F.min("name")).collect())


def score(docs: DataFrame, model: list, into: str) -> DataFrame:
    """``docs`` with a column ``into``: the mean score of the classifiers, 0 to 1."""
    known = Known({x for w, _ in model for x in w})

    @F.pandas_udf("double")
    def toxicity(texts):
        import pandas as pd
        out = []
        for t in texts:
            hit = known.within(t)
            z = np.array([b + sum(w[x] for x in sorted(hit) if x in w) for w, b in model])
            out.append(float((1 / (1 + np.exp(-np.clip(z, -40, 40)))).mean()))
        return pd.Series(out, dtype="float64")

    return docs.withColumn(into, toxicity(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels of rows with ``crc32(doc_id as text) mod 3 = 1`` are never learned
    from; a null id counts as empty text there and is never in the sample.
    Null and empty texts get the score of a text without known words. A
    document labelled twice is toxic if one label says so. Scores depend on
    the text alone. An empty table gives an empty result; without toxic labels
    every score is 0."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""
    s = fresh(docs, "score")
    return score(docs, train(docs, labels), s).filter(F.col(s) < threshold).drop(s)
