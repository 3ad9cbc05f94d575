"""Language identification: sparse multinomial logistic regression on hashed
TF-IDF character n-grams, trained with follow-the-regularised-leader (per
coordinate, elastic net), then calibrated by a temperature.

Document frequencies are counted over all documents of the learning fold. The
fit sees at most ``PER_LANG`` documents of each language and ``FIT_DOCS`` in
all (the first of each language by a hash of doc_id), as numbers of n-grams and
not as texts; a fifth of them is set aside for the temperature. The
``MAX_LANGS`` most frequent languages are learned, which bounds the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import fold, text_key, written

FOLDS, HELD_OUT = 5, 0
BITS = 15  # 32,768 hashed n-grams
PER_LANG, FIT_DOCS, MAX_LANGS = 2000, 40_000, 1000
PLACES = 16  # ids are first told apart by so many leading bits of their hash
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BLOCK = 1 << 20


def grams(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased characters;
    an ASCII character that is not a letter counts as a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint64(32), c)
    out = np.zeros(1 << BITS, np.int64)
    for s in range(0, len(c), _BLOCK):  # a very long text in bounded pieces; grams begin in the piece
        p = c[s:s + _BLOCK + 2]
        for n in range(3):
            m = min(_BLOCK, len(p) - n)
            if m > 0:
                q = p[:m]
                for k in range(1, n + 1):
                    q = q * np.uint64(0x100000001B3) ^ p[k:k + m]
                place = (q + np.uint64(n + 1)) * _MIX[n] >> np.uint64(64 - BITS)
                out += np.bincount(place.astype(np.int64), minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit-length TF-IDF vector."""
    tf = grams(text)
    at = np.flatnonzero(tf)
    v = np.log1p(tf[at]) * idf[at]
    return at, v / max(1e-12, float(np.sqrt(v @ v)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], classes: int, size: int, epochs: int = 3,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> np.ndarray:
    """Weights ``(size + 1, classes)`` of a multinomial logistic regression by
    FTRL-proximal (McMahan et al., 2013); the last row is the intercept."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for _ in range(epochs):
        for (at, v), c in zip(rows, y):
            i, x = np.r_[at, size], np.r_[v, 1.0][:, None]
            w = weights(i)
            p = softmax((x * w).sum(0))
            p[c] -= 1
            g = x * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that gives ``y`` the highest likelihood (golden section
    on its logarithm, between 1/20 and 20)."""
    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def sample_ids(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``doc_id, lang``: the first ids of each language by a hash, ``per_lang``
    at most. Leading bits of the hash are counted first; only ids up to the
    place where a language has its number are ranked, so that no task sorts the
    ids of a whole language."""
    place = F.shiftright(F.xxhash64("doc_id"), 64 - PLACES)  # in the order of the hash
    ids = docs.select("doc_id", "lang").filter("doc_id is not null and lang is not null").withColumn("place", place)
    tally = written(ids.distinct().groupBy("lang", "place").agg(F.count("*").alias("n")), "language-places")
    top = tally.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(MAX_LANGS)
    top = written(top.select("lang"), "languages")
    want = min(per_lang, max(1, FIT_DOCS // max(1, top.count())))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("place"))  # at most 65,536 rows of a language
    last = (tally.join(F.broadcast(top), "lang").withColumn("upto", upto).filter(F.col("upto") - F.col("n") < want)
            .groupBy("lang").agg(F.max("place").alias("last")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id"))
    return written(ids.join(F.broadcast(last), "lang").filter("place <= last").select("doc_id", "lang").distinct()
                   .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want).select("doc_id", "lang"), "language-ids")


def train(docs: DataFrame, per_lang: int = PER_LANG) -> tuple | None:
    """``(languages, idf, weights, temperature)``; None when no document of
    the fold has a language and a letter."""
    size = 1 << BITS
    mine = docs.filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df += grams(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, df[at]], pa.int64())],
                                         names=["gram", "docs"])

    counts = dict(mine.select("text").mapInArrow(count, "gram int, docs bigint").groupBy("gram")
                  .agg(F.sum("docs").alias("docs")).collect())  # at most 32,769 rows
    total = counts.pop(-1, 0)
    if not total:
        return None
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    ids = sample_ids(mine, per_lang)
    # one text for each id: rows that repeat an id would otherwise all enter the fit
    sample = (mine.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang")
              .agg(F.min(F.struct(text_key(F.col("text")).alias("tk"), "text")).alias("x")).select("doc_id", "lang", "x.text"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in enumerate(b.column(2).to_pylist()):
                if has_letter(t):
                    at, v = vector(t, idf)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                         pa.array([v.astype("<f4").tobytes()], pa.binary())], names=["doc_id", "lang", "at", "v"])

    def fit(rows):
        import pandas as pd
        rows = rows.assign(o=pd.util.hash_array(rows["doc_id"].to_numpy())).sort_values(["o", "doc_id", "lang"])
        langs = sorted(rows["lang"].unique())
        x = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for a, v in zip(rows["at"], rows["v"])]
        y = [langs.index(v) for v in rows["lang"]]
        cut = max(1, len(x) * 4 // 5)
        w = ftrl(x[:cut], y[:cut], len(langs), size)
        rest = range(cut, len(x))
        z = np.array([(v[:, None] * w[at]).sum(0) + w[-1] for at, v in (x[k] for k in rest)])
        t = temperature(z, np.array([y[k] for k in rest])) if len(rest) and len(langs) > 1 else 1.0
        return pd.DataFrame({"lang": langs, "w": [w[:, k].astype("<f8").tobytes() for k in range(len(langs))], "t": t})

    vectors = sample.mapInArrow(numbers, sample.select("doc_id", "lang").schema.add("at", "binary").add("v", "binary"))
    model = vectors.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "lang string, w binary, t double").collect()
    if not model:
        return None
    model.sort(key=lambda r: r["lang"])  # here: a sort in Spark would run the fit twice, once for its ranges
    w = np.column_stack([np.frombuffer(r["w"], "<f8") for r in model])
    return [r["lang"] for r in model], idf, w, model[0]["t"]


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Texts that are null or without a letter are ``und`` with score 0, and so
    is every text when there was nothing to learn from. Ties go to the language
    that sorts first. Rows with ``crc32(doc_id as text) mod 5 = 0`` and rows
    without language are not learned from; predictions depend on the text
    alone. An empty table gives an empty result."""
    model = train(docs, per_lang)

    @F.pandas_udf("lang_pred string, score double")
    def language(texts):
        import pandas as pd
        out = []
        for t in texts:
            if model is None or not has_letter(t):
                out.append((UNKNOWN, 0.0))
                continue
            langs, idf, w, temp = model
            at, v = vector(t, idf)
            p = softmax((v @ w[at] + w[-1]) / temp)
            k = int(p.argmax())
            out.append((langs[k], float(p[k])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    r = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                    language(F.col("text")).alias("r"))
    return r.select("doc_id", "held_out", "r.lang_pred", "r.score")
