"""Language identification in two steps: family, then languages of that family.

A text's features are the shares of its hashed byte trigrams (lower case, words apart).
A linear support vector machine for each pair of families, and for each pair of languages
of a family, is trained by stochastic subgradient steps on a bounded sample: at most
``PER_LANGUAGE`` labelled documents of each language and about ``SAMPLE`` of all, those whose hashed ids come first
(rows that share an id count once, with the least text). Ids under a bound on the hash, set from the
languages' approximate counts, are taken before the first of these are, so no task gathers a language. The feature vectors are made by
the executors; the driver receives ``FEATURES`` numbers for each sampled row. Prediction adds up trigram weights over whole texts: first the family
that wins most pairs, then the language that does within it (ties: the larger sum of
margins). ``score`` is the logistic of the narrowest margin by which the winners won.

Learned from: text and non-null ``lang`` of the rows whose ``crc32`` of the id as text
is not 2 modulo 4. Neither ``lang``, ``source`` nor the id is an input of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is any
text if nothing was learned; one learned language is always predicted; a null id is
neither held out nor learned from; an empty table gives an empty result; repeated rows
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import join_small, settle, table

FEATURES = 4096
PER_LANGUAGE, SAMPLE = 400, 8000
#: Times the wanted ids that are taken before the first are chosen.
SPARE = 8
EPOCHS, REGULAR = 30, 1e-3
#: Bytes that are counted in one step.
PIECE = 1 << 20
#: Families of languages by ISO code, fixed values; other codes are a family of their own kind.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
    "semitic": "am ar he mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The hashed trigrams of the text's bytes, a piece at a time."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for k in range(0, len(data) - 2, PIECE):
        b = data[k : k + PIECE + 2].astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(20)


def shares(text: str) -> np.ndarray:
    total = np.zeros(FEATURES)
    for t in trigrams(text):
        total += np.bincount(t, minlength=FEATURES)
    return (total / max(1, total.sum())).astype(np.float32)


@F.pandas_udf(T.BinaryType())
def shares_of(texts: pd.Series) -> pd.Series:
    return pd.Series([shares(t).tobytes() for t in texts], dtype=object)


def svm(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear support vector machine for ``y`` in {-1, 1}."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weigh = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            t += 1
            step = 1 / (REGULAR * (t + 10))
            wrong = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - step * REGULAR
            if len(wrong):
                w += step * (weigh[wrong] * y[wrong]) @ x[wrong] / len(part)
        if epoch >= EPOCHS // 2:
            mean += w
    mean /= max(1, EPOCHS - EPOCHS // 2)
    return mean[:-1], float(mean[-1])


class Model:
    """Pairwise machines between families and between the languages of each family."""

    def __init__(self, rows: list[tuple[str, np.ndarray]]):
        self.langs = sorted({lang for lang, _ in rows})
        by = {lang: np.array([x for own, x in rows if own == lang]) for lang in self.langs}
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(_FAMILY.get(lang.lower().split("-")[0], "other"), []).append(lang)
        every = np.concatenate([by[k] for k in self.langs]) if rows else np.zeros((0, FEATURES), np.float32)
        self.scale = 1 / np.sqrt(every.mean(0) + 1e-6) if rows else np.ones(FEATURES)
        sides = [(a, b, np.concatenate([by[k] for k in self.families[a]]), np.concatenate([by[k] for k in self.families[b]])) for a, b in combinations(self.families, 2)]
        sides += [(a, b, by[a], by[b]) for family in self.families.values() for a, b in combinations(family, 2)]
        self.pairs, weights, offsets = [], [], []
        for seed, (a, b, xa, xb) in enumerate(sides):
            w, offset = svm(np.concatenate([xa, xb]) * self.scale, np.r_[np.ones(len(xa)), -np.ones(len(xb))], seed)
            self.pairs.append((a, b))
            weights.append(w * self.scale)
            offsets.append(offset)
        self.weights = np.array(weights, np.float32).T.copy() if weights else np.zeros((FEATURES, 0), np.float32)
        self.offsets = np.array(offsets)

    def _best(self, names: list[str], margin: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], np.inf
        wins = {a: [margin[a, b] for b in names if b != a] for a in names}
        best = max(names, key=lambda a: (sum(m > 0 for m in wins[a]), sum(wins[a])))
        return best, min(wins[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(self.pairs)), 0
        for t in trigrams(text):
            total += np.bincount(t, minlength=FEATURES).astype(np.float64) @ self.weights
            n += len(t)
        margin = {}
        for (a, b), m in zip(self.pairs, total / max(1, n) + self.offsets):
            margin[a, b], margin[b, a] = m, -m
        family, first = self._best(list(self.families), margin)
        lang, second = self._best(self.families[family], margin)
        return lang, float(1 / (1 + np.exp(-np.clip(2 * min(first, second), -30, 30))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = settle(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")))
    wanted = max(2, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    some = join_small(rows.select("lang", "doc_id"), counts, "lang").where(place * F.col("ids") < SPARE * wanted).select("lang", "doc_id").distinct()
    first = F.row_number().over(W.partitionBy("lang").orderBy(place, "doc_id"))
    # At most so many ids for each language: what is broadcast does not grow with the rows.
    chosen = some.withColumn("k", first).where(F.col("k") <= wanted).select("lang", "doc_id")
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    sample = sample.select("lang", F.xxhash64("doc_id", "text").alias("order"), shares_of("text").alias("x"))
    found = sorted(sample.collect(), key=lambda r: (r.lang, r.order))
    return Model([(r.lang, np.frombuffer(r.x, np.float32)) for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers for each pair

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = sent.value
        return pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("_p")).select("doc_id", "held_out", "_p.*")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
