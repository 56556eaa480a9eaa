"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three code points, weighted by their share of the
text times inverse document frequency. Document frequencies come from all training
documents; the weights from a bounded sample of them, by follow-the-regularised-leader
with elastic-net penalties. A temperature fitted on a part of the sample that training
did not see turns logits into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import table
from metrosift.operators.joins import join_lookup

FEATURES = 1 << 16
ORDERS = 3
#: Labelled rows the weights are fitted on, at most (about; rows are picked by hash).
SAMPLE_ROWS = 4_000
#: Besides, so many rows of each language.
LABEL_ROWS = 50
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.5, 1.0, 0.002, 0.001, 50.0
UNKNOWN = "und"
#: Code points handled at a time; longer texts are taken in steps.
_STEP = 1 << 20
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # features x languages, inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(codes: np.ndarray, ends: np.ndarray, stop: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the starts (before ``stop``) and features of the n-grams that cross none of ``ends``."""
    out = []
    with np.errstate(over="ignore"):
        state = codes * _ODD[0]
        for n in range(1, ORDERS + 1):
            if n > 1:
                state = (state[:-1] ^ (state[:-1] >> np.uint32(15))) * _ODD[n - 1] + codes[n - 1:] * _ODD[0]
            mixed = (state ^ (state >> np.uint32(16))) * _ODD[2]
            inside = np.ones(len(state), bool)
            for back in range(1, n):
                at = ends - back
                inside[at[(at >= 0) & (at < len(state))]] = False
            inside[stop:] = False
            starts = np.flatnonzero(inside)
            out.append((starts, (mixed[starts] >> np.uint32(16)).astype(np.int32)))
    return out


def steps(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(code points, text numbers, ends, stop) of groups of texts, or of a part of one long text."""
    held: list[tuple[int, str]] = []
    size = 0

    def joined():
        ends = np.cumsum([len(t) for _, t in held])
        codes = np.frombuffer("".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.array([i for i, _ in held]), ends, len(codes)

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > _STEP:
            for at in range(0, len(text), _STEP):
                part = text[at:at + _STEP + ORDERS - 1]
                codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
                yield codes, np.array([i]), np.array([len(codes)]), min(_STEP, len(codes))
            continue
        if size + len(text) > _STEP:
            yield joined()
            held, size = [], 0
        held.append((i, text))
        size += len(text)
    if held:
        yield joined()


def logits(texts: list[str | None], weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of each text, and whether it has a letter."""
    total = np.zeros((len(texts), weights.shape[1]))
    count, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for codes, numbers, ends, stop in steps(texts):
        np.logical_or.at(lettered, numbers, np.logical_or.reduceat(_letters()[codes[:stop]], np.append(0, ends[:-1])))
        for starts, features in ngrams(codes, ends, stop):
            cuts = np.searchsorted(starts, np.append(0, ends))
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                # one float column after another keeps the rows gathered small
                for k in range(weights.shape[1]):
                    np.add.at(total[:, k], numbers[some], np.add.reduceat(weights[:, k][features], cuts[some], dtype=np.float64))
                np.add.at(count, numbers[some], np.diff(cuts)[some])
    return SCALE * total / np.maximum(count, 1)[:, None] + bias, lettered


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of one text and the share of its n-grams each takes."""
    tally = np.zeros(FEATURES)
    for codes, _, ends, stop in steps([text]):
        for _, features in ngrams(codes, ends, stop):
            tally += np.bincount(features, minlength=FEATURES)
    at = np.flatnonzero(tally)
    return at.astype(np.int32), (tally[at] / max(1, tally.sum())).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and their number."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number, found = np.full(FEATURES, -1, np.int64), 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for codes, _, ends, stop in steps([value.as_py()]):
                    for _, features in ngrams(codes, ends, stop):
                        seen[features] = number
                found += seen == number
                number += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, FEATURES)), pa.array(np.append(found[at], number))],
                                         names=["feature", "n"])

    rows = docs.select(text).mapInArrow(tally, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, np.int64)
    for row in rows:  # at most one row per feature
        out[row["feature"]] = row["n"]
    return out[:-1], int(out[-1])


def follow_regularised_leader(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int,
                              epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (last row: bias) of a softmax regression, trained example by example."""
    z, n = np.zeros((FEATURES + 1, n_classes)), np.zeros((FEATURES + 1, n_classes))

    def weights(rows):
        zr, nr = z[rows], n[rows]
        w = -(zr - np.sign(zr) * L1) / ((BETA + np.sqrt(nr)) / ALPHA + L2)
        return np.where(np.abs(zr) > L1, w, 0.0)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            rows, x = np.append(samples[i][0], FEATURES), np.append(samples[i][1], 1.0)
            w = weights(rows)
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA
            z[rows] += g - sigma * w
            n[rows] += g * g
    every = weights(np.arange(FEATURES + 1))
    return every[:-1], every[-1]


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from the rows of ``labelled`` with a language and a letter-bearing text.

    Document frequencies cover all rows. About ``sample_rows`` rows, picked by a hash of
    ``order`` and text, train the weights, and ``LABEL_ROWS`` more of each language, or all
    it has, so that rare ones are learned too; every fifth fits the temperature instead.
    Rows repeated in full train once. With no labelled rows the model knows no language and
    predicts ``und``.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(text, F.col(lang).cast("string").alias("lang"), order)
    df, n = document_frequencies(rows, text)
    least = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(LABEL_ROWS) / F.count(F.lit(1)) + sample_rows / max(1, n)).alias("_share"))
    place = F.pmod(F.xxhash64(order, text, F.lit("sample")), F.lit(1 << 30))
    picked = join_lookup(rows, least, ["lang"]).where(place < F.col("_share") * (1 << 30)).select(rows.columns)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [counts(t) for t in part[text]]
            yield pd.DataFrame({"key": part[order], "lang": part["lang"], "at": [a.tobytes() for a, _ in found],
                                "share": [s.tobytes() for _, s in found]})

    kind = f"key {dict(rows.dtypes)[order]}, lang string, at binary, share binary"
    got = sorted(picked.mapInPandas(sparse, kind).distinct().collect(), key=lambda r: (str(r["key"]), r["lang"], r["at"]))
    languages = tuple(sorted({r["lang"] for r in got}))
    if not languages:
        return LanguageModel((), np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    samples = []
    for r in got:
        at = np.frombuffer(r["at"], np.int32)
        samples.append((at, SCALE * np.frombuffer(r["share"], np.float32) * idf[at]))
    labels = np.array([languages.index(r["lang"]) for r in got])
    apart = np.arange(len(got)) % 5 == 4
    train = np.flatnonzero(~apart)
    weights, bias = follow_regularised_leader([samples[i] for i in train], labels[train], len(languages))
    scores = np.array([samples[i][1] @ weights[samples[i][0]] + bias for i in np.flatnonzero(apart)])
    return LanguageModel(languages, (weights * idf[:, None]).astype(np.float32), bias, fit_temperature(scores, labels[apart]))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added, from the text alone.

    Whole texts are read. Null, empty and letterless texts give ``und`` and score 0.
    Rows, repeated ones too, and other columns stay; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 Ki features x languages, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in series:
            values = texts.tolist()
            names, scores = np.full(len(values), UNKNOWN, object), np.zeros(len(values))
            if own.languages and values:
                found, lettered = logits(values, own.weights, own.bias)
                found = found / own.temperature
                p = np.exp(found - found.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                names[lettered] = np.array(own.languages, object)[best[lettered]]
                scores[lettered] = p.max(1)[lettered]
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("__of", of(F.col(text))).withColumns(
        {"lang_pred": F.col("__of.lang_pred"), "score": F.col("__of.score")}).drop("__of")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """crc32 of the id as text, mod ``folds``, is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
