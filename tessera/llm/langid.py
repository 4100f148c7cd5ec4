"""Language ID: multinomial naive Bayes over hashed character n-grams.

``train`` counts n-grams of 1 to ``ORDERS`` lower-cased characters, hashed to
``BUCKETS``, per language. It reads at most about ``per_language`` rows of each language,
chosen by a hash of the row (a bound on the sample, not on what is predicted); class
priors come from all labelled rows. ``identify`` adds a prediction for every row: the
n-grams of a batch of texts form one sparse document-by-bucket matrix, whose product with
the broadcast matrix of log probabilities gives the scores of all its documents.

The posterior of a text says which language is likeliest, not whether it is any of them.
For that there is ``fit``: the mean log probability of an n-gram under the predicted
language, drawn towards that language's own mean by ``DRAW`` n-grams so that short texts
vary no more than long ones, less the lowest value of its training texts.

Null text, empty text and text without a letter (``\\p{L}``) get ``und`` with score 0, as
does every row if nothing could be learned. Ties go to the language that sorts first.
Repeated rows are predicted alike; very long texts are scored whole, in pieces that overlap
so that no n-gram is lost or counted twice; an empty table gives an empty result. Other
columns pass through untouched (an output replaces a column of its name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

ORDERS, BUCKETS, MAX_LANGUAGES = 3, 1 << 15, 512
UNDETERMINED = "und"
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: N-grams of a batch that are scored at once, and n-grams that draw ``fit`` to the mean.
BATCH, DRAW = 1 << 21, 200


@dataclass(frozen=True)
class Model:
    """``weights``: languages x BUCKETS log probabilities; ``mean`` and ``floor``: mean log
    probability of an n-gram over the training texts, and the lowest drawn mean of one."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    floor: np.ndarray


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket ids of all n-grams of a text, in arrays of bounded size: each n-gram once."""
    text = text.lower()
    for k in range(0, len(text), PIECE):
        c = np.frombuffer(text[k : k + PIECE + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, ORDERS + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :]
            m = (h[:PIECE] + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
            yield (m ^ (m >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 4000, key: str = "doc_id", calibrate: bool = False) -> Model:
    """Learn from the rows of ``labelled`` whose text and language are not null; ``calibrate``
    reads the sample again for the floors of ``fit``, which without it are all met."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("g"), F.col(key).alias("k")).filter("t is not null and g is not null")
    totals = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = tuple(sorted(totals))
    if not names:
        return Model((), np.zeros((0, BUCKETS)), np.zeros(0), np.zeros(0), np.zeros(0))
    rate = F.create_map(*[x for g in names for x in (F.lit(g), F.lit(min(1.0, per_language / totals[g])))])[F.col("g")]
    draw = F.pmod(F.xxhash64(F.lit("langid"), "k"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(draw < rate).select("t", "g").repartition(16)
    index = {g: i for i, g in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in _buckets(t):
                    seen[index[g]] += np.bincount(b, minlength=BUCKETS)
        g, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(seen[g, b])], names=["g", "b", "n"])

    # At most languages x BUCKETS rows, whatever the size of the corpus.
    sums = sample.mapInArrow(count, "g int, b int, n long").groupBy("g", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.ones((len(names), BUCKETS))
    table[sums["g"].to_numpy(int), sums["b"].to_numpy(int)] += sums["n"].to_numpy(float)
    weights = np.log(table / table.sum(axis=1, keepdims=True))
    n = np.array([totals[g] for g in names], float)
    model = Model(names, weights, np.log(n / n.sum()), ((table - 1) * weights).sum(axis=1) / np.maximum(1, (table - 1).sum(axis=1)), np.full(len(names), -np.inf))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full(len(names), np.inf)
        for batch in batches:
            own = np.array([index[g] for g in batch.column(1).to_pylist()], np.int64)
            sums, grams = log_likelihoods(model, batch.column(0).to_pylist())
            if len(own):
                np.minimum.at(low, own, (sums[np.arange(len(own)), own] + DRAW * model.mean[own]) / (grams + DRAW))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names), dtype=np.int32)), pa.array(low)], names=["g", "low"])

    if not calibrate:
        return model
    # One row a language and task of the bounded sample.
    lows = {r["g"]: r["low"] for r in sample.mapInArrow(lowest, "g int, low double").groupBy("g").agg(F.min("low").alias("low")).collect()}
    return replace(model, floor=np.array([lows.get(g, -np.inf) for g in range(len(names))]))


def log_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities (texts x languages), and n-grams of each text.

    The batch is a sparse matrix, text by bucket, held as its bucket ids and the row of each
    run of them; it is multiplied in slices of about BATCH entries."""
    sums, grams = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    ids: list[np.ndarray] = []
    rows: list[int] = []
    held = 0

    def multiply() -> None:
        nonlocal held
        if ids:
            flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
            for g, weight in enumerate(model.weights):
                np.add.at(sums[:, g], rows, np.add.reduceat(weight.take(flat), starts))
        ids.clear(), rows.clear()
        held = 0

    for i, text in enumerate(texts):
        for b in _buckets(text):
            ids.append(b), rows.append(i)
            grams[i] += len(b)
            held += len(b)
            if held >= BATCH:
                multiply()
    multiply()
    return sums, grams


def scores(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted languages, their posterior probabilities, and how well each fits."""
    open_rows = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
    names, odds, fit = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    if open_rows:
        sums, grams = log_likelihoods(model, [texts[i] for i in open_rows])
        total = sums + model.prior
        best = total.argmax(axis=1)
        at = np.arange(len(best))
        odds[open_rows] = 1.0 / np.exp(total - total[at, best][:, None]).sum(axis=1)
        fit[open_rows] = (sums[at, best] + DRAW * model.mean[best]) / (grams + DRAW) - model.floor[best]
        for i, g in zip(open_rows, best):
            names[i] = model.languages[g]
    return names, odds, fit


def identify(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", fit_out: str | None = None) -> DataFrame:
    """``docs`` with predicted language, score and, if asked for, fit. The matrix is
    broadcast: its size is bounded by MAX_LANGUAGES x BUCKETS doubles."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang string, score double, fit double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(dict(zip(("lang", "score", "fit"), scores(shared.value, part.tolist()))))

    temp = "__tessera_language"
    while temp in docs.columns:
        temp += "_"
    out = docs.withColumn(temp, predict(F.col(text))).withColumn(lang_out, F.col(temp)["lang"]).withColumn(score_out, F.col(temp)["score"])
    return (out.withColumn(fit_out, F.col(temp)["fit"]) if fit_out else out).drop(temp)


def held_out(key: str = "doc_id"):
    """Column: true for rows of the fold kept away from training."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Pipeline filter: out go rows without a letter, rows whose best language is not more
    likely than ``min_score``, and rows that fit it worse than all of its training texts do;
    everything else stays unchanged."""
    model = train(docs.filter(~held_out()), calibrate=True)
    names = ["__tessera_lang", "__tessera_score", "__tessera_fit"]
    found = identify(docs, model, lang_out=names[0], score_out=names[1], fit_out=names[2])
    return found.filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) > min_score) & (F.col(names[2]) >= -1e-9)).select(*docs.columns)
