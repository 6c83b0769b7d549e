"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words, hashed to 24 bits inside the JVM. The score is a bias,
a weight per term, and for every two terms the inner product of their factors, so a
pair can count for more than its two terms apart. The model is fitted on a bounded
sample of labelled rows. Terms whose labels are no different from chance, common
ones apart, carry no weight, and weights start from smoothed log odds. All texts are scored whole, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.llm.columns import require, unused, whole_text
from velospan.llm.memory import give_back

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
TERM_BITS = 24
#: A term is in the model if its texts' labels differ from the rest by this likelihood ratio,
#: or if it is common: in this share of the sample and this many texts, so that pairs with it can be learnt.
LEAST_RATIO, COMMON_SHARE, COMMON_TEXTS = 15.0, 0.01, 100
FACTORS = 4
#: Passes over the sample, and steps at least: a small sample is passed over more often, until its weights settle.
EPOCHS, LEAST_STEPS = 20, 400
BATCH_TEXTS, RATE, DECAY, FACTOR_DECAY = 256, 0.05, 1e-4, 5e-4
# Everything but ASCII digits, ASCII letters and non-ASCII characters separates words.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str) -> Column:
    """The distinct hashed words of a text, letters in lower case."""
    parts = F.array_remove(F.split(F.lower(whole_text(text)), _BETWEEN_WORDS), "")
    return F.array_distinct(F.transform(parts, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << TERM_BITS)).cast("int")))


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    """Sorted terms with their weights and factors, and the bias."""

    bias: float
    keys: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; text i has the terms values[starts[i]:starts[i + 1]]."""
        n = len(starts) - 1
        if not len(self.keys):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        known = self.keys[at] == values
        at, text = at[known], np.repeat(np.arange(n), np.diff(starts))[known]
        score = self.bias + np.bincount(text, self.weights[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            score += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return score


def _telling(ones: np.ndarray, times: np.ndarray, prior: float, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which terms the model holds, and their log odds against the prior, shrunk by one text."""
    rate = ones / times
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(ones * np.log(rate / prior)) + np.nan_to_num(
            (times - ones) * np.log((1 - rate) / (1 - prior))
        )
    told = 2 * gain >= LEAST_RATIO
    odds = np.log((ones + prior) / (times - ones + 1 - prior)) - np.log(prior / (1 - prior))
    return told | (times >= max(COMMON_TEXTS, COMMON_SHARE * texts)), np.where(told, odds, 0.0)


def fit(lists: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit by adaptive gradient steps on the log loss; the same rows give the same model.

    Without rows, or with labels of one kind only, the model is a smoothed bias alone.
    """
    labels = np.asarray(labels, float)
    prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    lengths = np.array([len(x) for x in lists], np.int64)
    values = np.concatenate(lists) if lists else np.empty(0, np.int64)
    found, place, times = np.unique(values, return_inverse=True, return_counts=True)
    if len(np.unique(labels)) < 2 or not len(found):
        common, odds = np.zeros(len(found), bool), np.zeros(len(found))
    else:
        common, odds = _telling(np.bincount(place, np.repeat(labels, lengths), len(found)), times, prior, len(labels))
    if not common.any():
        return Model(bias, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    number = np.cumsum(common) - 1
    kept = common[place]
    texts = np.repeat(np.arange(len(lists)), lengths)[kept]
    columns = number[place[kept]]
    starts = np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=len(lists)))])
    keys, n = found[common], int(common.sum())
    rng = np.random.default_rng(7)
    w, v = odds[common].copy(), rng.normal(0, 0.03, (n, FACTORS))
    seen_w, seen_v, seen_b = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    steps = -(-len(lists) // BATCH_TEXTS)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // steps))):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), BATCH_TEXTS):
            batch = order[at : at + BATCH_TEXTS]
            counts = starts[batch + 1] - starts[batch]
            ends = np.cumsum(counts)
            gather = np.arange(ends[-1]) + np.repeat(starts[batch] - (ends - counts), counts)
            c, row = columns[gather], np.repeat(np.arange(len(batch)), counts)
            used, local = np.unique(c, return_inverse=True)
            sums = np.stack([np.bincount(row, v[c, f], len(batch)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(row, (v[c] ** 2).sum(axis=1), len(batch))
            z = bias + np.bincount(row, w[c], len(batch)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            each = error[row]
            step = np.bincount(local, each, len(used)) + DECAY * w[used]
            seen_w[used] += step**2
            w[used] -= RATE * step / np.sqrt(seen_w[used])
            for f in range(FACTORS):
                step = np.bincount(local, each * (sums[row, f] - v[c, f]), len(used)) + FACTOR_DECAY * v[used, f]
                seen_v[used, f] += step**2
                v[used, f] -= 0.5 * RATE * step / np.sqrt(seen_v[used, f])
            step = error.sum()
            seen_b += step**2
            bias -= RATE * step / np.sqrt(seen_b)
    return Model(float(bias), keys.astype(np.int64), w, v)


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([*batches, pd.DataFrame({"doc_id": [], "label": [], "terms": []})])
    rows = rows.sort_values(["doc_id", "label"], kind="stable", na_position="last")
    model = fit([np.asarray(x, np.int64) for x in rows["terms"]], rows["label"].to_numpy())
    yield pd.DataFrame({
        "bias": [model.bias],
        "keys": [model.keys],
        "weights": [model.weights],
        "factors": [model.factors.ravel()],
    })
    del rows, model
    give_back()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled documents whose id's remainder is not 0, at most ``SAMPLE_ROWS`` of them.

    Labels are sampled by a hash of the id before any text is read, so the texts of the
    sample reach the fit by a join with a table of bounded size, and nothing else moves.
    Null labels, labels without a document and documents without a label are left out.
    """
    require(docs, doc_id, text)
    require(labels, doc_id, label)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & (remainder("doc_id") != 0))
    share = 0.95 * SAMPLE_ROWS / max(1, known.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    sample = F.broadcast(known.filter(place < share).limit(SAMPLE_ROWS))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = texts.join(sample, "doc_id").select("doc_id", "label", terms("text").alias("terms")).limit(SAMPLE_ROWS)
    schema = "bias double, keys array<bigint>, weights array<double>, factors array<double>"
    # One task fits the bounded sample; one row, of the sample's terms, comes back.
    row = rows.repartition(1).mapInPandas(_fit_batches, schema).first()
    if row is None:
        return fit([], np.empty(0))
    factors = np.array(row["factors"], float).reshape(-1, FACTORS)
    return Model(row["bias"], np.array(row["keys"], np.int64), np.array(row["weights"], float), factors)


def score(model: Model, hashed: Column) -> Column:
    """The probability of label 1 for an array of hashed terms."""

    @F.arrow_udf(T.DoubleType())
    def scored(lists: pa.Array) -> pa.Array:
        starts = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.int64)
        made = pa.array(1 / (1 + np.exp(-np.clip(model.logits(values, starts - starts[0]), -500, 500))))
        give_back()
        return made

    return scored(hashed)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``predicted`` (columns so named are replaced).

    Null and empty texts have no terms and get the bias. Repeated rows get equal scores.
    An empty table gives an empty table; without labels the score is one half.
    """
    model = train(docs, labels, doc_id, text, label)
    scored = docs.withColumn("held_out", remainder(doc_id) == 0).withColumn("score", score(model, terms(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with the columns of ``docs``.

    A model without terms, as without labels of both kinds, tells no text from another: all rows stay.
    """
    model = train(docs, labels, doc_id, text)
    if not len(model.keys):
        return docs
    name = unused(docs, "_toxicity")
    return docs.withColumn(name, score(model, terms(text))).filter(F.col(name) < 0.5).drop(name)
