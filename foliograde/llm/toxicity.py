"""Toxicity of whole texts: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

Features are the presence of single words, pairs of neighbours and pairs with one word between, hashed into
2**20 places.  Every place has its own learning rate, and the L1 term leaves most weights at zero, so the model is a
small list of weights that goes to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograde.llm.words import ALNUM, Words, mix, parts_of, words_of

BITS = 20
#: Most labelled rows the model is fitted on: those with the least hash of their id.
TRAINING_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 10.0, 0.3, 5


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all features of a batch, in no order, with repeats."""
    h, row = words.hash, words.row
    rows, keys = [row], [h]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        rows.append(row[:len(same)][same])
        keys.append(mix(h[:len(same)][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | place)
    return both >> BITS, both & ((1 << BITS) - 1)


def fitted(samples: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, weights and intercept from (label, places) samples, taken in the order given, several times."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(EPOCHS):
        for label, places in samples:
            at = np.append(places, size)  # the last place is the intercept
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(size + 1))
    places = np.flatnonzero(w[:size])
    return places, w[places], float(w[size])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic.  Null labels and ids are left out; of several labels of a
    document the largest counts.  Without rows of both kinds the model is empty and scores 0 everywhere.
    """
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    chosen = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in parts_of(batch.column(batch.schema.get_field_index("text"))):
                row, place = _distinct(*_features(words_of(part, ALNUM)))
                ends = np.searchsorted(row, np.arange(len(part) + 1))
                packed = [place[ends[i]:ends[i + 1]].astype(np.int32).tobytes() for i in range(len(part))]
                own = batch.slice(done, len(part))
                done += len(part)
                yield pa.record_batch(
                    [own.column(own.schema.get_field_index("order")), own.column(own.schema.get_field_index("toxic")), pa.array(packed, pa.binary())],
                    names=["order", "toxic", "places"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [(o, p, int(t)) for b in batches for o, t, p in zip(*(b.column(i).to_pylist() for i in range(3)))]
        samples.sort()
        if len({t for _, _, t in samples}) < 2:
            return
        places, weights, start = fitted([(t, np.frombuffer(p, np.int32).astype(np.int64)) for _, p, t in samples])
        yield pa.record_batch([pa.array(np.append(places, -1)), pa.array(np.append(weights, start))], names=["place", "weight"])

    packed = texts.select("text", "order", "toxic").mapInArrow(features, "order long, toxic int, places binary")
    model = packed.repartition(1).mapInArrow(fit, "place long, weight double").toArrow()  # weights that are not zero
    places, weights = model.column("place").to_numpy(), model.column("weight").to_numpy()
    found = dict(zip(places.tolist(), weights.tolist()))
    return {"start": found.pop(-1, None), "weights": found}


def score(text: Column, model: dict) -> Column:
    """Score of a text from 0 to 1; higher means that the label 1 is likelier.  Null and empty texts get the
    intercept's score.  Whole texts are read, however long."""
    start = model["start"]
    if start is None:
        return F.lit(0.0)
    places = np.fromiter(model["weights"].keys(), np.int64, len(model["weights"]))
    weights = np.fromiter(model["weights"].values(), np.float64, len(model["weights"]))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        table = np.zeros(1 << BITS)
        table[places] = weights
        found = [np.zeros(0)]
        for part in parts_of(texts):
            row, place = _features(words_of(part, ALNUM))
            used = table[place] != 0
            row, place = _distinct(row[used], place[used])
            total = np.bincount(row, weights=table[place], minlength=len(part)) + start
            found.append(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))
        return pa.array(np.concatenate(found))

    return scored(text)


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct), doc_id, held_out (crc32 of the id mod 5 is 0; null id: false),
    score and predicted (1 from a score of 0.5 on) for each row; repeated rows get equal scores."""
    model = train(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", held.alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with all their columns."""
    return with_scores(docs, labels).where("predicted = 0").select("row.*")
