"""Text quality by similarity-weighted votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_PER_LABEL = 2_048  # most labelled rows of each label that take part: bounds the model, whatever the labels' number
DIMENSIONS = 48  # of the latent space
NEIGHBOURS = 25  # that vote
SHARPNESS = 8.0  # power of the similarity that weighs a vote
THRESHOLD = 0.3  # least score of a kept document
_GROUPS, _HASHED = 32, 2_048  # kinds of bytes; places for byte trigrams
_FEATURES = _GROUPS * _GROUPS + _HASHED
_PIECE = 1 << 20  # bytes counted at a time
_BLOCK = 1_024  # documents compared at a time


def _kinds() -> np.ndarray:
    """The kind of each byte: lower case, capital, digit, part of a longer character, or a sign of its own."""
    kinds = np.zeros(256, dtype=np.int64)
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 3
    kinds[128:] = 4
    for place, sign in enumerate(b" \n\t.,;:!?|*#$%&-_/\\()<>@'\"=", start=5):
        kinds[sign] = place
    return kinds


_KINDS = _kinds()


def features(text: bytes | None) -> np.ndarray:
    """Square roots of the shares of neighbouring kinds of bytes, and of hashed byte trigrams, over the whole text."""
    counts = np.zeros(_FEATURES)
    text = text or b""
    for start in range(0, len(text), _PIECE):
        raw = np.frombuffer(text[start : start + _PIECE + 2], dtype=np.uint8)
        kind = _KINDS[raw[: _PIECE + 1]]
        counts[: _GROUPS * _GROUPS] += np.bincount(kind[:-1] * _GROUPS + kind[1:], minlength=_GROUPS * _GROUPS)
        code = raw.astype(np.uint32)
        mixed = (code[:-2] * np.uint32(65_536) + code[1:-1] * np.uint32(256) + code[2:]) * np.uint32(2_654_435_761)
        counts[_GROUPS * _GROUPS :] += np.bincount(mixed >> np.uint32(21), minlength=_HASHED)
    for part in (slice(None, _GROUPS * _GROUPS), slice(_GROUPS * _GROUPS, None)):
        counts[part] = np.sqrt(counts[part] / max(counts[part].sum(), 1))
    return counts


@dataclass
class Model:
    """At most 2 * SAMPLE_PER_LABEL labelled vectors and the projection to their space: a few megabytes."""

    centre: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        return self.unit((rows - self.centre) @ self.axes)

    @staticmethod
    def unit(latent: np.ndarray) -> np.ndarray:
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1. Votes of the two labels weigh alike, however many rows of each were taken."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosines = self.project(rows) @ self.vectors.T
        most = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, most - 1, axis=1)[:, :most]
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** SHARPNESS * self.weights[near]
        return (votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: a fifth by the checksum of the key; also those without a key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from at most SAMPLE_PER_LABEL rows of each label, those with the smallest hash of their key.

    Held-out rows and rows whose label is neither 0 nor 1 are left out; a key labelled twice counts with its larger
    label, a key of several documents with one of them. Features are made on the executors; the driver gets at most
    2 * SAMPLE_PER_LABEL rows of them and finds the latent axes. Without usable rows every score will be 0.5.
    """
    usable = (
        labels.where(~held_out(key) & F.col(label).isin(0, 1))
        .groupBy(F.col(key).cast("long").alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    picked = [
        usable.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_PER_LABEL) for value in (0, 1)
    ]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * SAMPLE_PER_LABEL short rows

    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([features(value).astype(np.float32).tobytes() for value in part], dtype=object)

    rows = (
        docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
        .join(chosen, "key")
        .groupBy("key", "label")
        .agg(F.min("text").alias("text"))
        .select("key", "label", packed("text").alias("features"))
        .toPandas()
        .sort_values("key")
    )
    marks = rows["label"].to_numpy(dtype=np.float64)
    if not len(marks):
        empty = np.zeros((0, DIMENSIONS))
        return Model(np.zeros(_FEATURES), np.zeros((_FEATURES, DIMENSIONS)), empty, marks, marks)
    wide = np.stack([np.frombuffer(value, dtype=np.float32) for value in rows.pop("features")])  # 50 MB at most
    centre = wide.mean(axis=0, dtype=np.float64)
    wide -= centre.astype(np.float32)
    axes = _leading_axes(wide)
    sizes = np.array([(marks == 0).sum(), (marks == 1).sum()])
    weights = 1 / sizes[marks.astype(int)]
    model = Model(centre, axes, np.zeros((0, DIMENSIONS)), marks, weights)
    model.vectors = model.unit(wide @ axes)
    return model


def _leading_axes(rows: np.ndarray) -> np.ndarray:
    """The space of the largest singular values, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(7).standard_normal((rows.shape[1], DIMENSIONS)).astype(rows.dtype)
    for _ in range(8):
        axes = np.linalg.qr(rows.T @ (rows @ axes))[0]
    return axes.astype(np.float64)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column for ``docs``: the quality of each row's whole text from 0 to 1; NULL counts as empty.

    Every document is compared with every labelled vector of the model, a block of documents at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            found = [
                shared.value.scores(np.stack([features(value) for value in part.iloc[start : start + _BLOCK]]))
                for start in range(0, len(part), _BLOCK)
            ]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return of(F.col(text).cast("binary"))
