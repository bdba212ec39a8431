"""Toxicity by a linear classifier on character n-grams with naive Bayes log-count ratios.

A text's features are the character n-grams it holds, hashed to a fixed number of buckets. Each
present feature counts as much as the logarithm of how much more frequent it is in toxic
texts than in clean ones, and a logistic regression is fitted to these scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm import words as W
from voxmill.llm.common import Scratch, small_batches

BITS = 20
#: Fixed odd multipliers, one per place of an n-gram and a last one that mixes.
PLACES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)
MIX = 0x2C1B3C6D
#: Characters that are worked on at a time, unless a single text is longer.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Model:
    """A weight for each bucket (0 for most) and the intercept."""
    weights: np.ndarray
    intercept: float


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters, with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, texts[first:]


def _features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all n-grams of 3 to 5 characters, each once; only buckets that are wanted, if given."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(lowered).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
    rolled = np.zeros(len(codes), dtype=np.uint32)
    found = []
    for place, by in enumerate(PLACES):
        n = place + 1
        rolled = rolled[: max(0, len(codes) - place)] + codes[place:] * np.uint32(by)
        if n < 3 or not len(rolled):
            continue
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(MIX) + np.uint32(n * 0x1B56C4E9 & 0xFFFFFFFF)
        bucket = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(PLACES[0]) >> np.uint32(32 - BITS)
        at = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        text = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[np.minimum(text, len(ends) - 1)]
        found.append((text[inside].astype(np.int64) << BITS) | bucket[at[inside]])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _log_odds(hot: np.ndarray, cold: np.ndarray, n_hot: int, n_cold: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``kept`` buckets that tell most, and their naive Bayes log-count ratios, from the number of
    toxic and of clean texts that hold each bucket."""
    ratio = np.log((hot + 1) / (n_hot + 2)) - np.log((cold + 1) / (n_cold + 2))
    both, n = hot + cold, n_hot + n_cold
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (np.where(hot > 0, hot * np.log(hot * n / (both * n_hot)), 0)
                + np.where(cold > 0, cold * np.log(cold * n / (both * n_cold)), 0))
        # texts without the n-gram tell as well
        gain += (np.where(n_hot > hot, (n_hot - hot) * np.log((n_hot - hot) * n / (n_hot * np.maximum(n - both, 1))), 0)
                 + np.where(n_cold > cold, (n_cold - cold) * np.log((n_cold - cold) * n / (n_cold * np.maximum(n - both, 1))), 0))
    gain[both < 2] = 0
    best = np.argsort(-gain, kind="stable")[:kept]
    best = best[gain[best] > 0]
    return best, ratio[best]


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float,
              steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss with an L2 penalty; the intercept is free."""
    n = max(1, len(y))
    v = np.full(width, 1.0)
    bound = 1.0
    for _ in range(20):
        z = np.bincount(rows, values * v[cols], minlength=n) if width else np.zeros(n)
        u = np.bincount(cols, values * z[rows], minlength=width) if width else v
        bound = float(np.linalg.norm(u)) / max(1e-12, float(np.linalg.norm(v)))
        v = u / max(1e-12, float(np.linalg.norm(u)))
    rate = 1.0 / (0.25 * (bound + n) / n + l2)
    w, b = np.zeros(width), 0.0
    w0, b0 = w, b
    for k in range(steps):
        pace = k / (k + 3)
        wy, by = w + pace * (w - w0), b + pace * (b - b0)
        z = np.bincount(rows, values * wy[cols], minlength=n) + by
        slip = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w0, b0 = w, b
        w = wy - rate * (np.bincount(cols, values * slip[rows], minlength=width) / n + l2 * wy)
        b = by - rate * float(slip.mean() if len(slip) else 0.0)
    return w, b


def fit_rows(texts: list[str], toxic: np.ndarray, share: float, kept: int = 4096, l2: float = 1e-3, steps: int = 600) -> Model:
    """Fit on a sample; ``share`` is the share of toxic rows among all labelled ones, for the intercept."""
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        # one class only: nothing can be told apart
        return Model(weights, 10.0 if len(toxic) and toxic.max() else -10.0)
    # first pass: how many texts of each class hold a bucket; second pass: only the buckets that are kept
    held = np.zeros((2, 1 << BITS))
    for first, chunk in _chunks(texts):
        rows, cols = _features(chunk)
        for c in (0, 1):
            held[c] += np.bincount(cols[toxic[first + rows] == c], minlength=1 << BITS)
    best, ratio = _log_odds(held[1], held[0], int(toxic.sum()), int((1 - toxic).sum()), kept)
    place = np.full(1 << BITS, -1)
    place[best] = np.arange(len(best))
    parts = [(rows + first, cols) for first, chunk in _chunks(texts) for rows, cols in [_features(chunk, place >= 0)]]
    rows, cols = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (0, 1))
    cols = place[cols]
    w, b = _logistic(rows, cols, ratio[cols], toxic.astype(float), len(best), l2, steps)
    weights[best] = w * ratio
    sampled = toxic.mean()
    return Model(weights, b + float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    wanted = model.weights != 0
    out = np.full(len(texts), model.intercept)
    for first, chunk in _chunks(texts):
        rows, cols = _features(chunk, wanted)
        out[first:first + len(chunk)] += np.bincount(rows, model.weights[cols], minlength=len(chunk))[: len(chunk)]
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, class_bytes: int) -> DataFrame:
    """(text, toxic) of the labelled rows to fit on, written to the shared folder: at most ``per_class`` rows and
    ``class_bytes`` bytes of each class.

    Labels are taken by the smallest hash of doc_id. Where rows repeat a doc_id, the text with the smallest
    hash counts. Texts are whole: those that would exceed the bytes are left out.
    """
    chosen = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class ids
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = Scratch(docs.sparkSession).keep(found.filter(F.octet_length("text") <= class_bytes).groupBy("doc_id", "toxic").agg(
        F.min(F.struct(F.xxhash64("text").alias("tkey"), "text"))["text"].alias("text")))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    return rows.withColumn("_bytes", F.sum(F.octet_length("text").cast("bigint")).over(before)).filter(F.col("_bytes") <= class_bytes).select("text", "toxic")


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    parts = [score_texts(model, [t or "" for t in run.to_pylist()]) for _, run in W.runs(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, class_bytes: int = 16 << 20) -> Model:
    """Fit on at most ``per_class`` labelled rows and ``class_bytes`` bytes of each class (see :func:`sample`).

    These bounds are what the classifier is fitted on; labels of all rows give the share of toxic
    ones. Labels that are null or have no document are left out; a doc_id with labels of both kinds
    counts for both. All tasks look for the rows; one task reads what they found and fits, a run of texts
    at a time, and returns one row.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int")).distinct()
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-6), 1 - 1e-6)
    rows = sample(docs, known, per_class, class_bytes)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += [t or "" for t in b.column("text").to_pylist()]
            toxic += b.column("toxic").to_pylist()
        m = fit_rows(texts, np.array(toxic, dtype=np.int64), share)
        at = np.flatnonzero(m.weights)
        yield pa.RecordBatch.from_pydict({"at": [at.tolist()], "weight": [m.weights[at].tolist()], "intercept": [m.intercept]},
                                         schema=pa.schema([("at", pa.list_(pa.int64())), ("weight", pa.list_(pa.float32())),
                                                           ("intercept", pa.float64())]))

    got = rows.coalesce(1).mapInArrow(fitted, "at array<bigint>, weight array<float>, intercept double").collect()
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not got:
        return Model(weights, -10.0)
    weights[np.array(got[0]["at"], dtype=np.int64)] = np.array(got[0]["weight"], dtype=np.float32)
    return Model(weights, got[0]["intercept"])


def score(docs: DataFrame, model: Model, *keys: str) -> DataFrame:
    """The named columns and ``score`` (0 to 1) of every row; a null text scores as an empty one.

    Every n-gram of the whole text counts. Repeated rows score alike, empty tables give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keys)
    fields = [f for f in docs.schema.fields if f.name in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"])
    fields = [f.name for f in fields]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _scores(shared.value, b.column("text_"))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields), pa.array(values)], names=[*fields, "score"])

    return small_batches(docs).select(*fields, F.col("text").alias("text_")).mapInArrow(scored, schema)


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row (see :func:`train` and :func:`score`)."""
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model, "doc_id").select("doc_id", held_out().alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with all their columns, whatever these are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _scores(shared.value, b.column("text"))
            yield b.filter(pa.array(values < limit))

    return small_batches(docs).mapInArrow(keep, docs.schema)
