"""Hard negatives by threshold joins over an inverted index, in the manner of L2AP.

Rows are dealt to blocks, anchors too, and every block of rows meets every block of anchors in a task
(anchors are a stated query set). There the rows' index holds, dimension by dimension, only the entries
that bounds on the norm of what follows do not cover: a row whose omitted rest could not reach the
threshold alone is found by its other entries. Scores add up a few dimensions at a time, pairs whose
remaining norms cannot lift them to their threshold are given up, and the rest of the survivors' scores
is added from the omitted entries. Thresholds begin high and are lowered for those anchors and
windows that are not full yet, until all are full or nothing is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch

#: Rows and anchors to a block: what a task holds at a time.
BLOCK_ROWS = 1 << 14
BLOCK_ANCHORS = 1 << 10
#: Anchors whose partial scores are held at a time, and dimensions that are added between two prunings.
ANCHORS_AT_ONCE = 128
STRIDE = 8
#: Below this share of pairs alive they are followed one by one.
SPARSE = 1 / 16
#: Thresholds of positives, as shares of the largest score an anchor could have; then none.
LEVELS = (0.5, 0.25, 0.125, 0.0625, 0.03125)
#: Window of negatives in hundredths of the positive's score, from the highest threshold to the window's end.
WINDOW = (93, 80)
#: Larger components count as this large; their scores are added up as integers of any size.
LARGEST = 1 << 62
ROW = "vec_id bigint, rkey bigint, label bigint, q array<bigint>"


def finite(vector: Column) -> Column:
    """A vector that is there and holds only finite numbers."""
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row per vector, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.zeros((0, 0), dtype=np.int64)
    if lengths.min() == lengths.max():
        return values.reshape(len(lengths), -1)
    out = np.zeros((len(lengths), lengths.max()), dtype=values.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _tails(rows: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from each dimension on; the last column is 0."""
    squares = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(rows), 1))], axis=1))


@dataclass
class Index:
    """Rows by falling number of indexed dimensions, so that the list of each dimension is a first part of them."""
    order: np.ndarray
    place: np.ndarray
    indexed: np.ndarray
    omitted: np.ndarray
    kept: np.ndarray
    tails: np.ndarray


def build_index(rows: np.ndarray, reach: float, least: float) -> Index:
    """Index of the rows for anchors of norm ``reach`` at most and thresholds of ``least`` at least."""
    order = np.argsort(-np.einsum("ij,ij->j", rows, rows), kind="stable")
    values = rows[:, order]
    tails = _tails(values)
    # a dimension is omitted where the norm from it on cannot reach the threshold even with the longest anchor
    kept = (tails[:, :-1] * (reach * (1 + 1e-9)) >= least).sum(axis=1) if least > 0 else np.full(len(rows), rows.shape[1])
    place = np.argsort(-kept, kind="stable")
    values, kept, tails = values[place], kept[place], tails[place]
    inside = np.arange(values.shape[1]) < kept[:, None]
    return Index(order, place, np.where(inside, values, 0.0), np.where(inside, 0.0, values), kept, tails)


def pairs_above(index: Index, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is at least the anchor's threshold, up to rounding."""
    values = anchors[:, index.order]
    tails, width, every = _tails(values), values.shape[1], np.arange(len(index.kept))
    slack = 1e-6 + 1e-12 * tails[:, 0] * index.tails[:, 0].max()
    partial, at = np.zeros((len(values), len(every))), 0
    while True:
        # the norms of what has not been added: from here on, or from a row's first omitted entry on
        level = np.minimum(index.kept, at)
        alive = partial + tails[:, level] * index.tails[every, level] + slack[:, None] >= thresholds[:, None]
        if at >= width or alive.mean() < SPARSE:
            break
        to = min(at + STRIDE, width)
        held = int(np.searchsorted(-index.kept, -at, side="left"))
        partial[:, :held] += values[:, at:to] @ index.indexed[:held, at:to].T
        at = to
    i, j = np.nonzero(alive)
    score = partial[i, j]
    while at < width and len(i):
        to = min(at + STRIDE, width)
        score += np.einsum("ij,ij->i", values[i, at:to], index.indexed[j, at:to])
        level = np.minimum(index.kept[j], to)
        alive = score + tails[i, level] * index.tails[j, level] + slack[i] >= thresholds[i]
        i, j, score, at = i[alive], j[alive], score[alive], to
    for lo in range(0, len(i) if (index.kept < width).any() else 0, 1 << 14):
        cut = slice(lo, lo + (1 << 14))
        score[cut] += np.einsum("ij,ij->i", values[i[cut]], index.omitted[j[cut]])
    good = score + slack[i] >= thresholds[i]
    return i[good], index.place[j[good]], score[good]


def search(rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray):
    """(anchor, row, score) in runs of anchors: all pairs whose integer score is at least the anchor's threshold."""
    if not len(rows) or not len(anchors):
        return
    a, x = anchors.astype(float), rows.astype(float)
    exact = float(np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((x * x).sum(axis=1).max(initial=0))) < 2.0 ** 52
    order = np.argsort(-thresholds, kind="stable")
    for lo in range(0, len(order), ANCHORS_AT_ONCE):
        own = order[lo:lo + ANCHORS_AT_ONCE]
        if lo == 0 or thresholds[own[-1]] < least:
            # anchors come by falling threshold: the index grows by what the lower ones need
            least = float(thresholds[order[min(lo + 8 * ANCHORS_AT_ONCE, len(order)) - 1]])
            index = build_index(x, float(np.sqrt((a * a).sum(axis=1).max())), least)
        i, j, score = pairs_above(index, a[own], thresholds[own])
        if exact:
            score = np.rint(score).astype(np.int64)
        else:
            wide = [int(sum(int(p) * int(q) for p, q in zip(anchors[own[u]].tolist(), rows[v].tolist()))) for u, v in zip(i, j)]
            score = np.array([max(-2 ** 63, min(2 ** 63 - 1, s)) for s in wide], dtype=np.int64)
        good = score >= thresholds[own[i]]
        yield own[i[good]], j[good], score[good]


def first_of(group: np.ndarray, score: np.ndarray, tie: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each group, ties by the smaller tie numbers."""
    order = np.lexsort((*tie[::-1], -score, group))
    grouped = group[order]
    start = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]])) if len(grouped) else np.zeros(0, np.int64)
    nth = np.arange(len(grouped)) - np.repeat(start, np.diff(np.concatenate([start, [len(grouped)]])))
    return order[nth < most]


def _side(table: pa.Table) -> tuple[np.ndarray, ...]:
    """vec_id (null: the largest number, so that it comes last), rkey, label, matrix."""
    ids = table.column("vec_id").to_numpy() if not table.column("vec_id").null_count else \
        np.array([2 ** 63 - 1 if x is None else x for x in table.column("vec_id").to_pylist()], dtype=np.int64)
    q = np.clip(matrix(table.column("q")), -LARGEST, LARGEST)
    return ids, table.column("rkey").to_numpy(), table.column("label").to_numpy(), q


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _best_positives(rows: pa.Table, anchors: pa.Table, positives: int) -> pa.Table:
    """The block's best rows of each anchor's label that reach its threshold."""
    ids, keys, labels, x = _side(rows)
    _, akeys, alabels, a = _side(anchors)
    x, a = _same_width(x, a)
    found = []
    for i, j, score in search(x, a, anchors.column("threshold").to_numpy()):
        own = (labels[j] == alabels[i]) & (keys[j] != akeys[i])
        i, j, score = i[own], j[own], score[own]
        best = first_of(i, score, (ids[j], keys[j]), positives)
        found.append((i[best], j[best], score[best]))
    i, j, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return pa.table({"akey": anchors.column("rkey").take(pa.array(i)), "positive_id": rows.column("vec_id").take(pa.array(j)),
                     "pkey": rows.column("rkey").take(pa.array(j)), "positive_score": pa.array(score, pa.int64())})


def _best_negatives(rows: pa.Table, anchors: pa.Table, negatives: int) -> pa.Table:
    """The block's best rows of other labels in each window of each anchor."""
    ids, keys, labels, x = _side(rows)
    _, _, alabels, a = _side(anchors)
    x, a = _same_width(x, a)
    windows = anchors.column("windows").to_pylist()
    most = max((len(w) for w in windows), default=1)
    low, high, nth = (np.array([[w[k][c] if k < len(w) else fill for k in range(most)] for w in windows], dtype=np.int64).reshape(-1, most)
                      for c, fill in (("low", 1), ("high", 0), ("nth", 0)))
    found = []
    thresholds = np.where(low <= high, low, 2 ** 62).min(axis=1, initial=2 ** 62).astype(float)
    for i, j, score in search(x, a, thresholds):
        other = labels[j] != alabels[i]
        i, j, score = i[other], j[other], score[other]
        for k in range(most):
            inside = np.flatnonzero((score >= low[i, k]) & (score <= high[i, k]))
            best = inside[first_of(i[inside], score[inside], (ids[j[inside]], keys[j[inside]]), negatives)]
            found.append((i[best], j[best], score[best], nth[i[best], k]))
    i, j, score, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
    return pa.table({"akey": anchors.column("rkey").take(pa.array(i)), "nth": pa.array(n, pa.int32()), "negative_id": rows.column("vec_id").take(pa.array(j)),
                     "nkey": rows.column("rkey").take(pa.array(j)), "negative_score": pa.array(score, pa.int64())})


def _meet(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, find, schema: str) -> DataFrame:
    """``find`` on every block of rows with every block of anchors; both are dealt by hash, so that blocks are even."""
    blocks, groups = (max(1, -(-n // size)) for n, size in ((n_rows, BLOCK_ROWS), (n_anchors, BLOCK_ANCHORS)))

    def dealt(df: DataFrame, own: str, into: int, other: str, times: int) -> DataFrame:
        return df.withColumns({own: F.pmod(F.xxhash64("rkey", F.lit(1)), F.lit(into)),
                               other: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))}).groupBy("block", "grp")

    return dealt(rows, "block", blocks, "grp", groups).cogroup(dealt(anchors, "grp", groups, "block", blocks)).applyInArrow(find, schema)


def _first(df: DataFrame, keys: list[str], score: str, ties: list[str], most: int, rank: str) -> DataFrame:
    """The ``most`` highest scores of each group; partial ranks are cut before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *[F.col(t).asc_nulls_last() for t in ties])
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


def quantised(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, rkey, label, q): the rows that take part, with their vectors as integers, equal rows once."""
    rows = embeddings.filter(F.col("label").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("q")).distinct()
    return rows.select("vec_id", F.xxhash64("vec_id", "label", "q").alias("rkey"), "label", "q")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` are (vec_id, rkey, label, q) as :func:`quantised` gives them, ``anchors`` some of them. A score is the
    integer inner product with the anchor; higher ones come first, ties by the smaller vec_id, null last.
    An anchor's positives are its first other rows of the same label; for each, the first rows of other
    labels that score at most as much and at least 80 % of it are returned, ``rank`` from 1. Positives below 0 have
    none. Rows that repeat vec_id, label and vector are one; a vec_id with different vectors has a row,
    and as an anchor a result, for each. Shorter vectors are filled up with zeros, a vec_id that is null is no
    anchor. Components beyond 2^62 count as that, scores beyond a long as the largest. Nothing is capped:
    a block returns its best rows of each window, which are all that the window can need of it.
    """
    scratch = Scratch(rows.sparkSession)
    rows, anchors = scratch.keep(rows), scratch.keep(anchors)
    n_rows, n_anchors = rows.count(), anchors.count()
    longest = F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    largest = rows.agg(longest).first()[0] or 0.0
    own = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_positives(left, right, positives)

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_negatives(left, right, negatives)

    full, open_ = [], anchors
    for level in (*LEVELS, None):
        threshold = F.lit(float("-inf")) if level is None else F.floor(own * F.lit(level * largest)).cast("double")
        found = _meet(rows, n_rows, open_.withColumn("threshold", threshold), n_anchors, best_positives,
                      "akey bigint, positive_id bigint, pkey bigint, positive_score bigint")
        found = scratch.keep(_first(found, ["akey"], "positive_score", ["positive_id", "pkey"], positives, "nth"))
        if level is None:
            full.append(found)
            break
        enough = scratch.keep(found.groupBy("akey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= positives).select("akey"))
        full.append(found.join(enough, "akey", "left_semi"))
        open_ = scratch.keep(open_.join(enough.withColumnRenamed("akey", "rkey"), "rkey", "left_anti"))
        n_anchors = open_.count()
        if not n_anchors:
            break
    windows = full[0]
    for more in full[1:]:
        windows = windows.unionByName(more)
    # below 0 a window is empty: 80 % of the score is more than the score
    open_ = scratch.keep(windows.filter("positive_score >= 0").select("akey", "nth", "positive_id", "positive_score"))

    done = []
    for percent in WINDOW:
        low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * percent / 100).cast("bigint")
        asked = open_.groupBy(F.col("akey").alias("rkey")).agg(F.collect_list(F.struct(
            F.col("nth"), low.alias("low"), F.col("positive_score").alias("high"))).alias("windows"))
        asked = scratch.keep(anchors.join(asked, "rkey"))
        found = _meet(rows, n_rows, asked, asked.count(), best_negatives, "akey bigint, nth int, negative_id bigint, nkey bigint, negative_score bigint")
        found = scratch.keep(_first(found, ["akey", "nth"], "negative_score", ["negative_id", "nkey"], negatives, "rank"))
        met = open_.join(found, ["akey", "nth"])
        if percent == WINDOW[-1]:
            done.append(met)
            break
        enough = scratch.keep(found.groupBy("akey", "nth").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= negatives).select("akey", "nth"))
        done.append(met.join(enough, ["akey", "nth"], "left_semi"))
        open_ = scratch.keep(open_.join(enough, ["akey", "nth"], "left_anti"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    names = anchors.select(F.col("rkey").alias("akey"), F.col("vec_id").alias("anchor_id"))
    return out.join(names, "akey").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
