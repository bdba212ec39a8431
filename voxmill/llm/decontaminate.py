"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The index holds the test items; every passage of every document is a query. Postings are cut
into blocks of consecutive items, each with its highest score. A passage skips a block when the
block maxima of its words stay below what any item of the block must reach, and only items of the
blocks that are left are scored. Items that reach their threshold are verified word for word.

The threshold of an item is the least score that a passage can have which passes the verification,
so that no contaminated passage is lost: the sum of all its words' scores less the highest scores
of as many words as may be missing.

A passage holds an item if it holds enough of the shingles of both its question and its answer, or
of the whole item: an answer has few shingles, one changed word in it would hide a copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import words as W
from voxmill.llm.common import WORD, Scratch, md5_draw, running_sum, same, small_batches, text_key

K1, B = 1.2, 0.75
#: Items in a block of postings.
BLOCK_ITEMS = 8
#: Words that more than this share of the items have are left out of the first bound, which counts them as present.
COMMON = 0.1
#: Words at least in the question's and the answer's part of an item, if it has as many.
PART_WORDS = 10
#: Numbers in the table of bounds, passages times blocks of items, that are held at a time.
CELLS = 1 << 22
PAIR = ("doc_id", "tkey", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap")


@dataclass
class Index:
    """An index of a bounded number of items. Postings are in order of term, then item."""
    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    common: np.ndarray
    threshold: np.ndarray
    block_first: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_need: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    whole: list[np.ndarray]
    width: np.ndarray
    step: int


def parts(n_words: int) -> tuple[int, int]:
    """Where the question ends and where the answer begins: its last quarter; short parts are widened."""
    answer = max(n_words // 4, min(PART_WORDS, n_words))
    question = max(n_words - n_words // 4, min(PART_WORDS, n_words))
    return question, n_words - answer


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return W.shingles(words, np.array([0, len(words)]), width)[0]


def build_index(ids: list[int], texts: list[str], df: dict[int, int], n_items: int, mean_words: float, longest: int,
                overlap: float) -> Index:
    """``df`` has the number of all items (not only these) that hold a word, by the word's hash; ``longest`` and
    ``mean_words`` are of all items too, so that a result does not depend on the items that share an index."""
    split = W.split(pa.array(texts, pa.string()))
    hashes = split.hashes(lower=True)
    question, answer, whole, rows, threshold = [], [], [], [], np.zeros(len(ids))
    width = np.minimum(split.counts(), W.SHINGLE)
    terms = np.unique(hashes)
    for i in range(len(ids)):
        own = hashes[split.first[i]:split.first[i + 1]]
        to, since = parts(len(own))
        sets = [np.unique(_shingles(p, int(width[i]))) for p in (own[:to], own[since:], own)]
        for part, held in zip((question, answer, whole), sets):
            part.append(held)
        t, tf = np.unique(own, return_counts=True)
        n_df = np.array([df[int(x)] for x in t], dtype=float)
        weight = np.log(1 + (n_items - n_df + 0.5) / (n_df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / max(mean_words, 1)))
        lost = [int((1 - overlap) * len(held) + 1e-9) for held in sets]
        missing = max(lost[0] + lost[1], lost[2])
        threshold[i] = weight.sum() - np.sort(weight)[::-1][:missing].sum() - 1e-6
        rows.append((np.searchsorted(terms, t), np.full(len(t), i), weight))
    term, item, weight = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, int) for k in range(3))
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order].astype(np.int64), weight[order].astype(float)
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    common = np.array([df[int(t)] for t in terms]) > max(1.0, COMMON * n_items)
    # blocks of postings: the highest weight of a term among BLOCK_ITEMS consecutive items
    key = term * (len(ids) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    block_max = np.maximum.reduceat(weight, starts) if len(starts) else np.zeros(0)
    block, block_term = item[starts] // BLOCK_ITEMS, term[starts]
    n_blocks = -(-len(ids) // BLOCK_ITEMS)
    spared = np.bincount(block[common[block_term]], block_max[common[block_term]], minlength=n_blocks) if len(starts) else np.zeros(n_blocks)
    least = np.array([threshold[k * BLOCK_ITEMS:(k + 1) * BLOCK_ITEMS].min() for k in range(n_blocks)])
    return Index(np.array(ids, dtype=np.int64), terms, first, item, weight, common, threshold,
                 np.searchsorted(block_term, np.arange(len(terms) + 1)), block, block_max, least - spared, question, answer, whole,
                 width, max(longest, W.SHINGLE))


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, posting): the postings of each term, and the place of the term they are of."""
    n = first[terms + 1] - first[terms]
    which = np.repeat(np.arange(len(terms)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[terms], n)


def search(index: Index, hashes: np.ndarray, first: np.ndarray, overlap: float) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item, score, question, answer and item overlap) of all verified pairs, the best passage of each."""
    step = index.step
    counts = np.diff(first)
    n_passages = np.maximum(1, -(-np.maximum(counts - step, 0) // step)) * (counts > 0)
    base = np.concatenate([[0], np.cumsum(n_passages)])
    if not base[-1] or not len(index.terms):
        return []
    place = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[place] == hashes)
    text = np.searchsorted(first, hit, side="right") - 1
    chunk = (hit - first[text]) // step
    # a word is in the passage that begins at its own stretch and in the one before
    own, before = np.minimum(chunk, n_passages[text] - 1) + base[text], chunk - 1 + base[text]
    there = (chunk >= 1) & (chunk - 1 < n_passages[text] - 1)
    n_terms = len(index.terms)
    held = np.unique(np.concatenate([own * n_terms + place[hit], (before * n_terms + place[hit])[there]]))
    best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
    for passage, item, score in _candidates(index, held // n_terms, held % n_terms, int(base[-1])):
        t = int(np.searchsorted(base, passage, side="right") - 1)
        lo = first[t] + (passage - base[t]) * step
        found = _shingles(hashes[lo:min(lo + 2 * step, first[t + 1])], int(index.width[item]))
        asked, answered, whole = (float(np.isin(part[item], found).mean()) for part in (index.question, index.answer, index.whole))
        if min(asked, answered) >= overlap - 1e-9 or whole >= overlap - 1e-9:
            best[t, item] = max(best.get((t, item), (0.0,) * 4), (score, asked, answered, whole))
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _candidates(index: Index, passage: np.ndarray, term: np.ndarray, n_passages: int) -> Iterator[tuple[int, int, float]]:
    """(passage, item, score) that reach the item's threshold; ``passage`` ascends.

    Passages are taken in runs, so that the table of bounds stays within ``CELLS`` however short the items are."""
    n_blocks, n_items = len(index.block_need), len(index.items)
    run = max(1, CELLS // n_blocks)
    for lo in range(0, n_passages, run):
        a, b = np.searchsorted(passage, [lo, lo + run])
        here, t = passage[a:b] - lo, term[a:b]
        rare = ~index.common[t]
        which, posting = _expand(index.block_first, t[rare])
        bound = np.bincount(here[rare][which] * n_blocks + index.block[posting], index.block_max[posting], minlength=run * n_blocks)
        open_ = bound.reshape(-1, n_blocks) >= index.block_need
        some = open_.any(axis=1)[here]
        here, t = here[some], t[some]
        which, posting = _expand(index.first, t)
        item = index.item[posting]
        keep = open_[here[which], item // BLOCK_ITEMS]
        key, inverse = np.unique(here[which][keep] * n_items + item[keep], return_inverse=True)
        score = np.bincount(inverse, index.weight[posting][keep], minlength=len(key))
        for k in np.flatnonzero(score >= index.threshold[key % n_items]):
            yield int(key[k] // n_items) + lo, int(key[k] % n_items), float(score[k])


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, index_words: int = 500_000) -> DataFrame:
    """(doc_id, tkey, item_id, score, question_overlap, answer_overlap, item_overlap) of all contaminated pairs.

    Items are taken in blocks of about ``index_words`` words, each of which is broadcast as one
    index while all documents pass by: what is broadcast stays bounded, however many items there are.
    A passage is twice as long as the longest of all items and begins every item length, so
    it holds any copy whole. Overlaps are shares of distinct 5-word shingles; an item of fewer words is
    looked for as one sequence of words anywhere in a text. Items without words, null documents and empty tables give
    nothing; items that repeat are reported each under its own id, and null ids are left out.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", "text", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n")).filter("n > 0")
    items = scratch.keep(items.withColumns({"one": F.lit(0), "draw": md5_draw(F.col("item_id"), F.col("text"))}))
    n_items, n_words, longest = items.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    items = scratch.keep(running_sum(scratch, items, ["one"], "draw", ["draw", "item_id", "text"], "n", "before")
                         .withColumn("part", F.floor(F.col("before") / index_words)))

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = W.split(b.column("text"))
            held = np.unique(np.stack([W.per_text(split.starts, split.first), split.hashes(lower=True).view(np.int64)]), axis=1)
            part = np.array(b.column("part").to_pylist(), dtype=np.int64)[held[0]]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[1])], names=["part", "word"])

    held = scratch.keep(items.select("text", "part").mapInArrow(item_words, "part bigint, word bigint"))
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = scratch.keep(held.distinct().join(df, "word"))
    schema = ", ".join(f"{n} {'double' if n in PAIR[3:] else 'bigint'}" for n in PAIR)
    found = spark.createDataFrame([], schema)
    rows = small_batches(docs).select("doc_id", text_key().alias("tkey"), "text")
    for part in [r[0] for r in items.select("part").distinct().orderBy("part").collect()]:
        block = items.filter(F.col("part") == part).select("item_id", "text").orderBy("item_id", "text").collect()
        known = {r["word"] & (1 << 64) - 1: r["df"] for r in df.filter(F.col("part") == part).select("word", "df").collect()}
        index = spark.sparkContext.broadcast(build_index([r["item_id"] for r in block], [r["text"] for r in block], known,
                                                         n_items, n_words / n_items, longest, overlap))

        def look_up(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, texts in W.runs(b.column("text")):
                    split = W.split(texts)
                    hits = search(index.value, split.hashes(lower=True), split.first, overlap)
                    if hits:
                        took = pa.array([at + h[0] for h in hits])
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(took), b.column("tkey").take(took), pa.array(index.value.items[[h[1] for h in hits]]),
                             *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4, 5))], names=PAIR)

        found = found.unionByName(scratch.keep(rows.mapInArrow(look_up, schema)))
    return found


def report(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending).

    Rows that repeat a doc_id are judged each by its text; see :func:`contamination` for the rest.
    """
    hits = contamination(docs, benchmark, overlap).groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select("doc_id", text_key().alias("tkey")).alias("l").join(hits.alias("r"), same("l", "r", "doc_id", "tkey"), "left")
    ids = F.coalesce("r.item_ids", F.array().cast("array<bigint>"))
    return out.select("l.doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    scratch = Scratch(docs.sparkSession)
    hits = scratch.keep(contamination(docs, benchmark, overlap).select("doc_id", "tkey").distinct())
    keyed = docs.withColumn("__tkey", text_key()).alias("l")
    test = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.__tkey") == F.col("r.tkey"))
    return keyed.join(hits.alias("r"), test, "left_anti").drop("__tkey")
