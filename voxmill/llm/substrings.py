"""Substring dedup: words covered by a window that occurs elsewhere are removed.

Every window of 35 words is anchored at its smallest 8-word gram, by hash: equal windows have equal
anchors, and a run of windows with one anchor is a segment of at most 62 words. Segments whose anchor
occurs once in the corpus hold no repeated window. The others are dealt to shards by
anchor, so that a shard holds every occurrence of its windows. Each shard builds an FM-index over its
distinct segments and streams them against it: backward search finds the matching statistics, and
stretches at or above the threshold are reported. An anchor with more segments than a shard should hold
is in no shard: its windows are counted one by one, by hash, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm import words as W
from voxmill.llm.common import Scratch, sized, small_batches, text_key
from voxmill.llm.fmindex import FMIndex, repeated_stretches

GRAM = 8
#: Neighbouring windows that are ruled out together.
CORE = 4
#: Stands for a null doc_id while rows are joined.
NO_DOC = -(1 << 63)
KEYS = ("did", "tkey")
SEGMENT = "did bigint, tkey bigint, start int, n int, anchor bigint, content bigint"
#: Numbers in arrays that may be broadcast with their rows; more are joined by a shuffle.
BROADCAST_NUMBERS = 4_000_000


def grams_of(h: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM words from each word on."""
    grams = np.zeros(max(0, len(h) - GRAM + 1), dtype=np.uint64)
    for j in range(GRAM):
        grams += h[j:len(grams) + j] * W.PLACES[j]
    return W.mix(grams)


def segments_of(split: W.Words, window: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content) of all segments of a run of texts."""
    h = split.hashes(lower=False)
    if len(h) < window:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    grams = grams_of(h)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
    place = views.argmin(axis=1) + np.arange(len(views))
    text = W.per_text(h, split.first)
    at = np.flatnonzero(text[:len(place)] == text[window - 1:])
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    place, text = place[at], text[at]
    starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[starts, len(at)])
    raw, begin = h.tobytes(), at[starts]
    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * b:8 * (b + c)]) for b, c in zip(begin.tolist(), (n + window - 1).tolist())),
                          dtype=np.uint64, count=len(n))
    return text[starts], begin - split.first[text[starts]], n, grams[place[starts]].view(np.int64), content.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("doc_id"), F.lit(NO_DOC)).cast("bigint").alias("did"), text_key().alias("tkey"), "text")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                text, start, n, anchor, content = segments_of(W.split(texts), window)
                took = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("did").take(took), b.column("tkey").take(took), pa.array(start.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(content)],
                    names=["did", "tkey", "start", "n", "anchor", "content"])

    return keyed(docs).mapInArrow(cut, SEGMENT)


def _with_lists(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """Join per-document lists to the texts; broadcast only while all lists together are small."""
    numbers = lists.agg(F.sum(F.size(column))).first()[0] or 0
    return docs.join(sized(lists, numbers, BROADCAST_NUMBERS), list(KEYS), how)


def _listed(docs: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The texts of the wanted segments' rows, each with the list of its segments."""
    lists = wanted.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n", "anchor", "content", *columns)).alias("list"))
    return _with_lists(keyed(docs), Scratch(docs.sparkSession).keep(lists), "list", "inner")


def _cores_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """One row per CORE neighbouring windows of the wanted segments: anchor, content, copies, the first
    window and how many there are, and a hash of the words that all of them have in common.

    Neighbours are taken by how far the anchor is from their start, so equal windows are in equal places.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                split = W.split(texts)
                h = split.hashes(lower=False)
                grams = grams_of(h)
                out: dict[str, list] = {"anchor": [], "content": [], "copies": [], "off": [], "n": [], "core": []}
                for i, own in enumerate(b.column("list").slice(at, len(texts)).to_pylist()):
                    for s in own:
                        lo = int(split.first[i]) + s["start"]
                        # all windows of the segment hold the anchor, first at this place
                        place = s["n"] - 1 + int(np.flatnonzero(grams[lo + s["n"] - 1:].view(np.int64) == s["anchor"])[0])
                        for k in range((place - s["n"] + 1) // CORE, place // CORE + 1):
                            first, last = max(0, place - CORE * k - CORE + 1), min(s["n"] - 1, place - CORE * k)
                            begin = lo + place - CORE * k
                            out["core"].append(xxhash.xxh3_64_intdigest(h[begin:begin + window - CORE + 1].tobytes(), seed=k) - (1 << 63))
                            out["off"].append(first)
                            out["n"].append(last - first + 1)
                            for c in ("anchor", "content", "copies"):
                                out[c].append(s[c])
                yield pa.RecordBatch.from_pydict(out, schema=CORES)

    return _listed(docs, wanted, "copies").mapInArrow(cut, "anchor bigint, content bigint, copies bigint, off int, n int, core bigint")


CORES = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("core", pa.int64())])


def _runs(column: str) -> Column:
    """Neighbouring windows (off, n) in order, joined. A segment has as many windows as a window has grams at most."""
    def add(acc: Column, part: Column) -> Column:
        top = F.get(acc, F.size(acc) - 1)
        longer = F.struct(top["off"].alias("off"), (top["n"] + part["n"]).alias("n"))
        return F.when((F.size(acc) > 0) & (top["off"] + top["n"] == part["off"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
                      ).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(column, F.array().cast("array<struct<off:int,n:int>>"), add)


def _trimmed(scratch: Scratch, docs: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Segments of hot anchors without windows that surely occur once, in runs: ``off`` is where a run begins.

    A passage that many documents hold gives one anchor as many different segments as it has surroundings.
    Words that neighbouring windows share and that occur once rule all of these windows out; counting them
    spreads over all tasks. What is left is the passage and up to CORE - 1 words of its surroundings.
    """
    cores = scratch.keep(_cores_of(docs, hot, window))
    twice = scratch.keep(cores.groupBy("anchor", "core").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("anchor", "core"))
    held = cores.join(twice, ["anchor", "core"]).groupBy("anchor", "content").agg(F.array_sort(F.collect_list(F.struct("off", "n"))).alias("parts"))

    held = held.select("anchor", "content", F.explode(_runs("parts")).alias("run"))
    out = hot.drop("n").join(held, ["anchor", "content"]).select(
        "anchor", "content", "copies", *KEYS, (F.col("start") + F.col("run.off")).alias("start"), F.col("run.n").alias("n"), F.col("run.off").alias("off"))
    return scratch.keep(out)


def _windows_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """One row per window of the wanted runs: anchor, content, copies, its place in the segment, and a hash of its words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                split = W.split(texts)
                raw = split.hashes(lower=False).tobytes()
                out: dict[str, list] = {"anchor": [], "content": [], "copies": [], "off": [], "held": []}
                for i, own in enumerate(b.column("list").slice(at, len(texts)).to_pylist()):
                    for s in own:
                        lo = int(split.first[i]) + s["start"]
                        out["held"] += [xxhash.xxh3_64_intdigest(raw[8 * k:8 * (k + window)]) - (1 << 63) for k in range(lo, lo + s["n"])]
                        out["off"] += range(s["off"], s["off"] + s["n"])
                        for c in ("anchor", "content", "copies"):
                            out[c] += [s[c]] * s["n"]
                yield pa.RecordBatch.from_pydict(out, schema=WINDOWS)

    return _listed(docs, wanted, "copies", "off").mapInArrow(cut, "anchor bigint, content bigint, copies bigint, off int, held bigint")


WINDOWS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("off", pa.int32()), ("held", pa.int64())])


def _repeated_of(scratch: Scratch, docs: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """(anchor, content, lo, hi): stretches of the segments of hot anchors whose windows occur twice.

    No task holds an anchor: windows are told apart by their hashes, as contents are, and rows are dealt by window.
    """
    windows = scratch.keep(_windows_of(docs, _trimmed(scratch, docs, hot, window), window))
    # written first, so that adaptive execution can split the join at a window that many segments hold
    twice = scratch.keep(windows.groupBy("anchor", "held").agg(F.sum("copies").alias("copies")).filter("copies > 1").select("anchor", "held"))
    held = windows.join(twice, ["anchor", "held"]).groupBy("anchor", "content").agg(
        F.array_sort(F.collect_set(F.struct("off", F.lit(1).alias("n")))).alias("parts"))
    out = scratch.keep(held.select("anchor", "content", F.explode(_runs("parts")).alias("run")).select(
        "anchor", "content", F.col("run.off").alias("lo"), (F.col("run.off") + F.col("run.n") + window - 1).alias("hi")))
    scratch.drop(windows, twice)
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted segments as text, and ``piece``, a hash of them."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                split = W.split(texts)
                raw = split.hashes(lower=False).tobytes()
                out: dict[str, list] = {"anchor": [], "content": [], "copies": [], "off": [], "n": [], "piece": [], "words": []}
                for i, segments in enumerate(b.column("list").slice(at, len(texts)).to_pylist()):
                    for s in segments:
                        lo = int(split.first[i]) + s["start"]
                        hi = lo + s["n"] + window - 1
                        out["words"].append(split.data[split.starts[lo]:split.ends[hi - 1]].tobytes())
                        out["piece"].append(xxhash.xxh3_64_intdigest(raw[8 * lo:8 * hi]) - (1 << 63))
                        for c in ("anchor", "content", "copies", "off", "n"):
                            out[c].append(s[c])
                yield pa.RecordBatch.from_pydict(out, schema=TEXTS)

    return _listed(docs, wanted, "copies", "off").mapInArrow(
        take, "anchor bigint, content bigint, copies bigint, off int, n int, piece bigint, words binary")


TEXTS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("copies", pa.int64()), ("off", pa.int32()), ("n", pa.int32()),
                   ("piece", pa.int64()), ("words", pa.binary())])


def search_shard(words: pa.Array, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): stretches of words of single segments that occur twice in the shard."""
    split = W.split(words.cast(pa.large_string()) if not pa.types.is_large_string(words.type) else words)
    _, word = np.unique(split.hashes(lower=False), return_inverse=True)
    m, n = len(words), len(word)
    # every segment ends in a separator of its own, below all words
    ends = split.first[1:] + np.arange(m)
    symbols = np.empty(n + m, dtype=np.int64)
    is_end = np.zeros(n + m, dtype=bool)
    is_end[ends] = True
    symbols[is_end] = np.arange(m)
    symbols[~is_end] = word + m
    first = split.first[:-1] + np.arange(m)
    weights = np.repeat(copies, np.diff(split.first) + 1)
    index = FMIndex(symbols, weights)
    single = np.flatnonzero(copies == 1)
    which, lo, hi = repeated_stretches(index, symbols, first[single], ends[single] - 1, window)
    which = single[which]
    return which, lo - first[which], hi - first[which]


def repeated_words(docs: DataFrame, window: int = 35, shard_segments: int = 2000, hot_contents: int = 500) -> DataFrame:
    """(did, tkey, cuts): lists of word ranges (from, to) that repeated windows cover, for rows that have any.

    Anchors with more than ``hot_contents`` different segments are not dealt to shards; their windows are counted.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    every = scratch.keep(_cut(docs, window))
    # written first, so that adaptive execution can split the join at a hot anchor
    anchors = scratch.keep(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1").select("anchor"))
    occurrences = scratch.keep(every.join(anchors, "anchor"))
    scratch.drop(every)
    # one row per distinct content, with one place where its words stand
    contents = occurrences.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEYS, "start", "n")).alias("at"))
    contents = scratch.keep(contents.select("anchor", "content", "copies", "at.*"))
    kinds = scratch.keep(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    hot = scratch.keep(contents.join(kinds.filter(F.col("kinds") > hot_contents).select("anchor"), "anchor"))
    wanted = contents.join(kinds.filter(F.col("kinds") <= hot_contents).select("anchor"), "anchor").withColumn("off", F.lit(0))
    wanted = scratch.keep(wanted)
    shards = max(1, -(-wanted.count() // shard_segments), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    texts = scratch.keep(_texts_of(docs, wanted, window))
    # a row that is there twice gives its segments twice
    pieces = texts.groupBy("anchor", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct("content", "off")).alias("at"))
    pieces = texts.select("anchor", "piece", "content", "off", "words").join(
        pieces.select("anchor", "piece", F.col("copies"), F.col("at.content").alias("content"), F.col("at.off").alias("off")),
        ["anchor", "piece", "content", "off"])
    pieces = pieces.select("anchor", "piece", "copies", "words").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        copies = table.column("copies").to_numpy().astype(np.int64)
        words = table.column("words").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        which, lo, hi = search_shard(words, copies, window)
        took = pa.array(which)
        return pa.table({"anchor": table.column("anchor").take(took), "piece": table.column("piece").take(took),
                         "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    partly = scratch.keep(pieces.groupBy("shard").applyInArrow(search, "anchor bigint, piece bigint, lo int, hi int"))
    # pieces with copies are covered from end to end
    wholly = texts.groupBy("anchor", "piece").agg(F.sum("copies").alias("copies"), F.max("n").alias("n")).filter("copies > 1").select(
        "anchor", "piece", F.lit(0).alias("lo"), (F.col("n") + window - 1).alias("hi"))
    of_pieces = texts.select("anchor", "content", "piece", "off").join(partly.unionByName(wholly), ["anchor", "piece"]).select(
        "anchor", "content", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    # so are the contents of anchors that have only one
    alone = contents.join(kinds, "anchor", "left_anti").filter("copies > 1").select(
        "anchor", "content", F.lit(0).alias("lo"), (F.col("n") + window - 1).alias("hi"))
    found = of_pieces.unionByName(alone)
    if not hot.isEmpty():
        found = found.unionByName(_repeated_of(scratch, docs, hot, window))
    found = scratch.keep(found)
    cuts = occurrences.join(found, ["anchor", "content"]).select(
        *KEYS, F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).alias("cut"))
    cuts = scratch.keep(cuts.groupBy(*KEYS).agg(F.array_sort(F.collect_set("cut")).alias("cuts")).withColumn("cuts", _merged("cuts")))
    scratch.drop(occurrences, contents, kinds, hot, wanted, texts, partly, found)
    return cuts


def _merged(column: str) -> Column:
    """Ranges in order, those that touch joined."""
    kind = "array<struct<lo:int,hi:int>>"

    def add(acc, r):
        top = F.get(acc, F.size(acc) - 1)
        joined = F.struct(top["lo"].alias("lo"), F.greatest(top["hi"], r["hi"]).alias("hi"))
        return F.when((F.size(acc) > 0) & (r["lo"] <= top["hi"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
                      ).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(column, F.array().cast(kind), add)


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Texts without repeated words: doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256.

    A word goes when a window that covers it has the word sequence of a window that starts anywhere else, in
    this row or another; what is removed does not depend on other removals. Windows are of whole words,
    compared as they are. Null and short texts have no window and lose nothing; rows that repeat count as
    occurrences each, so a repeated long row loses all its windows. Empty tables give none; other columns
    are ignored.
    """
    cuts = repeated_words(docs, window)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text"), 8 << 20):
                counts, removed, kept = [], [], []
                for text, ranges in zip(texts, b.column("cuts").slice(at, len(texts)).to_pylist()):
                    # bytes.split parts words at the six ASCII white space characters
                    words = (text.as_py() or "").encode().split()
                    counts.append(len(words))
                    for r in reversed(ranges or ()):
                        del words[r["lo"]:r["hi"]]
                    removed.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                did = b.column("did").slice(at, len(texts)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did, mask=did == NO_DOC), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return _with_lists(keyed(docs), cuts, "cuts", "left").select("did", "text", "cuts").mapInArrow(remove, schema)
