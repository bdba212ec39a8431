"""N-gram Jaccard join by token-combination prefixes.

A document is its set of 5-word shingles (tokens). Tokens that many documents hold form the frequent
class, all others the rare one. In one order of all tokens, rare before frequent, a set's prefix is
long enough that two sets which link must agree in it: on a rare token, or on two frequent tokens of
one subclass, so the prefix is extended by one token per subclass. Rare tokens and pairs of frequent
ones are indexed, and what meets in the index is verified on the whole sets.

Equal sets are one class from the start. Within an index entry each class is first compared with
one centre, the set that is most typical; only classes that are still in different components
after that are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm import words as W
from voxmill.llm.common import Scratch, sized, text_key
from voxmill.llm.graph import components
from voxmill.llm.substrings import NO_DOC, keyed

#: A link needs this similarity, in hundredths.
PERCENT = 80
#: Frequent tokens that are told to all tasks: 8 MB at most, at any size of the corpus.
MOST_FREQUENT = 1 << 20
LEAST_FREQUENT = 8
#: Tokens that are sorted at a time, and tokens to a range of the counting shuffle.
SORTED_TOKENS = 1 << 21
RANGE_TOKENS = 1 << 22
#: Bits of a class number. Hashes take one less; sets whose hashes clash get numbers above them.
CLASS_BITS = 56


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): each text's distinct shingles in ascending order of their hashes."""
    split = W.split(texts)
    h, first = W.shingles(split.hashes(lower=True), split.first)
    text = W.per_text(h, first)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(texts)))]).astype(np.int64)


def set_ids(tokens: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; the first, of ``bits`` bits, is the class, the second tells sets of one class apart."""
    n = np.diff(first)
    out = []
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(tokens ^ salt), dtype=np.uint64)])
        out.append(W.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64) * salt))
    return (out[0] >> np.uint64(64 - bits)).astype(np.int64), out[1].view(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of ``n`` of which one at least is in any set that links to it."""
    return n - -(-PERCENT * n // 100) + 1


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences of three bytes, or four where one needs it."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    width = 3 if len(steps) and steps.max() < 1 << 24 else 4
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    steps = np.zeros(((len(blob) - 1) // width, 4), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint32)


def survey(scratch: Scratch, docs: DataFrame, hash_bits: int = CLASS_BITS - 1) -> tuple[DataFrame, DataFrame, int]:
    """Documents (did, tkey, n, cls, check), and the tokens (token, df) that LEAST_FREQUENT sets or more hold.

    Tokens are counted by their first bits, 32 and those of their range; tokens that share these are of one
    class, which is all that matters; so are sets whose hashes clash, which a token then may count as one.
    Rows of documents are written where they are made and take no part in the shuffle of the tokens.
    Returns both tables and the number of bits.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(size // 6 // RANGE_TOKENS).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.sort(np.concatenate(held) >> np.uint64(32 - bits))
            part = (tokens >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            full = [p for p in range(1 << bits) if cuts[p] < cuts[p + 1]]
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([_packed(low[cuts[p]:cuts[p + 1]]) for p in full], pa.binary()), *[none] * 5],
                names=["part", "blob", "did", "tkey", "n", "cls", "check"])
            held.clear()
            seen.clear()

        for b in batches:
            for at, texts in W.runs(b.column("text")):
                tokens, first = token_sets(texts)
                cls, check = set_ids(tokens, first, hash_bits)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary()), b.column("did").slice(at, len(texts)),
                     b.column("tkey").slice(at, len(texts)), pa.array(n), pa.array(cls), pa.array(check)],
                    names=["part", "blob", "did", "tkey", "n", "cls", "check"])
                # copies of a set that are sorted together count once
                fresh = np.array([c not in seen and not seen.add(c) for c in cls.tolist()], dtype=bool) if len(cls) else np.zeros(0, bool)
                held.append(tokens[np.repeat(fresh, n)])
                if sum(map(len, held)) >= SORTED_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    def add_up(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        low = np.sort(np.concatenate([_unpacked(x) for x in table.column("blob").to_pylist()]))
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        df = np.diff(np.concatenate([starts, [len(low)]]))
        often = df >= LEAST_FREQUENT
        token = (np.int64(part) << 32) | low[starts[often]].astype(np.int64)
        return pa.table({"token": pa.array(token), "df": pa.array(df[often])})

    raw = scratch.keep(keyed(docs).mapInArrow(count, "part int, blob binary, did bigint, tkey bigint, n bigint, cls bigint, check bigint"))
    rows = scratch.keep(raw.filter("blob IS NULL").select("did", "tkey", "n", "cls", "check"))
    tokens = scratch.keep(raw.filter("blob IS NOT NULL").select("part", "blob").groupBy("part").applyInArrow(add_up, "token bigint, df bigint"))
    scratch.drop(raw)
    return rows, tokens, bits


def frequent_tokens(held: DataFrame) -> np.ndarray:
    """The most frequent tokens, MOST_FREQUENT at most: all from some count on."""
    by_df = held.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    # one row per different count, of which there are few; each row is two numbers
    above = F.sum("n").over(Window.orderBy(F.col("df").desc()))
    least = by_df.withColumn("above", above).filter(F.col("above") <= MOST_FREQUENT).agg(F.min("df")).first()[0]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    return np.sort(held.filter(F.col("df") >= least).select("token").toArrow().column("token").to_numpy()).astype(np.uint64)


def _pairs_of(tokens: np.ndarray, n: int, n_rare: int, bucket: int) -> np.ndarray:
    """Signatures of a set's frequent tokens (ascending) for one bucket of set sizes."""
    need = int(prefix_length(np.array([n]))[0]) - n_rare
    told = np.uint64(bucket + 1) * W.PLACES[10]
    if bucket < 6:
        return W.mix(tokens[:need] * W.PLACES[11] + told)
    # subclasses grow with the sets, so that pairs in each stay few
    sub = (tokens >> np.uint64(7)) % np.uint64(1 << (bucket - 4))
    _, firsts = np.unique(sub, return_index=True)
    counts = np.ones(len(tokens), dtype=np.int64)
    counts[firsts] = 0
    length = int(np.searchsorted(np.cumsum(counts), need)) + 1
    tokens, sub = tokens[:length], sub[:length]
    out = []
    for s in np.unique(sub):
        own = tokens[sub == s]
        a, b = np.triu_indices(len(own), 1)
        out.append(W.mix(own[a] * W.PLACES[12] + own[b] * W.PLACES[13] + told))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def signatures(texts: pa.Array, frequent: np.ndarray, bits: int, hash_bits: int = CLASS_BITS - 1,
               numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, key): index entries of all distinct sets. A key is a class below seven bits: six say which
    share of the set is frequent, so that the largest key of an entry is its most typical set, and the
    last is 1 if the set is indexed by pairs too. ``numbers`` are the classes where hashes do not tell."""
    tokens, first = token_sets(texts)
    cls = set_ids(tokens, first, hash_bits)[0] if numbers is None else numbers
    n = np.diff(first)
    _, one = np.unique(cls, return_index=True)
    fresh = np.zeros(len(cls), dtype=bool)
    fresh[one] = True
    fresh &= n > 0
    text = W.per_text(tokens, first)
    short = tokens >> np.uint64(32 - bits)
    at = np.minimum(np.searchsorted(frequent, short), max(len(frequent) - 1, 0))
    often = frequent[at] == short if len(frequent) else np.zeros(len(tokens), dtype=bool)
    n_often = np.bincount(text[often], minlength=len(n))
    need = prefix_length(n)
    n_rare = n - n_often
    paired = (n_rare < need).astype(np.int64)
    key = (n_often * 63 // np.maximum(n, 1) << CLASS_BITS + 1) | (paired << CLASS_BITS) | cls
    # the place of a rare token among the set's rare ones
    rare_before = np.concatenate([[0], np.cumsum(~often)])
    nth = rare_before[:-1] - rare_before[first[:-1]][text]
    taken = ~often & (nth < need[text]) & fresh[text]
    sigs, keys = [W.mix(tokens[taken] * W.PLACES[9])], [key[text[taken]]]
    for i in np.flatnonzero(fresh & (n_rare < need)):
        own = tokens[first[i]:first[i + 1]][often[first[i]:first[i + 1]]]
        size = int(n[i])
        for bucket in {size.bit_length() - 1, (size * 100 // PERCENT).bit_length() - 1}:
            sigs.append(_pairs_of(own, size, int(n_rare[i]), bucket))
            keys.append(np.full(len(sigs[-1]), key[i]))
    return np.concatenate(sigs), np.concatenate(keys)


def _index(docs: DataFrame, frequent: np.ndarray, bits: int, hash_bits: int, apart: DataFrame | None) -> DataFrame:
    """(sig, cls, paired, centre) of entries that two classes or more share.

    ``apart``, where some sets' hashes clash, has their rows (did, tkey, hashed, cls).
    """
    told = docs.sparkSession.sparkContext.broadcast(frequent)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                numbers = b.column("cls").slice(at, len(texts)).to_numpy() if "cls" in b.schema.names else None
                sig, key = signatures(texts, told.value, bits, hash_bits, numbers)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(key)], names=["sig", "key"])

    mask = F.lit((1 << CLASS_BITS) - 1)
    rows = docs.select("text").mapInArrow(entries, "sig bigint, key bigint")
    if apart is not None:
        numbered = keyed(docs).join(apart, ["did", "tkey"]).select("text", "cls").mapInArrow(entries, "sig bigint, key bigint")
        clashing = apart.select(F.col("hashed").alias("_cls")).distinct()
        rows = rows.join(clashing, F.col("key").bitwiseAND(mask) == F.col("_cls"), "left_anti").unionByName(numbered)
    entry = Window.partitionBy("sig")
    rows = rows.withColumns({"most": F.max("key").over(entry), "least": F.min("key").over(entry)}).filter("most <> least")
    paired = F.shiftright("key", CLASS_BITS).bitwiseAND(F.lit(1)) == 1
    return rows.select("sig", F.col("key").bitwiseAND(mask).alias("cls"), paired.alias("paired"),
                       F.col("most").bitwiseAND(mask).alias("centre")).distinct()


def _may_link(shared: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes whose prefixes of rare tokens share so many tokens can link.

    Up to the last token of the prefix that ends first, one of the sets has its whole prefix, and
    beyond it no more tokens than that set has left.
    """
    least = F.ceil((n_a + n_b) * PERCENT / F.lit(100 + PERCENT))
    left = F.greatest(F.ceil(n_a * PERCENT / F.lit(100)), F.ceil(n_b * PERCENT / F.lit(100))) - 1
    return (n_a * 100 >= n_b * PERCENT) & (n_b * 100 >= n_a * PERCENT) & (shared + left >= least)


def _sized_pairs(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their sets."""
    return (pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("n_a")), "a")
            .join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("n_b")), "b"))


def _sets_of(scratch: Scratch, docs: DataFrame, one_of: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, tokens) of the classes named. ``one_of`` has a row (did, tkey, cls) per class."""
    needed = scratch.keep(one_of.select("cls", "did", "tkey").join(classes.distinct(), "cls"))
    rows = keyed(docs).join(sized(needed, needed.count()), ["did", "tkey"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                tokens, first = token_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(tokens.view(np.int64)))],
                    names=["cls", "tokens"])

    return scratch.keep(rows.select("cls", "text").mapInArrow(sets, "cls bigint, tokens array<bigint>"))


def verified(docs: DataFrame, one_of: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link."""
    scratch = Scratch(docs.sparkSession)
    # a class of one row that is there twice gives equal pairs twice, which are one link
    held = _sets_of(scratch, docs, one_of, pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))))
    n_a, n_b = F.size("tokens_a"), F.size("tokens_b")
    both = pairs.join(held.select(F.col("cls").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    both = both.join(held.select(F.col("cls").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = both.filter((n_a * 100 >= n_b * PERCENT) & (n_b * 100 >= n_a * PERCENT))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.filter(shared * 100 >= (n_a + n_b - shared) * PERCENT).select("a", "b")


def links_across(cls: np.ndarray, label: np.ndarray, sets: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of different labels, one for each set and label it links to."""
    n = np.array([len(x) for x in sets], dtype=np.int64)
    token, place, count = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    # a token that one set holds alone is in no intersection
    common = np.cumsum(count > 1) - 1
    held = count[place] > 1
    row, place = row[held], common[place[held]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        cut = slice(*np.searchsorted(place, [lo, lo + columns]))
        holds = np.zeros((len(sets), columns), dtype=np.float32)
        holds[row[cut], place[cut] - lo] = 1
        shared += holds @ holds.T
    shared = shared.astype(np.int64)
    linked = (shared * 100 >= (n[:, None] + n[None, :] - shared) * PERCENT) & (label[:, None] != label[None, :])
    a, b = np.nonzero(linked)
    _, one = np.unique(np.stack([a, label[b]]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
    return cls[a[one]], cls[b[one]]


def links_within_stars(docs: DataFrame, one_of: DataFrame, stars: DataFrame, block_tokens: int = 1 << 18, block_sets: int = 512) -> DataFrame:
    """Links between members of one star (star, cls, label) that are in different components.

    Near copies of one text differ from it in a few words each, so prefixes cannot tell which of them
    link with each other. The members of a star are cut into blocks of bounded size, every two blocks
    meet in a task, and only links leave it.
    """
    scratch = Scratch(docs.sparkSession)
    # all have been compared with the centre, which is in a star of its own members only if it has no better centre
    others = F.count_if(F.col("cls") != F.col("star"))
    mixed = stars.groupBy("star").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), others.alias("others")).filter("lo <> hi AND others > 1")
    members = scratch.keep(stars.join(scratch.keep(mixed.select("star")), "star"))
    members = members.join(one_of.select("cls", "n"), "cls")
    blocks = members.groupBy("star").agg(F.ceil(F.greatest(F.sum("n") / block_tokens, F.count(F.lit(1)) / block_sets)).cast("bigint").alias("blocks"))
    members = scratch.keep(members.join(scratch.keep(blocks), "star").select("star", "cls", "label", "blocks"))
    sets = _sets_of(scratch, docs, one_of, members.select("cls"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = members.select("star", "cls", "label", own.alias("own"), other.alias("other"))
    rows = rows.select("star", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "cls", "label").join(sets, "cls")

    def across(table: pa.Table) -> pa.Table:
        # a row that is there twice gives its class twice, under one label
        cls, label = (table.column(c).to_numpy().astype(np.int64) for c in ("cls", "label"))
        a, b = links_across(cls, label, [np.asarray(x, dtype=np.int64) for x in table.column("tokens").to_pylist()])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return scratch.keep(rows.groupBy("star", "one", "two").applyInArrow(across, "a bigint, b bigint"))


def _numbered(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, one_of, apart): rows with final class numbers, a row (cls, did, tkey, n) per class, and the rows of
    the sets whose hashes clashed (None where there are none).

    At 5 * 10^10 sets some 35,000 hashes of 55 bits clash; these few sets are numbered above all hashes.
    """
    sets = scratch.keep(rows.filter("n > 0").groupBy("cls", "check").agg(F.min(F.struct("did", "tkey")).alias("at"), F.min("n").alias("n")))
    one_of = sets.select("cls", "at.did", "at.tkey", "n")
    clashing = scratch.keep(sets.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("cls"))
    if clashing.isEmpty():
        return rows, scratch.keep(one_of), None
    number = F.lit(1 << CLASS_BITS - 1) + F.row_number().over(Window.orderBy("cls", "check"))
    new = scratch.keep(sets.join(clashing, "cls").select(F.col("cls").alias("hashed"), "check", number.alias("number"), "at.did", "at.tkey", "n"))
    told = new.select(F.col("hashed").alias("cls"), "check", "number")
    rows = scratch.keep(rows.join(told, ["cls", "check"], "left").select("did", "tkey", "n", F.coalesce("number", "cls").alias("cls")))
    one_of = one_of.join(clashing, "cls", "left_anti").unionByName(new.select(F.col("number").alias("cls"), "did", "tkey", "n"))
    return rows, scratch.keep(one_of), new.select("did", "tkey", "hashed", F.col("number").alias("cls"))


def classes_and_links(docs: DataFrame, hash_bits: int = CLASS_BITS - 1) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): did, tkey, n, cls of every row, and the component label of every class that has a link."""
    scratch = Scratch(docs.sparkSession)
    rows, counted, bits = survey(scratch, docs, hash_bits)
    rows, one_of, apart = _numbered(scratch, rows)
    index = scratch.keep(_index(docs, frequent_tokens(counted), bits, hash_bits, apart))

    # each class with the centre it shares most entries with, where a link is likely
    met = index.filter("cls <> centre").groupBy(F.col("cls").alias("a"), F.col("centre").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.max("paired").alias("paired"))
    met = _sized_pairs(scratch.keep(met), one_of).filter(F.col("paired") | _may_link(F.col("met"), F.col("n_a"), F.col("n_b")))
    best = scratch.keep(met.groupBy("a").agg(F.max_by("b", F.struct("met", "b")).alias("b")))
    links = scratch.keep(verified(docs, one_of, best))
    labels = components(links)

    # what meets in an entry and is not in one component yet: all entries that two such classes share
    label = F.coalesce("label", "cls")
    labels = labels.withColumnRenamed("node", "cls")
    # a class, the centre it was compared with, and that centre itself are one star
    stars = best.select(F.col("a").alias("cls"), F.col("b").alias("star"))
    centres = stars.select(F.col("star").alias("cls"), "star").distinct().join(stars.select("cls"), "cls", "left_anti")
    stars = scratch.keep(stars.unionByName(centres).join(labels, "cls", "left").select("star", "cls", label.alias("label")))
    inside = links_within_stars(docs, one_of, stars)
    open_ = index.join(stars, "cls", "left").select("sig", "cls", "paired", label.alias("label"), F.coalesce("star", "cls").alias("star"))
    mixed_sigs = scratch.keep(open_.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("sig"))
    open_ = scratch.keep(open_.join(mixed_sigs, "sig"))
    left, right = open_.alias("l"), open_.alias("r")
    pairs = left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.cls") < F.col("r.cls"))
                      & (F.col("l.label") != F.col("r.label")) & (F.col("l.star") != F.col("r.star")))
    pairs = pairs.groupBy(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).agg(
        F.count(F.lit(1)).alias("met"), F.max(F.col("l.paired") | F.col("r.paired")).alias("paired"))
    pairs = _sized_pairs(scratch.keep(pairs), one_of).filter(F.col("paired") | _may_link(F.col("met"), F.col("n_a"), F.col("n_b")))
    pairs = scratch.keep(pairs.select("a", "b"))
    scratch.drop(index, open_, mixed_sigs)
    more = verified(docs, one_of, pairs)
    return rows, components(links.unionByName(inside).unionByName(more))


def _with_components(scratch: Scratch, docs: DataFrame, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, least): did, tkey, n and label of every row (null without words), and per label the row to keep:
    the smallest doc_id, null last, and of rows that repeat it the smallest hash of the text."""
    rows, labels = classes_and_links(docs, hash_bits)
    rows = scratch.keep(rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "did", "tkey", "n", F.when(F.col("n") > 0, F.coalesce("label", "cls")).alias("label")))
    # written, so that adaptive execution can split the join at a large component
    first = F.min(F.struct((F.col("did") == NO_DOC).alias("no_id"), "did", "tkey"))
    return rows, scratch.keep(rows.filter("label IS NOT NULL").groupBy("label").agg(first.alias("first")))


def near_duplicates(docs: DataFrame, hash_bits: int = CLASS_BITS - 1) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), one row per input row.

    Words are lower-cased in A-Z. A text of fewer than five words is one shingle; one without words has
    none and links with nothing, not even another such. A null doc_id takes part, is no smallest id
    unless there is no other, and then stays null. Rows that repeat link by their equal sets. Empty
    tables give none; other columns are ignored. No link between different texts is lost, and no
    entry, class or component is capped. Sets are told apart by 64 bits beside the ``hash_bits`` of their class.
    """
    rows, least = _with_components(Scratch(docs.sparkSession), docs, hash_bits)
    doc = F.when(F.col("did") != NO_DOC, F.col("did"))
    kept = F.when(F.col("first.did") != NO_DOC, F.col("first.did"))
    return rows.join(least, "label", "left").select(
        doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), doc).otherwise(kept).alias("component_id"))


def keep_one(docs: DataFrame, hash_bits: int = CLASS_BITS - 1) -> DataFrame:
    """One row of each component, with all its columns, and all rows without words.

    It has the smallest doc_id, null last; among rows that repeat this id, the smallest hash of the text, and
    among rows that repeat both, the smallest values of the other columns, which must be of types that have
    an order. A row of another component stays though its doc_id also occurs in this one.
    """
    scratch = Scratch(docs.sparkSession)
    rows, least = _with_components(scratch, docs, hash_bits)
    marked = rows.filter("label IS NOT NULL").groupBy("label", "did", "tkey").agg(F.count(F.lit(1)).alias("n")).join(least, "label")
    stays = (F.col("did") == F.col("first.did")) & (F.col("tkey") == F.col("first.tkey"))
    # a row stays as it is unless another goes before it or repeats it
    marked = scratch.keep(marked.filter(~stays | (F.col("n") > 1)).select(
        F.col("did").alias("__did"), F.col("tkey").alias("__tkey"), stays.alias("__stays")))
    key = F.coalesce(F.col("doc_id"), F.lit(NO_DOC)).cast("bigint")
    on = (key == F.col("__did")) & (text_key() == F.col("__tkey"))
    single = docs.join(sized(marked, marked.count()), on, "left_anti")
    again = scratch.keep(marked.filter("__stays"))
    again = docs.join(sized(again, again.count()), on).groupBy("__did", "__tkey").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return single.unionByName(again.select("row.*"))
