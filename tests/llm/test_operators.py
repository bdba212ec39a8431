"""Operators for training data against SQL, brute force, round trips and held-out labels."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check_queries import mismatch
from voxmill.llm import chat, decontaminate, fmindex, jaccard, mixing, naming, secrets, sharding, substrings, tokens, toxicity
from voxmill.llm.common import Scratch
from voxmill.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like internal ones."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (1, "other text", "en", "a", 1), (2, base.replace("w30", "W30"), None, None, None),
            (3, None, "en", "b", 0), (4, "", "en", "b", 0), (None, "no id here", "en", "b", 5), (None, None, None, None, None),
            (5, " \t\n ", "en", "b", 3), (6, long, "de", "c", 9), (7, "one", "de", "c", 3), (8, "one", "de", "c", 3),
            (9, "é ü x " + base, "fr", "a", 9)]
    extra = ", h string, name string, size string, words string, copies string, n string, score string, cls string, anchor string"
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], COLUMNS + extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    assert mismatch(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()) is None


def test_secrets_match_sql_where_there_are_some(spark, sf):
    """The smallest scale has no secret: counts, spans and verdicts are compared at the next."""
    folder = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = QUERIES["op10_secret_scan"](spark, folder).toPandas()
    assert mismatch(got, con.execute(ORACLES["op10_secret_scan"]).df()) is None
    # each of the documents with spans here has as many of one kind as of another, but not of all three
    assert (got["n_assign"] != got["n_access"]).any() and got["n_assign"].sum() > 0


# --- 1 mixing

def test_hypergeometric_has_its_mean_and_bounds(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(500).cast("bigint"), F.lit(120).cast("bigint"), F.lit(200).cast("bigint"),
                                                           (F.col("id") + 0.5) / 4000).alias("x")).toPandas()["x"]
    assert abs(draws.mean() - 48) < 0.1 and abs(draws.var() - 200 * 0.24 * 0.76 * 300 / 499) < 1
    forced = spark.range(1).select(mixing.hypergeometric(F.lit(10).cast("bigint"), F.lit(9).cast("bigint"), F.lit(5).cast("bigint"), F.lit(0.5))).first()[0]
    assert forced in (4, 5)


def test_tree_deals_every_block_once_and_evenly(spark):
    scratch = Scratch(spark)
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 1), (3, 500)], "src bigint, blocks bigint")
    got = mixing.splitting_tree(scratch, quotas, 3, "s").toPandas()
    assert got.groupby("src")["blocks"].sum().to_dict() == {0: 1000, 1: 37, 2: 1, 3: 500}
    assert got.groupby("shard")["blocks"].sum().between(192, 193).all() and got["shard"].nunique() == 8
    for _, own in got.sort_values("shard").groupby("src"):
        assert (own["first"].to_numpy() == np.cumsum(own["blocks"]) - own["blocks"]).all()
    again = mixing.splitting_tree(scratch, quotas, 3, "s").toPandas()
    assert mismatch(got, again) is None


def test_pieces_are_disjoint_and_fill_the_targets(spark, odd):
    pieces, rows = mixing.mix(odd, block_words=16, shard_blocks=64)
    p, r = pieces.toPandas(), rows.toPandas()
    taken = p.groupby("source", dropna=False)["n_words"].sum()
    for source, own in r.groupby("source", dropna=False):
        target = own["target"].iloc[0]
        assert abs((taken[source] if source in taken.index else 0) - target) <= 0.5 and target <= 3 * own["source_size"].iloc[0] + 1e-9
    assert abs(r.drop_duplicates("source")["target"].sum() - r["size"].sum()) < 1e-6
    for _, own in p.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    out = mixing.taken_words(pieces, rows).toPandas()
    assert len(out) == odd.count() and (out["taken"] <= 3 * out["size"]).all() and out["taken"].sum() == p["n_words"].sum()


# --- 2 token files

def test_token_files_hold_the_encoded_texts(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, s) for i, s in enumerate(["a<|endoftext|>b", "İ ẞ ΑΣ, it's don't.\tx..", "é é", "a\x1cb \x85 c,,. (d).", "x" * 600 + " y"])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id") + 100))
    manifest = tokens.write_tokens(docs, path, str(tmp_path / "out"), part_bytes=1 << 16)
    got = tokens.read_tokens(manifest).toPandas()
    want = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")) for i, x in map(tuple, docs.collect())]
    assert sorted((str(i), len(ids), zlib.crc32(ids.tobytes())) for i, ids in want) == sorted(
        ("None" if pd.isna(i) else str(int(i)), n, c) for i, n, c in zip(got["doc_id"], got["n_tokens"], got["ids_crc32"]))
    got = got.sort_values("start")
    assert (got["start"].to_numpy() == np.cumsum(got["n_tokens"]) - got["n_tokens"]).all()
    known = got["doc_id"].dropna()
    assert known.is_monotonic_increasing and got["doc_id"].isna().iloc[:2].all()


def test_registered_tokens(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op2_token_files"](spark, sf).toPandas().sort_values("doc_id")
    start = 0
    for row in got.itertuples():
        ids = np.array([*t.encode(texts[row.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


# --- 3 Jaccard join

def brute_components(rows):
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def shown(pdf, *columns):
    return sorted(tuple("None" if pd.isna(v) else str(int(v)) if c.endswith("id") else int(v) for c, v in zip(columns, row))
                  for row in pdf[list(columns)].itertuples(index=False))


def test_near_copies_of_odd_rows(spark, odd):
    got = jaccard.near_duplicates(odd).toPandas()
    assert shown(got, "doc_id", "n_shingles", "component_id") == brute_components([(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("least", [2, 8])
def test_families_of_near_copies_and_common_passages(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", least)
    rng, rows = random.Random(7), []
    passage = [f"p{i}" for i in range(40)]
    for family, size in enumerate((40, 90, 300)):
        base = [f"f{family}w{i}" for i in range(size)]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(size // 25 + 3)):
                w[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    for k in range(40):
        rows.append((len(rows), " ".join([f"u{k}x{i}" for i in range(rng.randrange(3, 60))] + passage)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(jaccard.near_duplicates(docs).toPandas(), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_chains_of_centres_keep_the_links_of_their_ends(spark):
    # d -> c -> {x, y}: x and y link with each other alone; the order of the hashes decides which families become such chains
    rows = []
    for k in range(80):
        c = [f"k{k}w{i}" for i in range(100)]
        d = [f"k{k}d{i}" for i in range(48)] + c[34:]
        x = c[:50] + [f"k{k}other"] + c[51:86]
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((d, c, x, x[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert shown(jaccard.near_duplicates(docs).toPandas(), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_linking_sets_share_a_signature():
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    for _ in range(150):
        n = rng.choice((6, 12, 40, 70, 130, 200, 300))
        a = [rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(n)]
        b = list(a)
        for _ in range(max(1, n // 60)):
            b[rng.randrange(n)] = "other"
        arr = pa.array([" ".join(a), " ".join(b)])
        t, first = jaccard.token_sets(arr)
        x, y = set(t[:first[1]].tolist()), set(t[first[1]:].tolist())
        for share in (0.0, 0.7, 1.0):
            often = np.array(sorted({h >> 28 for h in x | y if h % 1000 < share * 1000}), dtype=np.uint64)
            sig, key = jaccard.signatures(arr, often, 4)
            shared = set(sig[key == key[0]].tolist()) & set(sig[key != key[0]].tolist())
            assert shared or 100 * len(x & y) < 80 * len(x | y) or x == y


def test_sets_whose_hashes_clash_stay_apart(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(base[i % 12] if i % 3 else [*base[i % 12][:30], f"x{i}", *base[i % 12][31:]])) for i in range(90)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], COLUMNS)
    got = jaccard.near_duplicates(docs, hash_bits=3).toPandas()
    assert shown(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs, hash_bits=3).collect()}
    assert kept == {d for d, _, c in ((int(a), b, int(c)) for a, b, c in brute_components(rows)) if d == c}


def test_keep_one_keeps_one_row_of_each_group(spark, odd, empty):
    a = " ".join(f"a{i}" for i in range(50))
    near = a.replace("a49", "z")
    b, c = " ".join(f"b{i}" for i in range(50)), " ".join(f"c{i}" for i in range(50))
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(
        [(3, a), (5, near), (5, b), (None, a), (None, c), (None, c), (7, ""), (7, ""), (8, None)])], COLUMNS)
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in jaccard.keep_one(docs).collect())
    assert got == sorted([("3", a, 0), ("5", b, 2), ("None", c, 4), ("7", "", 6), ("7", "", 7), ("8", "None", 8)])
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    left = sorted(str(r["doc_id"]) + "|" + str(r["text"])[:12] for r in kept.collect())
    # 1 and 2 are copies and 9 is near them, 7 and 8 are equal; texts without words all stay
    assert left == sorted(["1|w0 w1 w2 w3 ", "1|other text", "3|None", "4|", "None|no id here", "None|None", "5| \t\n ", "6|word0x0 word", "7|one"])
    assert jaccard.keep_one(empty).isEmpty()


# --- 4 substring dedup

def test_fm_index_counts_like_a_scan():
    rng = np.random.Generator(np.random.PCG64(5))
    text = np.append(rng.integers(1, 8, 599), 0)
    weights = rng.integers(1, 3, 600)
    index = fmindex.FMIndex(text, weights)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        at = int(rng.integers(0, 580))
        pattern = text[at:at + n]
        lo, hi = np.array([0]), np.array([index.size])
        for c in pattern[::-1]:
            lo, hi = index.extend(np.array([c]), lo, hi)
        hits = [i for i in range(600 - n + 1) if (text[i:i + n] == pattern).all()]
        assert index.occurrences(lo, hi)[0] == weights[hits].sum()


def brute_removed(rows, window=35):
    starts = {}
    words = [WORDS.findall(t or "") for _, t in rows]
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            starts.setdefault(tuple(w[k:k + window]), []).append((i, k))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + window))
    out = []
    for (d, _), w, g in zip(rows, words, gone):
        kept = " ".join(x for k, x in enumerate(w) if k not in g)
        out.append((str(d), len(w), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [500, 1])
def test_repeats_of_odd_rows_and_shared_passages(spark, odd, monkeypatch, hot):
    plain = substrings.repeated_words
    monkeypatch.setattr(substrings, "repeated_words", lambda docs, window=35: plain(docs, window, 50, hot))
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(80)]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for k in range(40):
        lo = rng.randrange(30)
        part = passage[lo:lo + rng.randrange(30, 51)]
        rows.append((100 + k, " ".join([f"u{k}x{i}" for i in range(rng.randrange(60))] + part + [f"v{k}x{i}" for i in range(rng.randrange(60))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.remove_repeats(docs).toPandas()
    assert sorted(("None" if pd.isna(r.doc_id) else str(int(r.doc_id)), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()) == brute_removed(rows)


def test_no_shard_holds_a_passage_as_often_as_it_has_surroundings(spark, monkeypatch):
    plain, texts_of, most = substrings.repeated_words, substrings._texts_of, []

    def counted(*args):
        out = texts_of(*args)
        most.append(out.groupBy("anchor").agg(F.countDistinct("piece").alias("n")).agg(F.max("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(substrings, "_texts_of", counted)
    monkeypatch.setattr(substrings, "repeated_words", lambda docs, window=35: plain(docs, window, 50, 10))
    # their numbers of windows are no multiples of CORE
    passages = [" ".join(f"p{n}x{i}" for i in range(n)) for n in (51, 52, 53, 55)]
    rows = [(k, " ".join([*(f"u{k}x{i}" for i in range(40)), passages[k % 4], *(f"v{k}x{i}" for i in range(40))])) for k in range(160)]
    # some surroundings are there twice too
    rows += [(160 + k, rows[k][1].replace(f"v{k}x3 ", "other ")) for k in range(5)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()) == brute_removed(rows)
    assert most and max(most) <= 10


# --- 5 toxicity

def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_toxicity"](spark, sf).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    both = got[got["held_out"]].join(labels["toxic"], how="inner")
    assert (both["predicted"] == both["toxic"]).mean() > 0.95
    pos, neg = both[both["toxic"] == 1]["score"].to_numpy(), both[both["toxic"] == 0]["score"].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.75
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 0), (3, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert toxicity.classify(odd, labels.limit(0)).filter("predicted = 1").isEmpty()
    assert toxicity.classify(empty, labels).isEmpty()
    kept = toxicity.keep_clean(odd, toxicity.train(odd, labels.limit(0)))
    assert kept.columns == odd.columns and kept.count() == odd.count()


# --- 6 exact dedup

@pytest.mark.parametrize("size,digest", [(4096, F.xxhash64), (7, lambda c: F.pmod(F.xxhash64(c), F.lit(3)))])
def test_exact_copies_of_odd_rows(spark, odd, size, digest):
    got = naming.exact_dedup(odd, size, digest).toPandas()
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in odd.collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(d)
    assert len(got) == len(rows)
    for sha, own in got.groupby("text_sha256"):
        ids = [d for d in groups[sha] if d is not None]
        assert len(own) == len(groups[sha]) == own["group_size"].iloc[0] and own["kept"].sum() == 1
        assert (own["keep_id"].isna().all() if not ids else (own["keep_id"] == min(ids)).all())


# --- 7 chat

def test_chat_round_trip(spark, tmp_path):
    rows = [(1, 0, "user", "\\0<s>[a] \\1 ] [INST]"), (1, 1, "assistant", "</s>"), (1, 2, "user", None), (2, 0, "assistant", ""),
            (3, 0, "user", "only"), (None, 0, None, "x"), (4, 0, "sys] <tem", "a\nb"), (4, 1, "assistant", "é𝄞"), (4, 1, "assistant", "é𝄞"), (4, None, "user", "first")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, said string")
    chat.write_examples(turns, str(tmp_path / "x"))
    back = chat.read_examples(spark, str(tmp_path / "x")).collect()
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, own in want.items():
        mine = sorted((e for e in back if e["conv_id"] == c), key=lambda e: e["example"])
        assert [tuple(t) for t in mine[-1]["turns"]] == own
        assert [t for e in mine for t in e["trained"]] == [t for r, t in own if r == "assistant"]
        for e in mine:
            assert [tuple(t) for t in e["turns"]] == own[:len(e["turns"])]
    assert chat.digest(chat.read_examples(spark, str(tmp_path / "x"))).count() == len(want)


# --- 8 decontamination

def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 50))), (2, None), (3, ""), (4, "one"), (None, "x"), (5, " ".join(f"q{i}" for i in range(40)))],
                                  "item_id bigint, text string")
    for words in (500_000, 5):
        hits = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(odd, bench, index_words=words).collect()}
        assert hits == {(1, 1), (2, 1), (9, 1), (7, 4), (8, 4)}
    out = decontaminate.report(odd, bench)
    assert out.count() == odd.count()
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.filter("doc_id IN (2, 7, 8, 9)").isEmpty() and clean.filter("doc_id = 1").count() == 1
    assert decontaminate.report(odd, bench.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.report(empty, bench).isEmpty()


def holds(item: str, passage: str) -> bool:
    """Brute force: the passage has enough shingles of question and answer, or of the whole item."""
    words, text = (WORDS.findall(x.translate(LOWER)) for x in (item, passage))
    k = min(5, len(words))
    there = {tuple(text[i:i + k]) for i in range(len(text) - k + 1)}
    to, since = decontaminate.parts(len(words))
    share = [len(own & there) / len(own) for own in ({tuple(p[i:i + k]) for i in range(len(p) - k + 1)} for p in (words[:to], words[since:], words))]
    return min(share[:2]) >= 0.8 - 1e-9 or share[2] >= 0.8 - 1e-9


def test_altered_copies_and_short_items_are_found_whatever_shares_their_index(spark):
    """Copies with some words changed against brute force, within texts no longer than a passage."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(300)}"
    bench = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 16, 25, 43, 60] * 3)]
    docs = []
    for _, text in bench:
        for changed in range(4):
            words = text.split()
            for _ in range(changed):
                words[rng.randrange(len(words))] = "changed"
            pad = [word() for _ in range(rng.randrange(60 - len(words) + 1))]
            at = rng.randrange(len(pad) + 1)
            docs.append((len(docs), " ".join(pad[:at] + words + pad[at:]).upper(), "en", "a", 1))
    want = {(d[0], i) for d in docs for i, text in bench if holds(text, d[1])}
    # one word changed in an item of 43 words or more is always found
    assert all((4 * i + 1, i) in want for i, text in bench if len(text.split()) >= 43)
    table, items = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(bench, "item_id bigint, text string")
    for words in (500_000, 100):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(table, items, index_words=words).collect()}
        assert got == want


def test_bounds_are_held_in_runs(monkeypatch, spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str)
    texts, items = docs.select("text").toPandas()["text"], bench.orderBy("item_id").toPandas()
    split = decontaminate.W.split(pa.array(items["text"]))
    hashes = split.hashes(lower=True)
    df = {}
    for i in range(len(items)):
        for h in np.unique(hashes[split.first[i]:split.first[i + 1]]):
            df[int(h)] = df.get(int(h), 0) + 1
    counts = split.counts()
    index = decontaminate.build_index(list(items["item_id"]), list(items["text"]), df, len(items), counts.mean(), int(counts.max()), 0.8)
    text = decontaminate.W.split(pa.array(texts, pa.string()))
    found = decontaminate.search(index, text.hashes(lower=True), text.first, 0.8)
    monkeypatch.setattr(decontaminate, "CELLS", 1)
    assert decontaminate.search(index, text.hashes(lower=True), text.first, 0.8) == found and len(found) == len(want) > 0


# --- 9 sharding

def test_shards_follow_the_law(spark, sf, texts):
    got = QUERIES["op9_sharding"](spark, sf).toPandas()
    assert len(got) == len(texts) and set(got["law"]) == {"key"} and set(got["shard"]) <= set(range(16))
    for row in got.itertuples():
        raw = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert row.grown_shard in (row.shard, 16)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_movement_stays_in_changed_subtrees(spark):
    rows = spark.range(20_000)
    tree = [sharding.Leaf(r, k, r * 10 + k, 1.0 + k) for r in range(3) for k in range(3)]
    heavier = [x._replace(weight=5.0) if x.shard == 12 else x for x in tree]
    both = sharding.descend(sharding.descend(rows, F.col("id"), tree, "a"), F.col("id"), heavier, "b").toPandas()
    share = both["a"].value_counts(normalize=True)
    assert all(abs(share[x.shard] - x.weight / 18) < 0.01 for x in tree)
    moved = both[both["a"] != both["b"]]
    assert (moved["b"] // 10 == 1).all() and 0.02 < len(moved) / len(both) < 0.2


# --- 10 secrets

def brute_base(text):
    patterns = {"assign": (r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
                "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


def test_base_spans_are_those_of_the_patterns(spark, odd):
    rng = random.Random(1)
    bits = ["password", "Passwd", "token", "API_KEY", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "0123456789abcdef" * 2, "AKIA", "QWERTY1234567890", "é", "𝄞", "\n", "token=token:abcdefgh"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    findings, out = secrets.scan_secrets(docs)
    for r in out.collect():
        base = [f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["base"]]
        assert base == brute_base(rows[r["doc_id"]][1])
        assert set(base) <= {f"{secrets.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in r["spans"]}
    assert secrets.digest(secrets.scan_secrets(odd)[1]).count() == odd.count()


def test_ownership_tells_examples_from_live_credentials(spark):
    example, live = "AbCdEfGhIjKlMnOpQrSt1234", "zYxWvUtSrQpOnMlKjIhG9876"
    rows = [(i, f"see {example} here", "en", f"s{i}", 0) for i in range(5)] + [(9, f"see {live} here", "en", "s1", 0), (10, f"token = {example}", "en", "s1", 0)]
    findings, out = secrets.scan_secrets(spark.createDataFrame(rows, COLUMNS))
    verdicts = {(r["doc_id"], r["kind"]): (r["verdict"], r["reported"], r["n_owners"]) for r in findings.collect()}
    assert verdicts[9, "owned"] == ("live", True, 1) and verdicts[0, "owned"] == ("copied", False, 5) and verdicts[10, "assign"] == ("copied", True, 5)
    spans = {r["doc_id"]: len(r["spans"]) for r in out.collect()}
    assert spans[9] == 1 and spans[0] == 0 and spans[10] == 1


# --- all of them

def test_empty_tables(spark, empty):
    import public_tokenizers
    assert mixing.taken_words(*mixing.mix(empty)).isEmpty()
    assert jaccard.near_duplicates(empty).isEmpty() and substrings.remove_repeats(empty).isEmpty()
    assert naming.exact_dedup(empty).isEmpty() and secrets.scan_secrets(empty)[1].isEmpty()
    assert sharding.shard_documents(empty, sharding.even_tree(16)).isEmpty()
    folder = Scratch(spark).keep(spark.range(1)).inputFiles()[0].rsplit("/", 1)[0] + "-tokens"
    assert tokens.read_tokens(tokens.write_tokens(empty, public_tokenizers.path("word_bpe_49k.json"), folder)).isEmpty()
    assert chat.expand(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).isEmpty()


def test_sharding_of_odd_rows(spark, odd):
    got = sharding.shard_documents(odd, sharding.even_tree(16)).toPandas()
    assert len(got) == odd.count()
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_registered_shards_are_those_of_brute_force(spark, sf, texts):
    """Every draw anew with hashlib: regions, racks and shards of the tree, and of the tree with one more shard."""
    import math

    def draw(*parts):
        return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

    def pick(key, place, children):
        return min(children, key=lambda c: (-math.log(draw(key, f"{place}/{c}")) / children[c], c)) if len(children) > 1 else next(iter(children))

    def shard(key, tree):
        regions = {}
        for region, rack, leaf in tree:
            regions.setdefault(region, {}).setdefault(rack, []).append(leaf)
        r = pick(key, "", {x: float(sum(map(len, racks.values()))) for x, racks in regions.items()})
        k = pick(key, f"{r}", {x: float(len(leaves)) for x, leaves in regions[r].items()})
        return pick(key, f"{r}/{k}", {x: 1.0 for x in regions[r][k]})

    tree = [(s // 8, s // 4 % 2, s) for s in range(16)]
    got = {r["doc_id"]: r for r in QUERIES["op9_sharding"](spark, sf).collect()}
    assert set(got) == set(texts)
    order = {}
    for d, t in texts.items():
        data = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"], got[d]["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert got[d]["shard"] == shard(d, tree) and got[d]["grown_shard"] == shard(d, [*tree, (2, 0, 16)])
        order.setdefault(got[d]["shard"], []).append((draw("slot", d, zlib.crc32(data)), d))
    for own in order.values():
        assert [got[d]["slot"] for _, d in sorted(own)] == list(range(len(own)))
