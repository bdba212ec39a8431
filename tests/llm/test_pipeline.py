"""The pipeline's stages, each against brute force on what it got."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components
from voxmill.llm.common import Scratch


@pytest.fixture(scope="module")
def kept(spark, sf):
    docs, out, scratch = spark.read.parquet(f"{sf}/documents.parquet"), {}, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.keep(stage(spark, docs, sf))
        out[name] = before, docs
    return out


def test_columns_and_order(kept):
    assert list(kept) == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    for name, (before, after) in kept.items():
        assert name == "sharding" or after.columns == before.columns


def test_one_of_each_group_stays(kept):
    before, after = kept["ngram_jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {d for d, _, c in brute_components(rows) if d == c}
    assert {str(r["doc_id"]) for r in after.collect()} == want


def test_toxic_and_contaminated_documents_go(kept, spark, sf):
    before, after = kept["toxicity"]
    insults = ("idiot", "moron")
    texts = {r["doc_id"]: r["text"].lower().split() for r in before.collect()}
    left = {r["doc_id"] for r in after.collect()}
    marked = {d for d, w in texts.items() if all(x in w for x in insults)}
    assert not marked & left and len(left) > 0.8 * len(texts)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = kept["decontamination"]
    rows = {r["doc_id"]: " ".join(r["text"].lower().split()) for r in before.collect()}
    whole = {d for d, t in rows.items() if any(i in t for i in items)}
    left = {r["doc_id"] for r in after.collect()}
    assert not whole & left
    grams = {tuple(w[k:k + 5]) for w in (i.split() for i in items) for k in range(len(w) - 4)}
    spotless = {d for d, t in rows.items() if not any(tuple(t.split()[k:k + 5]) in grams for k in range(len(t.split()) - 4))}
    assert spotless <= left


def test_mix_and_shards(kept):
    before, after = kept["mixing"]
    words = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in before.collect()}
    times = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(times) <= set(words) and max(times.values()) <= 3
    total = sum(n for _, n in words.values())
    assert abs(sum(words[d][1] * k for d, k in times.items()) - total) < 0.5 * total
    before, after = kept["sharding"]
    assert before.count() == after.count()
    for r in after.groupBy("shard").agg({"slot": "max", "*": "count"}).collect():
        assert r["max(slot)"] + 1 == r["count(1)"]
