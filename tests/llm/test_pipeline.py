"""The pipeline's stages on skewed input: each against a plain version of what it must do."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    make = lambda n=80: " ".join(r.choices(words, k=n))
    texts = {k: make() for k in range(300)}
    for k in range(0, 40):
        texts[k] = " ".join(w.upper() + "!!" for w in make().split())  # low
    for k in range(40, 80):
        own = make().split()
        texts[k] = " ".join([*own[:40], "vile", *own[40:]])  # toxic
    one = make(200)
    texts |= {1000 + k: one for k in range(150)}  # a third of all: one text
    near = make(300).split()
    for k in range(60):
        own = list(near)
        own[r.randrange(300)] = f"x{k}"
        texts[2000 + k] = " ".join(own)
    item = make(30)
    texts |= {3000: f"{make(20)} {item} {make(20)}", 3001: None, 3002: "", 3003: "w1", 3004: " ".join(r.choices(words, k=6000))}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()] + [(5000, texts[100], None, None, None), (None, make(), "en", "s", 1), (101, texts[101], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 0 if k < 40 else 1, int(40 <= k < 80)) for k in range(200) if k % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, corpus):
    at, rows, item = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    (_, quality), (_, dedup), (_, clean), (_, pack) = corpus_pipeline.STAGES
    kept = quality(spark, docs, at)
    assert kept.columns == docs.columns
    kept = kept.collect()
    ids = {r["doc_id"] for r in kept}
    unseen = [k for k in range(80) if k % 4 == 0]
    assert sum(k in ids for k in unseen) <= 2 and sum(k not in ids for k in range(80, 300)) <= 6  # rejected: low and toxic; clean ones stay
    frame = spark.createDataFrame(kept, docs.schema)
    one = dedup(spark, frame, at).collect()
    # one of each component of Jaccard 0.8, that of the smallest id
    texts = sorted({r["text"] or "" for r in kept})
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    place = {t: k for k, t in enumerate(texts)}
    for r in kept:
        least[root(place[r["text"] or ""])].append(r["doc_id"])
    want = Counter(min((x for x in v if x is not None), default=None) for v in least.values())
    assert Counter(r["doc_id"] for r in one) == want
    frame = spark.createDataFrame(one, docs.schema)
    left = clean(spark, frame, at).collect()
    assert {r["doc_id"] for r in one} - {r["doc_id"] for r in left} == ({3000} & {r["doc_id"] for r in one})
    packed = pack(spark, spark.createDataFrame(left, docs.schema), at).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left}
    size = Counter()
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"]
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= 2048 and all(x == 0 for x in [np.frombuffer(r["ids"], "<u4")[-1] for r in packed if r["length"] < 2048])


def test_run(spark, corpus):
    at, _, _ = corpus
    out = corpus_pipeline.run(spark, at)
    assert out.count() > 150 and out.where(F.col("doc_id") == 3000).count() == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
