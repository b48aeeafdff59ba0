"""Clashing column names, nulls, empties, very long texts, ties, repeats and empty tables, operator by operator."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, kneser_ney, packing, quality, sharding, similar, simhash, url_filters, webp
from stepweave.plans import lineage

#: Names that operators use inside.
NAMES = ("fp", "text_hash", "raw", "rank", "root", "node", "size", "parity", "key", "part", "nth", "length", "ids", "content", "sh", "n", "k", "h", "grade", "id", "at", "slots", "keep_id", "keep_hash", "expected_grade", "shard", "slot", "media", "bucket", "least")


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(21)
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(r.choices(words, k=30))) for k in range(30)]
    rows += [(None, None), (40, None), (41, ""), (None, ""), (42, rows[3][1]), (3, rows[3][1]), (43, "Long é " * 70_000), (44, " \t\n "), (44, " \t\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES])


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_clashing_names(spark, clashing):
    bench = spark.createDataFrame([(1, clashing.where("doc_id = 7").first()["text"])], "item_id long, text string")
    for out in (simhash.deduplicate(clashing), similar.deduplicate(clashing), decontaminate.decontaminate(clashing, bench)):
        assert out.columns == clashing.columns and set(out.select(*NAMES).distinct().first()) == {"x"}
    assert ids(decontaminate.contaminated(clashing, bench)) == {7: 1}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    model = quality.train(clashing, labels)
    assert quality.select(clashing, model).columns == clashing.columns
    assert packing.pack(clashing, packing.word_tokenizer(), 512).select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()
    assert webp.with_media(clashing).count() == clashing.count()
    out, new = sharding.shard_rows(clashing, 3)
    assert set(clashing.columns) | set(new) == set(out.columns) and out.count() == clashing.count()
    renamed = clashing.withColumnRenamed("text", "body").withColumn("text", F.lit(5))
    assert ids(decontaminate.contaminated(renamed, bench, text_col="body")) == {7: 1}
    assert ids(simhash.deduplicate(renamed, text_col="body")) == ids(simhash.deduplicate(clashing))


def test_nulls_and_repeats(clashing):
    kept = ids(similar.deduplicate(clashing))
    assert kept[3] == 1 and kept[42] == 0 and sum(kept[k] for k in (40, 41, 44, None)) == 1  # null, empty and wordless texts are alike
    assert ids(simhash.deduplicate(clashing))[3] == 1


def test_long_texts_by_slices(spark):
    """A text over many slices, and tasks that count or score many times, change nothing."""
    r = random.Random(3)
    text = " ".join(r.choices([f"W{k}" for k in range(40)], k=3000)).encode()
    known = kneser_ney._Hashes()
    assert (kneser_ney.word_hashes(text, known, 50) == kneser_ney.word_hashes(text, known)).all()
    rows = spark.createDataFrame([(k, False, " ".join(r.choices("abcdefg", k=r.randint(0, 400)))) for k in range(60)] + [(99, True, text.decode())], "doc_id long, held_out boolean, text string")
    key = lambda r: (r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 9))
    want = Counter(map(key, kneser_ney.score(rows, kneser_ney.train(rows.where("not held_out"))).collect()))
    kneser_ney.TOKENS, old = 100, kneser_ney.TOKENS
    try:
        batch = list(kneser_ney._pair_batches(3)(iter([_batch([text, b"", text])])))
        assert len(batch) > 1
    finally:
        kneser_ney.TOKENS = old
    assert Counter(map(key, kneser_ney.score(rows, kneser_ney.train(rows.where("not held_out"), shard_bytes=50)).collect())) == want


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["raw"])


def test_wide_counts(tmp_path):
    """Pairs that occur over 2 ** 32 times keep their counts."""
    import pyarrow as pa

    first, second, counts = np.array([5, 7]), np.array([6, 8]), np.array([1 << 33, 3])
    block = kneser_ney._block([first, second, counts])
    assert [x.tolist() for x in kneser_ney._unblock(block, 3)] == [[5, 7], [6, 8], [1 << 33, 3]]
    rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])
    out = next(kneser_ney._merge_pairs(str(tmp_path), 0, 0)(iter([rows]))).to_pylist()
    assert out[0]["wide"] and out[0]["n"] == 2
    stats = {"pair_d": [0] * 4, "word_d": [0] * 4, "tokens": 1, "types": 1, "preds": 1, "word_types": (0, 0, 0)}
    model = kneser_ney.Model(str(tmp_path), 0, {0: (2, "u8")}, {}, stats)
    assert kneser_ney._Arrays(model, "pair", model.pairs, 1).find(kneser_ney.pair_hash(first, second))[0].tolist() == [1 << 33, 3]


def test_hosts(spark):
    rows = [(1, "http://user:pw@WWW.Example.com:8080/en/x"), (2, "HTTPS://example.com?q=/en/"), (3, "http://example.com#/en/"), (4, "x://"), (5, "://h/p?q#f"), (6, "http://a.b//en/"), (7, "http://EXAMPLE.com/EN/"), (8, "http://notexample.com/en/"), (9, "http://h/" + "p" * 100_000), (10, "")]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["h"], r["p"]) for r in urls.select("page_id", url_filters.host_of(F.col("url")).alias("h"), url_filters.path_of(F.col("url")).alias("p")).collect()}
    assert got == {1: ("user:pw@www.example.com:8080", "/en/x"), 2: ("example.com", ""), 3: ("example.com", ""), 4: ("", ""), 5: ("h", "/p"), 6: ("a.b", "//en/"), 7: ("example.com", "/EN/"), 8: ("notexample.com", "/en/"), 9: ("h", "/" + "p" * 100_000), 10: ("", "")}
    pages = urls.withColumn("html", F.when(F.col("page_id") == 9, F.lit("<a href='http://example.com/'>" * 30_000)).otherwise(""))
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages.unionByName(pages.where("page_id = 1"))).collect()}
    assert out[1] == (None, out[1][1]) and out[7] == ("com/", "allow") and out[8] == ("com/", "allow") and out[9][0] is None and len(out) == 10


def test_release(spark):
    since = lineage.mark(spark)
    a, b = lineage.written(spark.range(5), "a"), lineage.written(spark.range(7), "b")
    assert lineage.release(spark, since, b) == 1 and b.count() == 7
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    assert lineage.release(spark, since) == 1


def test_radius():
    """At the least similarity that counts, fingerprints stay within the radius that the blocks guarantee."""
    r = np.random.default_rng(1)
    for n in (10, 15, 20, 30, 60):
        same = next(s for s in range(n + 1) if s / (2 * n - s) >= decontaminate.SIMILARITY)
        a = r.integers(0, 2, (3000, n, 64), dtype=np.int8)
        b = a.copy()
        b[:, same:] = r.integers(0, 2, (3000, n - same, 64), dtype=np.int8)
        apart = ((2 * a.sum(1) > n) != (2 * b.sum(1) > n)).sum(1)
        assert apart.max() <= decontaminate.RADIUS < decontaminate.BLOCKS * (decontaminate.BLOCK_RADIUS + 1)


def test_native():
    """Operators that must be native use nothing of Python's workers."""
    import inspect

    for module in (decontaminate, sharding, url_filters):
        source = inspect.getsource(module)
        assert not [x for x in ("mapIn", "applyIn", "pandas", "udf", ".rdd", "createDataFrame", "arrow") if x in source.replace("DataFrame operations", "")], module
