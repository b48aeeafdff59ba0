"""The training-data operators against brute force, round trips and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import chat, decontaminate, kneser_ney, packing, quality, sharding, simhash, similar, url_filters, warc, webp

DOCS = "doc_id long, text string, key string, size long"  # two names that operators use themselves


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choices(words, k=r.choice((3, 30, 400)))), "x", 1) for k in range(60)]
    rows += [(100 + k, rows[k][1], "x", 1) for k in range(20)]  # copies
    rows += [(200 + k, rows[k][1] + " end", "x", 1) for k in range(20)]  # near copies
    rows += [(300, None, None, None), (301, "", "", 0), (302, "one", "", 0), (303, " \t\n", "", 0), (None, "no id here", "", 0), (5, rows[5][1], "x", 1), (304, "Long " * 60_000, "", 0), (305, "É ß İ 中文 mixed Case", "", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash_bits():
    import xxhash

    def plain(text):
        w = text.translate({b: b + 32 for b in range(65, 91)}).encode().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", "One", "a B", "a b c", "x y z x y z q é É", "word " * 50 + "end"):
        assert simhash.simhash(t.encode()) == plain(t) == simhash.simhash(t.encode(), slice_bytes=3)


def test_simhash_links(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(120)]
    prints = set(base)
    for x in base[:60]:
        for _ in range(4):
            prints.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}  # one dense group
    prints = sorted(prints)
    parent = {x: x for x in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    want = Counter(Counter(root(x) for x in prints).values())
    del want[1]
    for chunk in (8192, 16):
        links = simhash.links(df, chunk=chunk)
        assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in links.collect())
        got = Counter(r["n"] for r in simhash.components(links).groupBy("root").agg(F.count("*").alias("n")).collect())
        assert got == want


def test_dedup(spark, docs, none):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = [r["doc_id"] for r in kept.collect()]
    assert len(rows) == len(set(rows)) and not set(range(100, 120)) & set(rows) and 300 in rows and 301 not in rows and None in rows
    assert simhash.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_similar(spark, docs, none):
    """Components of exact Jaccard similarity 0.8 against brute force, with copies that lose up to a fifth of their shingles."""
    r = random.Random(11)
    rows = [(k, [f"w{r.randrange(4000)}" for _ in range(r.choice((40, 150, 400)))]) for k in range(40)]
    for k in range(60):
        own = list(rows[k % 40][1])
        for _ in range(r.randint(1, max(1, len(own) // 45))):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        rows.append((100 + k, own))
    common = [f"c{k}" for k in range(30)]  # a passage of many documents
    rows += [(200 + k, [*common, *(f"y{r.randrange(10**6)}" for _ in range(r.randint(0, 60)))]) for k in range(60)]
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in rows}
    parent = {k: k for k in grams}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {k for k in grams if root(k) == k}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert {x["doc_id"] for x in similar.deduplicate(df).collect()} == want
    similar.COMMON, old = 1, similar.COMMON
    try:
        found = similar.similar(df, chunk=16).groupBy("root").agg(F.min("doc_id").alias("k")).collect()
    finally:
        similar.COMMON = old
    assert {x["k"] for x in found} == want
    assert {x["doc_id"] for x in corpus_pipeline.dedup_stage(spark, df, "").collect()} == want
    kept = [x["doc_id"] for x in similar.deduplicate(docs).collect()]
    assert len(kept) == len(set(kept)) and not set(range(100, 120)) & set(kept) and 300 in kept and 301 not in kept and None in kept
    assert similar.deduplicate(none).count() == 0


def test_decontaminate(spark, docs, none):
    r = random.Random(9)
    items = [(k, " ".join(f"q{r.randrange(90)}" for _ in range(n))) for k, n in enumerate((3, 5, 20, 40, 70, 70))] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = dict(items)
    edited = text[4].split()
    edited[30] = "changed"
    extra = [(900, "before " * 2000 + text[2].upper() + " after", "", 0), (901, text[3], "", 0), (902, "a " + " ".join(edited) + " b", "", 0), (903, " ".join(text[5].split()[:30]), "", 0), (904, f"x {text[0]} y", "", 0), (905, text[1].replace(" ", ", "), "", 0)]
    df = docs.unionByName(spark.createDataFrame(extra, DOCS))

    def words(t):
        import re

        return re.findall(r"[^\W_]+", (t or "").lower())

    want = set()
    for doc, t, *_ in [(x["doc_id"], x["text"]) for x in df.collect()]:
        w = words(t)
        for item, it in items:
            iw = words(it)
            k = min(5, len(iw))
            if k and len(w) < 5000:
                own = Counter(tuple(iw[i : i + k]) for i in range(len(iw) - k + 1))
                for at in range(max(1, len(w) - len(iw) + 1)):
                    win = w[at : at + len(iw)]
                    c = Counter(tuple(win[i : i + k]) for i in range(len(win) - k + 1))
                    shared = sum((c & own).values())
                    if shared and shared / (sum(c.values()) + sum(own.values()) - shared) >= 0.8:
                        want.add((doc, item))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, bench).collect()}
    assert got == want and {(900, 2), (901, 3), (902, 4), (904, 0), (905, 1)} <= got and (903, 5) not in got
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and left.count() == df.count() - len({d for d, _ in want})
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_shards(spark, docs, none):
    out, (size, shard, slot) = sharding.shard_rows(docs.where("doc_id is null or doc_id <> 304"), 6)
    assert size == "_size" and set(docs.columns) < set(out.columns)
    total, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in out.collect():
        assert r[size] == len((r["text"] or "").encode()) + 8
        total[r[shard]] += r[size]
        slots[r[shard]].append(r[slot])
    assert sorted(total) == list(range(6)) and max(total.values()) - min(total.values()) < 4000
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_rows(none, 6)[0].count() == 0


def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(1, "http://a/é b", page, 1), (2, None, page, 1), (3, "u", "tiny", 1), (4, "u", "tiny", 1), (5, "u", None, 1), (2, "again", page, 1), (6, "u", "é" * 50_000, 1), (1, "http://a/é b", page, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload long")
    archives = warc.write_warc(pages, archive_bytes=2000)
    back = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.read_warc(archives).select("page_id", "record_type", "refers_to", F.coalesce("payload_bytes", F.lit(-1)).alias("payload_bytes")).collect())
    assert back == [(1, "response", 0, 206), (1, "revisit", 1, -1), (2, "revisit", 1, -1), (2, "revisit", 1, -1), (3, "response", 0, 4), (4, "response", 0, 4), (5, "response", 0, 0), (6, "response", 0, 100_000)]
    whole = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_warc(archives).where("record_type = 'response'").collect()}
    assert whole[6] == "é" * 50_000 and whole[5] == ""
    assert warc.write_warc(pages.where("false")).count() == 0
    samples = [f"<html><head><title>{k}</title></head><body>{'text of a page ' * (k % 7)}</body></html>".encode() for k in range(300)]
    assert warc.build_dictionary(samples) and warc.leading_frame(b"d")[:4] == bytes.fromhex("5d2a4d18")


def test_kneser_ney(spark, docs, none):
    rows = docs.select("doc_id", (F.coalesce("doc_id", F.lit(1)) % 4 == 0).alias("held_out"), "text")
    model = kneser_ney.train(rows.where("not held_out"))
    tok = lambda t: [w.decode("latin1") for w in (t or "").encode().translate(kneser_ney.LOWER).split()] + ["</s>"]
    train = [tok(r["text"]) for r in rows.where("not held_out").collect()]
    uni, pair = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t[:-1]], t, strict=True))
    follow, before = defaultdict(list), Counter()
    for (a, b), c in pair.items():
        follow[a].append(c)
        before[b] += 1
    cc, pc = Counter(pair.values()), Counter(before.values())
    d, e = kneser_ney.discounts(*(cc[k] for k in range(1, 5))), kneser_ney.discounts(*(pc[k] for k in range(1, 5)))
    preds, types, n = sum(before.values()), len(uni), sum(uni.values())
    lam = sum(e[min(k, 3)] for k in before.values()) / preds

    def p(a, b):
        low = max(before[b] - e[min(before[b], 3)], 0) / preds + lam / (types + 1)
        if not follow[a]:
            return low
        own = sum(follow[a])
        return max(pair[a, b] - d[min(pair[a, b], 3)], 0) / own + sum(d[min(c, 3)] for c in follow[a]) / own * low

    assert abs(sum(p("w1", w) for w in uni) + p("w1", "never") - 1) < 1e-9
    for r in kneser_ney.score(rows, model).join(rows.select("doc_id", "text").distinct(), "doc_id").collect():
        t = tok(r["text"])
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(t), n, sum(uni[w] > 0 for w in t))
        assert abs(r["score"] - sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t[:-1]], t, strict=True))) < 1e-6
        assert abs(r["base_score"] - sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (types + 1))) for w in t)) < 1e-6
    # many shards of few bytes, whose messages go through groups of shards and are added up there
    far = kneser_ney.train(rows.where("not held_out"), shard_bytes=2000, hop=0, held=5)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9))
    assert far.bits > model.bits and Counter(map(key, kneser_ney.score(rows, far).collect())) == Counter(map(key, kneser_ney.score(rows, model).collect()))
    empty = none.select("doc_id", F.lit(False).alias("held_out"), "text")
    assert kneser_ney.score(empty, model).count() == 0
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in kneser_ney.score(rows, kneser_ney.train(empty)).collect())


def test_chat(spark):
    from itertools import product

    def brute(roles):
        """Least cost by trying all labels and merges."""
        best = None
        for labels in product(chat.ROLES, repeat=len(roles)):
            base = sum(chat._relabel(a, b) for a, b in zip(roles, labels, strict=True))
            for merges in product((0, 1), repeat=len(roles)):
                state, cost = "", base
                for m, to in zip(merges, labels, strict=True):
                    path = chat._bridge(state, to)
                    if m and state != to or not m and path is None:
                        break
                    cost += chat.MERGE if m else chat.INSERT * len(path)
                    state = to
                else:
                    cost += chat.INSERT * len(chat._ending(state))
                    best = cost if best is None else min(best, cost)
        return best

    r = random.Random(2)
    for _ in range(60):
        roles = [r.choice((*chat.ROLES, None, "tool")) for _ in range(r.randint(1, 5))]
        cost, rows, ending = chat.repair(roles)
        assert cost == brute(roles), roles
        seen = [x for _, role, merged, before in rows for x in (*before, *(() if merged else (role,)))] + list(ending)
        assert all(b in chat.LEGAL[a] for a, b in zip(["", *seen], seen, strict=False)) and seen[-1] == "assistant"
    rows = [(1 if k < 90 else 2, k, r.choice(("user", "assistant", "system", None)), None if k % 9 == 0 else f"t{k}", "x") for k in range(150)] + [(None, None, None, None, None), (2, 149, "user", "t", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")

    def rendered():
        by = defaultdict(list)
        for x in chat.format_chats(turns).collect():
            by[x["conv_id"]].append((x["place"], x["piece"]))
        return {k: "".join(p for _, p in sorted(v)) for k, v in by.items()}

    whole = rendered()
    chat.CHUNK, old = 7, chat.CHUNK
    try:
        assert rendered() == whole and len(whole) == 3
    finally:
        chat.CHUNK = old
    assert chat.format_chats(turns.where("false")).count() == 0


def test_quality(spark, none):
    r = random.Random(4)
    words = [f"word{k}" for k in range(400)]

    def make(k):
        own = r.choices(words, k=60)
        if k % 4 == 0:
            return " ".join(w.upper() + "!!" for w in own), 0, 0
        if k % 4 == 1:
            return " ".join([*own[:30], "vile", *own[30:]]), 1, 1
        return " ".join(own), 1, 0

    rows = [(k, *make(k)) for k in range(800)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, *_ in rows] + [(None, None, None)], "doc_id long, text string, expected_grade string")
    labels = spark.createDataFrame([(k, q, x) for k, _, q, x in rows[:400]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns
    ids = {x["doc_id"] for x in kept.collect()}
    held = [(k in ids, q == 1 and x == 0) for k, _, q, x in rows[400:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert quality.select(none, model).count() == 0
    assert quality.score_rows(docs, quality.train(docs, labels.where("false")))[0].count() == 801


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_tokenizer())
    rows = packing.pack(docs, packing.word_tokenizer(), 256).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 256)):
            own = ids[at : at + 256]
            want[r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 256
    assert packing.pack(none, packing.word_tokenizer()).count() == 0


def test_packed_sequences(spark, docs):
    """The sequences hold every document's own token ids, at the places that the pieces name."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_tokenizer())
    packed = packing.pack(docs, packing.word_tokenizer(), 256)
    rows = packed.collect()
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert whole.keys() == {r["sequence_id"] for r in rows} and sum(map(len, whole.values())) == sum(r["length"] for r in rows)
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    want = Counter()
    for doc, text in texts:
        want[doc, tuple([*tok.encode(text, add_special_tokens=False).ids, 0])] += texts[doc, text]
    assert all(zlib.crc32(np.array(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    cuts = Counter((doc, at, ids[at : at + 256]) for doc, ids in want.elements() for at in range(0, len(ids), 256))
    assert Counter((r["doc_id"], r["start"], tuple(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]])) for r in rows) == cuts


def test_bin_completion():
    def optimum(items, cap):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    r = random.Random(5)
    for _ in range(80):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        packed = packing.complete_bins(Counter(items), 20).bins
        used = Counter()
        for pattern, times in packed:
            assert sum(k * n for k, n in pattern) <= 20
            for k, n in pattern:
                used[k] += n * times
        assert used == Counter(items)
        assert packing.lower_bound(Counter(items), 20) <= optimum(items, 20) == sum(t for _, t in packed)


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q", None), (2, "https://example.com/en/", ""), (3, "https://example.com", ""), (4, None, "x"), (5, "nothing", "x"), (6, "ftp://a.net/es/#t", ""), (7, "http://good.org/p", ""), (8, "http://bad.org/p", '<a href="https://a.net/es/">x</a>'), (9, "http://shop.com/a", '<a href="http://good.org/">x</a>'), (9, "http://shop.com/a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages).orderBy("page_id").collect()]
    assert got == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "example.com", "", None, got[2][4]), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "a.net", "/es/", "net/es/", "block"), (7, "good.org", "/p", None, "allow"), (8, "bad.org", "/p", None, "block"), (9, "shop.com", "/a", "com/", "allow"), (9, "shop.com", "/a", "com/", "allow")]
    urls = pages.select("page_id", F.coalesce(url_filters.host_of(F.col("url")), F.lit("")).alias("host"), url_filters.path_of(F.col("url")).alias("path"))
    url_filters.LITERAL_RULES, old = 0, url_filters.LITERAL_RULES
    try:
        joined = sorted(map(str, url_filters.with_rule(urls).select("page_id", "rule", "rule_verdict").collect()))
    finally:
        url_filters.LITERAL_RULES = old
    assert joined == sorted(map(str, url_filters.with_rule(urls).select("page_id", "rule", "rule_verdict").collect()))
    assert url_filters.judge_urls(pages.where("false")).count() == 0


def test_host_family(spark):
    """Siblings are reached over a parent without pages, and no farther than the registered domain."""
    rows = [(1, "http://a.bad.net/es/x", ""), (2, "http://b.c.bad.net/p", ""), (3, "http://other.net/p", ""), (4, "http://x.bad.co.uk/es/", ""), (5, "http://y.good.co.uk/p", ""), (6, "http://10.0.0.1/p", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host"))
    got = {(r["src"], r["dst"]) for r in url_filters.host_edges(pages.withColumn("host", F.lit("")), hosts).collect()}
    up = {("a.bad.net", "bad.net"), ("b.c.bad.net", "c.bad.net"), ("c.bad.net", "bad.net"), ("x.bad.co.uk", "bad.co.uk"), ("y.good.co.uk", "good.co.uk")}
    assert got == up | {(b, a) for a, b in up}
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages).collect()}
    assert verdicts[2] == "block" and verdicts[3] == verdicts[5] == verdicts[6] == "allow"


def test_spread_settles(spark):
    """A chain longer than any fixed number of rounds is reached to its end, with the ranks of the solved equations."""
    n, d = 12, 0.85
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1.0) for k in range(n)] + [(f"h{k + 1}", f"h{k}", 2.0) for k in range(n)], "src string, dst string, w double")
    seeds = [spark.createDataFrame([(h, 1.0)], "host string, s double") for h in ("h0", "h5")]
    got = {r["host"]: (r["host_trust"], r["host_distrust"]) for r in url_filters.spread(edges, *seeds).collect()}
    w = np.zeros((n + 1, n + 1))
    for k in range(n):
        w[k, k + 1], w[k + 1, k] = 1, 2
    for column, (flow, seed) in enumerate(((w, 0), (w.T, 5))):
        flow = flow / flow.sum(1, keepdims=True)
        want = np.linalg.solve(np.eye(n + 1) - d * flow.T, (1 - d) * np.eye(n + 1)[seed])
        assert np.allclose([got[f"h{k}"][column] for k in range(n + 1)], want, rtol=1e-4, atol=0)


def test_webp_columns(spark, docs, none):
    got = webp.media_digests(webp.with_media(docs)).collect()
    import hashlib

    want = Counter()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        want[r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert webp.with_media(none).count() == 0


class _Writer:
    """Writes what the decoder must undo: transforms, codes of many lengths, back-references, a colour cache."""

    def __init__(self):
        self.w = webp.BitWriter()

    def code(self, used, size):
        """Symbols at code lengths 1, 2, ..., k, k."""
        used = sorted(used)
        lengths = [0] * size
        if len(used) == 1:
            for bit in (1, 0, 1):
                self.w.put(bit, 1)
            self.w.put(used[0], 8)
            return {used[0]: (0, 0)}
        for k, s in enumerate(used):
            lengths[s] = min(k + 1, len(used) - 1)
        if len(used) > 15:  # all of one length but for as many as fill the code
            high = (len(used) - 1).bit_length()
            for k, s in enumerate(used):
                lengths[s] = high - (k < (1 << high) - len(used))
        self.w.put(0, 1)
        self.w.put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.w.put(4 if k < 16 else 0, 3)
        self.w.put(0, 1)
        for n in lengths:  # sixteen lengths of four bits each
            self.w.put(int(f"{n:04b}"[::-1], 2), 4)
        out, code, last = {}, 0, 0
        for s in sorted(used, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - last
            last = lengths[s]
            out[s] = (int(f"{code:0{last}b}"[::-1], 2), last)
            code += 1
        return out

    def image(self, tokens, top, cache_bits=0):
        """tokens: pixels, ("copy", length, distance code), ("cache", index)."""
        self.w.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.w.put(cache_bits, 4)
        if top:
            self.w.put(0, 1)
        px = [t for t in tokens if isinstance(t, int)]
        green = {t >> 8 & 255 for t in px} | {255 + t[1] for t in tokens if isinstance(t, tuple) and t[0] == "copy"} | {280 + t[1] for t in tokens if isinstance(t, tuple) and t[0] == "cache"}
        sets = [green, {t >> 16 & 255 for t in px} or {0}, {t & 255 for t in px} or {0}, {t >> 24 for t in px} or {0}, {t[2] - 1 for t in tokens if isinstance(t, tuple) and t[0] == "copy"} or {0}]
        sizes = (280 + (1 << cache_bits if cache_bits else 0), *webp.ALPHABETS[1:])
        codes = [self.code(s, n) for s, n in zip(sets, sizes, strict=True)]
        for t in tokens:
            if isinstance(t, int):
                for c, s in zip(codes, (t >> 8 & 255, t >> 16 & 255, t & 255, t >> 24), strict=False):
                    self.w.put(*c[s])
            elif t[0] == "copy":
                self.w.put(*codes[0][255 + t[1]])
                self.w.put(*codes[4][t[2] - 1])
            else:
                self.w.put(*codes[0][280 + t[1]])


def _file(width, height, body):
    o = _Writer()
    o.w.put(0x2F, 8)
    for v, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        o.w.put(v, n)
    body(o)
    return webp.riff(o.w.bytes())


def _foretold(mode, left, top, right, corner):
    """A channel's prediction as the format states it; modes 11 apart, which look at all channels."""
    avg, clamp = lambda x, y: (x + y) // 2, lambda x: max(0, min(255, x))
    m = avg(left, top)
    return [None, left, top, right, corner, avg(avg(left, right), top), avg(left, corner), m, avg(corner, top), avg(top, right), avg(avg(left, corner), avg(top, right)), None, clamp(left + top - corner), clamp(m + int((m - corner) / 2))][mode]


def _foretold_pixel(mode, left, top, right, corner):
    if mode == 0:
        return (255, 0, 0, 0)
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        by_left, by_top = (sum(abs(g - x) for g, x in zip(guess, n, strict=True)) for n in (left, top))
        return left if by_left < by_top else top
    return tuple(_foretold(mode, *x) for x in zip(left, top, right, corner, strict=True))


def test_webp_decoder():
    a, b, c = 0xFF102030, 0x80405060, 0x01020304

    def plain(o):
        o.w.put(0, 1)
        # a b c, four pixels copied from three back (distance code 123 is out of the short codes: use the row above), one from the cache
        index = 0x1E35A7BD * b % (1 << 32) >> 30
        o.image([a, b, c, a, ("copy", 4, 1), ("cache", index), a, a, a], True, 2)

    px = webp.decode(_file(4, 3, plain)).ravel().tolist()
    assert px == [a, b, c, a, a, b, c, a, b, a, a, a]

    r = random.Random(6)
    w, h = 9, 6
    img = np.array([0xFF000000 | r.choice((5, 90, 200)) << 16 | r.choice((7, 250)) << 8 | r.choice((1, 128)) for _ in range(w * h)], np.uint32)
    for mode in range(14):
        ch = np.stack(webp._split(img), axis=1).tolist()
        rest = []
        for at, own in enumerate(ch):
            y, x = divmod(at, w)
            p = (255, 0, 0, 0) if not at else ch[at - 1] if y == 0 else ch[at - w] if x == 0 else _foretold_pixel(mode, *(tuple(ch[at - k]) for k in (1, w, w - 1, w + 1)))
            rest.append([(i - j) & 255 for i, j in zip(own, p, strict=True)])
        coded = webp._join(*np.array(rest).T).tolist()

        def predictor(o, coded=coded, mode=mode):
            o.w.put(1, 1)
            o.w.put(0, 2)
            o.w.put(1, 3)
            o.image([mode << 8] * 2, False)
            o.w.put(0, 1)
            short = [t for t in coded]
            o.image(short, True)

        assert (webp.decode(_file(w, h, predictor)).ravel() == img).all(), mode

    factors = np.array([0xFF000000 | 20 << 16 | 240 << 8 | 33] * 2, np.uint32)
    turned = webp.cross_colour(img, w, h, factors, 3, -1)
    assert (webp.cross_colour(turned, w, h, factors, 3) == img).all()

    def crossed(o):
        o.w.put(1, 1)
        o.w.put(2, 2)  # green taken off first
        o.w.put(1, 1)
        o.w.put(1, 2)
        o.w.put(1, 3)
        o.image(factors.tolist(), False)
        o.w.put(0, 1)
        al, re, g, bl = webp._split(img)
        o.image(webp.cross_colour(webp._join(al, re - g, g, bl - g), w, h, factors, 3, -1).tolist(), True)

    assert (webp.decode(_file(w, h, crossed)).ravel() == img).all()
    colours = [a, b, c]

    def palette(o):
        o.w.put(1, 1)
        o.w.put(3, 2)
        o.w.put(2, 8)
        steps = [a, *(webp._join(*[np.array(y - x) for x, y in zip(webp._split(np.array([p], np.uint32)), webp._split(np.array([q], np.uint32)), strict=True)]).item() for p, q in zip(colours, colours[1:], strict=False))]
        o.image(steps, False)
        o.w.put(0, 1)
        rows = [[0, 1, 2, 2, 1], [2, 2, 0, 0, 1]]
        o.image([sum(v << 2 * k for k, v in enumerate(row[x : x + 4])) << 8 for row in rows for x in (0, 4)], True)

    assert webp.decode(_file(5, 2, palette)).tolist() == [[colours[k] for k in row] for row in ([0, 1, 2, 2, 1], [2, 2, 0, 0, 1])]
    with pytest.raises(ValueError):
        webp.decode(b"RIFF....WEBPVP8L")
