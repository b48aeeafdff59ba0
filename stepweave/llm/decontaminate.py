"""Benchmark decontamination by SimHash of item-sized windows; DataFrame operations only.

Words: runs of letters and digits, in lower case. An item of L words is sought in windows of L words. Of
similarity 0.8 or more (weighted Jaccard over shingles of five words, each weighed by how often it occurs) only
windows that share a shingle with the item can be, so a window is laid wherever one does, shifted by the
shingle's place in the item. Windows of equal content are judged once: their 64-bit SimHash meets those of the
items of the same length through eight blocks of eight bits. The items are entered at every block value within two bits,
so all pairs at up to 23 differing bits are found (eight blocks, 3 * 8 > 23); at similarity 0.8 the
distance is 10 +- 3 bits, so that radius can't be small, and blocks alone would let most unrelated pairs of a length meet.
Only fingerprints take part in that join; what is within the radius gets its shingles back, counted, and the exact similarity
decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, load, written

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 23, 8, 8, 2
#: Places of shingles in one piece of a document; shingles of items broadcast at a time.
PIECE, BROADCAST = 1024, 1_000_000
_WORDS = r"filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> '')"


def _shingled(rows: DataFrame, k: int) -> DataFrame:
    """rows(words, ...) with sh: the hashes of all runs of k words, in order."""
    run = ", ".join(f"wh[i + {j}]" for j in range(k))
    return rows.withColumn("wh", F.expr("transform(words, w -> xxhash64(w))")).withColumn("sh", F.expr(f"if(size(wh) < {k}, array(), transform(sequence(0, size(wh) - {k}), i -> xxhash64({run})))").cast("array<bigint>")).drop("wh", "words")


def _simhash(sh: str) -> str:
    """A bit is set if it is in over half the shingles, repeats included."""
    return f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * aggregate({sh}, 0, (c, h) -> c + cast(shiftrightunsigned(h, b) & 1L as int)) > size({sh}), shiftleft(1L, b), 0L))"


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, n, sh): k is the shingle's words, five or all of a shorter item."""
    own = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("words", F.expr(_WORDS)).where("size(words) > 0")
    own = own.withColumn("k", F.least(F.lit(SHINGLE), F.size("words"))).withColumn("n", F.size("words"))
    parts = [_shingled(own.where(F.col("k") == k), k) for k in range(1, SHINGLE + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out.select("item_id", "k", "n", "sh"), "items")


def _windows(docs: DataFrame, items: DataFrame, k: int, longest: int, small: bool) -> DataFrame:
    """(text_hash, at, k, n, sh): the item-sized windows of texts that share a shingle of k words with an item; small: whether the items' shingles are few enough to be broadcast."""
    places = items.where(F.col("k") == k).select("n", F.posexplode("sh").alias("q", "h")).distinct()
    own = _shingled(docs.select("text_hash", F.expr(_WORDS).alias("words")), k)
    # Pieces of bounded length, each with the words of a window to its left and right. The outer forms of explode keep
    # the optimizer from testing arrays for emptiness below the projection that makes them, which would make them anew.
    cut = own.withColumn("begin", F.explode_outer(F.expr(f"if(size(sh) = 0, array(), sequence(0, size(sh) - 1, {PIECE}))")))
    cut = cut.select("text_hash", "begin", F.expr("size(sh)").alias("total"), F.expr(f"greatest(0, begin - {longest})").alias("first"), F.expr(f"slice(sh, greatest(0, begin - {longest}) + 1, begin - greatest(0, begin - {longest}) + {PIECE} + {longest})").alias("piece"))
    each = cut.select("*", F.posexplode_outer(F.expr(f"slice(piece, begin - first + 1, {PIECE})")).alias("p", "h"))
    hits = each.join(F.broadcast(places) if small else places, "h")
    hits = hits.withColumn("width", F.expr(f"least(total, n - {k} + 1)")).withColumn("at", F.expr("least(greatest(begin + p - q, 0), total - width)"))
    return hits.select("text_hash", "at", F.lit(k).alias("k"), "n", F.expr("slice(piece, at - first + 1, width)").alias("sh")).dropDuplicates(["text_hash", "at", "n"])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, h, c): how often each shingle of sh occurs."""
    return rows.select(*keys, F.explode("sh").alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("c"))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """(text_hash, item_id, similarity, at) for each text of docs and item of benchmark(item_id, text) that some window makes alike.

    at: the word that the best window begins with, the first of equals. Null or wordless texts and items match nothing; an
    empty table on either side gives no rows. text_hash: Spark's xxhash64 of the text.
    """
    items = _items(benchmark)
    own = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    sizes = items.groupBy("k").agg(F.max("n").alias("longest"), F.sum(F.size("sh")).alias("shingles")).collect()
    if not sizes:
        return own.select("text_hash", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("at")).where("false")
    found = reduce(DataFrame.unionByName, [_windows(own, items, r["k"], r["longest"], r["shingles"] <= BROADCAST) for r in sizes])
    found = written(found.withColumn("content", F.xxhash64("sh")), "windows")
    alike = written(found.groupBy("k", "n", "content").agg(F.first("sh").alias("sh")), "contents")
    value = f"shiftrightunsigned(fp, {BLOCK_BITS} * b) & {(1 << BLOCK_BITS) - 1}L"
    blocks = lambda rows: rows.withColumn("fp", F.expr(_simhash("sh"))).drop("sh").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("v", F.expr(value))
    left = blocks(alike.select("k", "n", "content", "sh"))
    right = blocks(items.select("k", "n", "item_id", "sh"))
    right = right.withColumn("v", F.explode(F.expr(f"transform(filter(sequence(0L, {(1 << BLOCK_BITS) - 1}L), m -> bit_count(m) <= {BLOCK_RADIUS}), m -> v ^ m)")))
    right = right.withColumnRenamed("fp", "item_fp")
    candidates = left.join(right, ["k", "n", "b", "v"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}").select("k", "n", "content", "item_id").distinct()
    # shingles in common, each as often as both have it
    met = candidates.join(_counted(alike, "k", "n", "content"), ["k", "n", "content"]).join(_counted(items, "item_id", "k", "n").withColumnRenamed("c", "own"), ["item_id", "k", "n", "h"])
    shared = met.groupBy("k", "n", "content", "item_id").agg(F.sum(F.least("c", "own")).alias("shared"))
    sized = shared.join(alike.select("k", "n", "content", F.size("sh").alias("size")), ["k", "n", "content"]).join(items.select("k", "n", "item_id", F.size("sh").alias("item_size")), ["k", "n", "item_id"])
    verified = sized.withColumn("similarity", F.expr("shared / (size + item_size - shared)")).where(F.col("similarity") >= similarity)
    verified = written(verified.select("k", "n", "content", "item_id", "similarity"), "verified")
    hits = found.select("text_hash", "at", "k", "n", "content").join(verified, ["k", "n", "content"])
    return hits.groupBy("text_hash", "item_id").agg(F.max(F.struct("similarity", -F.col("at"))).alias("best")).select("text_hash", "item_id", "best.similarity", (-F.col("best.col2")).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, at) for each row of docs that holds an item; repeated rows each, null ids too."""
    found = matches(docs, benchmark, similarity, text_col)
    ids = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return ids.join(found, "text_hash").select("doc_id", "item_id", "similarity", "at")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item; columns as given. Rows without a text stay."""
    (key,) = fresh(docs, "text_hash")
    found = written(matches(docs, benchmark, similarity, text_col).select(F.col("text_hash").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string"))).join(found, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_SQL_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_SQL_SHINGLES = "list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))"
#: The same by brute force: each window that shares a shingle with an item of its length, against every item of that length.
OP2_SQL = f"""
WITH i0 AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT item_id, w, least(5, len(w)) AS k, len(w) AS n FROM i0 WHERE len(w) > 0),
items AS (SELECT item_id, k, n, {_SQL_SHINGLES} AS sh FROM i1),
places AS (SELECT DISTINCT k, n, h, q FROM (SELECT k, n, unnest(sh) AS h, unnest(range(0, len(sh))) AS q FROM items)),
d0 AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, k, {_SQL_SHINGLES} AS sh FROM d0, (SELECT DISTINCT k FROM items)),
spots AS (SELECT doc_id, k, len(sh) AS total, unnest(sh) AS h, unnest(range(0, len(sh))) AS p FROM docs),
hits AS (SELECT DISTINCT doc_id, s.k AS k, n, least(total, n - s.k + 1) AS width, least(greatest(p - q, 0), total - least(total, n - s.k + 1)) AS spot FROM spots s JOIN places ON places.k = s.k AND places.h = s.h),
windows AS (SELECT doc_id, hits.k AS k, n, spot, list_slice(sh, spot + 1, spot + width) AS sh FROM hits JOIN docs USING (doc_id, k)),
wc AS (SELECT doc_id, k, n, spot, h, count(*) AS c FROM (SELECT doc_id, k, n, spot, unnest(sh) AS h FROM windows) GROUP BY ALL),
ic AS (SELECT item_id, k, n, h, count(*) AS c FROM (SELECT item_id, k, n, unnest(sh) AS h FROM items) GROUP BY ALL),
shared AS (SELECT doc_id, item_id, k, n, spot, sum(least(wc.c, ic.c)) AS s FROM wc JOIN ic USING (k, n, h) GROUP BY doc_id, item_id, k, n, spot),
rated AS (SELECT doc_id, item_id, spot, CAST(s AS DOUBLE) / (len(windows.sh) + len(items.sh) - s) AS similarity FROM shared JOIN windows USING (doc_id, k, n, spot) JOIN items USING (item_id, k, n))
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(spot, (-similarity, spot)) AS INTEGER) AS "at" FROM rated WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
