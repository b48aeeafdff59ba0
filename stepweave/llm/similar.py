"""Near-duplicates by the exact Jaccard similarity of the sets of word shingles; no similar pair is missed.

Three searches propose pairs, and every pair proposed is held against the sets themselves, recomputed from the texts, before
it counts.

1. SimHash of the sets, linked through anchor points of a covering code (``simhash.links``): nearly all copies with small
   changes, whatever the size of their group.
2. No Hamming radius guarantees a Jaccard similarity, so sets also meet at shingles. They are ordered alike in all
   documents: by hash, those of very many documents (counted in a part of the corpus) last. Two sets of similarity t or more
   share a shingle among the first n - ceil(t n) + 1 of each, n being its size, so documents meet at these. Where they meet,
   a pair is proposed if the sizes allow t and the parity fingerprints differ in no more bits than the sets may differ in
   shingles: a shingle turns one bit, so the bits that differ never outnumber the shingles in which the sets do. Of each
   meeting a spanning forest is taken.
3. The components of all that held of 1 and 2 being known, each pair of a meeting whose ends are still in different components.

What 2 and 3 propose passes the same bound on longer fingerprints first. Large meetings are split into chunks that meet two
by two.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.plans.lineage import drop

from .common import LOWER, arrow_map, each, fresh, written
from .components import components
from .simhash import _SPACE, SLICE, _bit_counts
from .simhash import links as hamming_links

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a parity fingerprint; rows of one shingle that are compared in one piece.
LANES, CHUNK = 8, 4096
#: One document of so many is counted to find common shingles; common are those of so many of the counted; at most so many of them.
PART, COMMON, MOST = 16, 64, 100_000
_SETS = "doc_id long, text_hash long, node long"


def shingles(raw: bytes | None, width: int = SHINGLE, slice_bytes: int = SLICE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole UTF-8 text's shingles; fewer words than ``width`` are one shingle, no words none."""
    digest = xxhash.xxh64_intdigest
    found, carry, pos, raw = [], [], 0, raw or b""
    while pos < len(raw):
        cut = _SPACE.search(raw, min(len(raw), pos + slice_bytes))
        end = cut.start() if cut else len(raw)
        words = carry + raw[pos:end].translate(LOWER).split()
        pos = end + 1
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = [0, *(ends[:-width] + 1).tolist()]
            found.append(np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)))
            words = words[len(words) - width + 1 :]
        carry = words
    if not found:
        return np.array([digest(b" ".join(carry), 42)] if carry else [], np.uint64)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def _print(own: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is in over half the shingles."""
    return int(((_bit_counts(own) * 2 > len(own)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))).view(np.int64)) if len(own) else 0


def _sketch(own: np.ndarray) -> np.ndarray:
    """A parity fingerprint of about four bits a shingle, a power of two and at least LANES words; its halves' xor is the one of half the bits."""
    bits = max(64 * LANES, 1 << min(20, (4 * len(own)).bit_length()))
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(sketch: np.ndarray, lanes: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, lanes), axis=0)


def _prefixes(common, similarity: float, width: int):
    """(doc_id, text_hash, raw) -> (doc_id, text_hash, node, size, fp, parity, sketch, keys)."""

    def run(batches):
        late = np.frombuffer(common.value, np.uint64)
        for b in batches:
            cols = [[], [], [], [], [], []]
            for raw in each(b.column(2)):
                own = shingles(raw, width)
                n = len(own)
                first = n - ceil(similarity * n - 1e-9) + 1 if n else 0
                order, sketch = own, _sketch(own)
                if len(late) and n:
                    is_late = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own
                    order = np.concatenate([own[~is_late], own[is_late]])
                for c, v in zip(cols, (_node(own), n, _print(own), _fold(sketch, LANES).tobytes(), sketch.tobytes(), order[:first].view(np.int64)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True))], ["doc_id", "text_hash", "node", "size", "fp", "parity", "sketch", "keys"])

    return run


def _whole(width: int):
    """(raw) -> (node, own): the set itself."""

    def run(batches):
        for b in batches:
            for raw in each(b.column(0)):
                own = shingles(raw, width)
                yield pa.RecordBatch.from_arrays([pa.array([_node(own)]), pa.array([own.tobytes()], pa.binary())], ["node", "own"])

    return run


def _counted(width: int):
    def run(batches):
        for b in batches:
            for raw in each(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw, width).view(np.int64))], ["key"])

    return run


def _near(x: int, rest: np.ndarray, size: np.ndarray, parity: np.ndarray, t: float) -> np.ndarray:
    """Which rows of rest may be similar to row x: never false for one that is."""
    s = size[rest]
    differ = np.bitwise_count(parity[rest] ^ parity[x]).sum(axis=1)
    return (np.minimum(s, size[x]) >= t * np.maximum(s, size[x]) - 1e-6) & (differ <= (s + size[x]) * (1 - t) / (1 + t) + 1e-6)


def _meet(similarity: float, forest: bool):
    """(key, node, size, parity, root), sorted by key and node, so that meetings take alike trees -> candidates (a, b): a spanning forest of each meeting, or all pairs of different roots."""

    def pairs(node, size, parity, root):
        rest = np.arange(len(node))
        if forest:
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    x = queue.pop()
                    near = _near(x, rest, size, parity, similarity)
                    if near.any():
                        yield x, rest[near]
                        queue.extend(rest[near])
                        rest = rest[~near]
            return
        if (root == root[0]).all():
            return
        for x in rest[:-1]:
            other = rest[x + 1 :][root[x + 1 :] != root[x]]
            if len(other) and (near := _near(x, other, size, parity, similarity)).any():
                yield x, other[near]

    def run(batches):
        held, at = [], None

        def flush():
            node, size, root = (np.array([r[k] for r in held], np.int64) for k in (0, 1, 3))
            parity = np.frombuffer(b"".join(r[2] for r in held), np.uint64).reshape(len(held), LANES)
            for x, hit in pairs(node, size, parity, root):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[hit], node[x])), pa.array(np.maximum(node[hit], node[x]))], ["a", "b"])

        for b in batches:
            for key, *row in zip(*(each(c) for c in b.columns), strict=True):
                if key != at:
                    if len(held) > 1:
                        yield from flush()
                    held, at = [], key
                held.append(row)
        if len(held) > 1:
            yield from flush()

    return run


def _close(similarity: float):
    """The bound of ``_near`` once more, on fingerprints that grow with the sets."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y, m, n in zip(*(each(b.column(k)) for k in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                lanes = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_fold(x, lanes) ^ _fold(y, lanes)).sum()) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _holds(similarity: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(each(b.column(2)), each(b.column(3)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, root) per row of docs: root is alike in a component of documents joined by pairs of ``similarity`` or more.

    Equal sets are one node, those of null and empty texts too. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.cast("binary").alias("raw"))
    counted = arrow_map(raw.where(F.pmod(F.xxhash64("text_hash"), F.lit(PART)) == 0).select("raw"), _counted(width), "key long")
    late = [r["key"] for r in counted.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "key").limit(MOST).select("key").collect()]
    common = spark.sparkContext.broadcast(np.sort(np.array(late, np.int64).view(np.uint64)).tobytes())
    prefixes = written(arrow_map(raw, _prefixes(common, similarity, width), f"{_SETS}, size long, fp long, parity binary, sketch binary, keys array<long>"), "prefixes")
    rows = written(prefixes.select("doc_id", "text_hash", "node", "fp"), "rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = prefixes.groupBy("node").agg(F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    at = nodes.select("node", F.explode("keys").alias("key"))
    shared = at.groupBy("key").count().where("count > 1")
    meet = written(at.join(shared, "key").select("key", "node", "count"), "meetings")
    marks = nodes.select("node", "size", "parity", "sketch").join(meet.select("node").distinct(), "node", "left_semi")
    marks = written(marks, "marks")
    drop(prefixes)

    def candidates(roots: DataFrame | None) -> DataFrame:
        own = marks.drop("sketch")
        own = own.withColumn("root", F.col("node")) if roots is None else own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        met = meet.join(own, "node").withColumn("g", F.ceil(F.col("count") / chunk))
        cell = met.withColumn("c", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        cell = cell.select(F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "k"), F.greatest("c", "k"))).alias("key"), "node", "size", "parity", "root")
        cell = cell.repartition(n, "key").sortWithinPartitions("key", "node")
        pairs = written(arrow_map(cell, _meet(similarity, roots is None), "a long, b long").distinct(), "candidates")
        ends = [marks.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("sketch").alias(f"{k}_sketch")) for k in "ab"]
        both = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "a_sketch", "b_sketch", "a_size", "b_size")
        return arrow_map(both, _close(similarity), "a long, b long")

    def held(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        one = firsts.join(ends, "node").select(F.col("k.text_hash").alias("text_hash"), F.coalesce("k.doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"))
        found = raw.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).join(one, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
        sets = written(arrow_map(found.select("raw"), _whole(width), "node long, own binary"), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
        out = written(arrow_map(both.select("a", "b", "x", "y"), _holds(similarity), "a long, b long"), "links")
        drop(sets)
        return out

    # copies are summed up before they move: of each set one document
    firsts = written(rows.groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("k")), "firsts")
    prints = written(rows.select("node", "fp").distinct(), "prints")
    heads = written(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    alike = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head"))
    bits = hamming_links(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    by_bits = alike.unionByName(bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = held(written(by_bits.unionByName(candidates(None)).distinct(), "pairs"))
    links = first.unionByName(held(written(candidates(components(first)), "pairs")))
    comp = written(components(links).select("node", "root"), "roots")
    return rows.select("doc_id", "text_hash", "node").join(comp, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """One row of each component of similar documents, that of the smallest doc_id (nulls last); columns as given."""
    if not docs.columns:
        return docs
    found = similar(docs, id_col, text_col, similarity, width)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    ids, hashes = fresh(docs, "keep_id", "keep_hash")
    keep = keep.select(F.coalesce("k.doc_id", F.lit(-(1 << 63)).cast("long")).alias(ids), F.col("k.text_hash").alias(hashes))
    own = docs.withColumn(ids, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn(hashes, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return own.join(keep, [ids, hashes]).dropDuplicates([ids, hashes]).select(*[F.col(f"`{c}`") for c in docs.columns])
