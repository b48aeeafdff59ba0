"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

1. Map tasks turn texts into pairs of 48-bit word hashes, count equal pairs and send each shard of the
   pair-hash space one compressed block. Pair hashes are uniform, so no word or text makes a shard larger.
2. Each shard's task merges its blocks, writes its pairs as sorted arrays (hash, count) to the shared
   folder and sends, per word, what the pairs say of it to the shards of the word-hash space: as a first
   word its followers (tokens; types seen once, twice, more often), as a second word its count and the
   number of its predecessors. Beyond ``HOP`` shards a message goes to a group of shards first, where messages are
   added up before they are dealt on: S shards send S * sqrt(S) messages, not S * S.
3. Each word shard's task adds these up and writes the words' sorted arrays. Only the counts of counts, N
   and V reach the driver.
4. Scoring tasks map the arrays, a shard at a time, and look up a batch's distinct hashes in sorted order.

P(w | v) = max(c(v,w) - D(c), 0) / c(v) + lambda(v) P(w), P(w) = max(k(w) - D'(k), 0) / k + lambda' / (V + 1),
k(w) being w's number of predecessors, k their sum, and 1 / (V + 1) the share of each word and of an unknown
one. The discounts follow from the counts of counts (D1, D2, D3+). After an unknown word P(w) stands alone.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, each, load, mounted, new_dir, text_or_empty, written

#: Reserved hashes of the start and the end of a text.
START, END = 1, 2
#: Bytes of text per shard of pairs; words that a worker remembers; tokens that a task counts or scores at a time.
SHARD_BYTES, WORDS, TOKENS = 16 << 20, 200_000, 3_000_000
#: Bits of shards up to which messages between shards go straight; words that a group of shards adds up at a time.
HOP, HELD = 8, 1_000_000
WORD_FIELDS = ("count", "preds", "follow", "once", "twice", "more")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = max(xxhash.xxh64_intdigest(word) >> 16, 3)
        return h


def word_hashes(raw: bytes, known: _Hashes, slice_bytes: int = 4 << 20) -> np.ndarray:
    """48-bit hashes of a text's words (A-Z lower-cased), then END."""
    parts, pos = [], 0
    while pos < len(raw):
        end = min(len(raw), pos + slice_bytes)
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = raw[pos:end].translate(LOWER).split()
        if len(known) > WORDS:
            known.clear()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        pos = end
    parts.append(np.array([END], np.int64))
    return np.concatenate(parts)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 mixed bits of a pair, as signed integers."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def word_key(words: np.ndarray) -> np.ndarray:
    """Words by 64 mixed bits too: the shards of words are then even."""
    return pair_hash(words, np.zeros_like(words))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers of ``width`` bytes, first bytes first: compresses well when high bytes repeat."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def _block(columns: list[np.ndarray]) -> bytes:
    """One compressed block of columns of equal length, none negative; the first ascends. Each value takes as many bytes as its column's largest."""
    first, *rest = columns
    rows = [np.diff(first, prepend=0), *rest]
    widths = [max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1 for x in rows]
    return zstandard.compress(bytes(widths) + b"".join(_planes(x, w) for x, w in zip(rows, widths, strict=True)), 1)


def _unblock(block: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    widths = raw[:columns]
    n, at, out = (len(raw) - columns) // sum(widths), columns, []
    for width in widths:
        out.append(_unplanes(raw[at : at + n * width], n, width))
        at += n * width
    return [np.cumsum(out[0]), *out[1:]]


#: Columns of blocks: first word, second word, count; first word, followers, once, twice, more; second word, count, predecessors.
PAIRS, SIDES = 3, {"first": 5, "second": 3}


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


def _add(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else x[:0]


def _count_pairs(first: np.ndarray, second: np.ndarray, counts: np.ndarray):
    """Equal pairs added up, sorted by pair hash."""
    keys = pair_hash(first, second)
    order = np.argsort(keys)
    keys, starts = keys[order], None
    starts = _runs(keys)
    return keys[starts], first[order][starts], second[order][starts], _add(counts[order], starts)


def _pair_batches(bits: int):
    def run(batches):
        known, held, n = _Hashes(), [], 0

        def blocks():
            first = np.concatenate([np.concatenate(([START], h[:-1])) for h in held])
            second = np.concatenate(held)
            keys, first, second, counts = _count_pairs(first, second, np.ones(len(first), np.int64))
            shards = shard_of(keys, bits)
            order = np.lexsort((first, shards))
            first, second, counts, shards = first[order], second[order], counts[order], shards[order]
            starts = _runs(shards)
            ends = np.r_[starts[1:], len(shards)]
            yield pa.RecordBatch.from_arrays([pa.array(shards[starts], pa.int32()), pa.array([_block([first[a:b], second[a:b], counts[a:b]]) for a, b in zip(starts, ends, strict=True)], pa.binary())], ["shard", "block"])

        for b in batches:
            for raw in each(b.column(0)):
                h = word_hashes(raw, known)
                held.append(h)
                n += len(h)
                if n >= TOKENS:
                    yield from blocks()
                    held, n = [], 0
        if held:
            yield from blocks()

    return run


def _write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of arrays one after another: whole or absent, and the same whichever attempt writes it."""
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        for x in arrays:
            f.write(np.ascontiguousarray(x).data)
    os.replace(temp, f"{folder}/{name}")


def _by_shard(batches, names: tuple[str, ...]):
    """Groups of rows of a sorted partition, by their first column."""
    at, held = None, []
    for b in batches:
        for r in zip(*[each(b.column(b.schema.get_field_index(n))) for n in names], strict=True):
            if r[0] != at:
                if held:
                    yield at, held
                at, held = r[0], []
            held.append(r[1:])
    if held:
        yield at, held


def _sent(kind: str, words: np.ndarray, sums: list[np.ndarray], shards: np.ndarray):
    """(kind, shard, block) rows of words with their sums, by the shards that they go to."""
    order = np.lexsort((words, shards))
    words, sums, shards = words[order], [x[order] for x in sums], shards[order]
    cuts = _runs(shards)
    for a, b in zip(cuts, np.r_[cuts[1:], len(shards)], strict=True):
        yield kind, int(shards[a]), _block([words[a:b], *[x[a:b] for x in sums]])


def _merge_pairs(folder: str, bits: int, groups: int):
    """groups: bits of the shards, or of the groups of shards, that words' messages go to."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for shard, rows in _by_shard(batches, ("shard", "block")):
            parts = [_unblock(block, PAIRS) for (block,) in rows]
            keys, first, second, counts = _count_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            most = int(counts.max()) if len(counts) else 0
            wide = most >= 1 << 32
            _write_arrays(folder, f"pair-{shard:06d}", [keys, counts.astype(np.uint64 if wide else np.uint32)])
            out = [("counts", shard, None, *np.bincount(np.minimum(counts, 5), minlength=5)[1:5].tolist(), len(keys), wide)]
            for kind, own, columns in (("first", first, (counts, counts == 1, counts == 2, counts > 2)), ("second", second, (counts, np.ones_like(counts)))):
                order = np.argsort(own, kind="stable")
                own = own[order]
                starts = _runs(own)
                words, sums = own[starts], [_add(c[order].astype(np.int64), starts) for c in columns]
                out += [(*r, None, None, None, None, None, None) for r in _sent(kind, words, sums, shard_of(word_key(words), groups))]
            kinds = (pa.string(), pa.int32(), pa.binary(), *[pa.int64()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "shard", "block", "n1", "n2", "n3", "n4", "n", "wide"])

    return run


def _added(blocks: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Blocks of words with sums, added up by word."""
    words, *sums = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(words, kind="stable")
    starts = _runs(words[order])
    return words[order][starts], [_add(x[order], starts) for x in sums]


def _deal(bits: int, held: int):
    """Messages to a group of shards, added up and dealt on to its shards."""

    def run(batches):
        waiting: dict[str, list] = {k: [] for k in SIDES}

        def flush(kind):
            words, sums = _added(waiting[kind])
            waiting[kind] = []
            rows = list(_sent(kind, words, sums, shard_of(word_key(words), bits)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["kind", "shard", "block"])

        for _, rows in _by_shard(batches, ("shard", "kind", "block")):
            for kind, block in rows:
                waiting[kind].append(_unblock(block, SIDES[kind]))
                if sum(len(x[0]) for x in waiting[kind]) > held:
                    yield flush(kind)
        for kind in SIDES:
            if waiting[kind]:
                yield flush(kind)

    return run


def _merge_words(folder: str):
    def run(batches):
        for shard, rows in _by_shard(batches, ("shard", "kind", "block")):
            table = []
            for kind, block in rows:
                cols = _unblock(block, SIDES[kind])
                zero = np.zeros_like(cols[0])
                table.append([cols[0], zero, zero, *cols[1:]] if kind == "first" else [*cols, zero, zero, zero, zero])
            words, sums = _added(table)
            keys = word_key(words)
            order = np.argsort(keys, kind="stable")
            _write_arrays(folder, f"word-{shard:06d}", [keys[order], *[x[order].astype(np.int64) for x in sums]])
            seen = sums[1] > 0  # START is no word
            n = np.bincount(np.minimum(sums[1], 5), minlength=5)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (shard, *n[1:5].tolist(), int((sums[1] > 2).sum()), int(seen.sum()), int(sums[0].sum()), int(sums[1].sum()))] + [pa.array([len(seen)], pa.int64())], ["shard", "n1", "n2", "n3", "n4", "many", "types", "tokens", "preds", "rows"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 0, 1, 2 and 3 or more (Chen and Goodman); held within 0 and the count where the counts of counts are too few."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    of = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.1 * k), 0.95 * k) if a else 0.5 * k
    return [0.0, of(1, n1, n2), of(2, n2, n3), of(3, n3, n4)]


class Model:
    """Where the arrays are and the few numbers that hold for all of them. pairs, words: by shard, rows and the count's type."""

    def __init__(self, folder: str, bits: int, pairs: dict, words: dict, stats: dict):
        self.folder, self.bits, self.pairs, self.words = folder, bits, pairs, words
        self.pair_d, self.word_d = stats["pair_d"], stats["word_d"]
        self.tokens, self.types, self.preds = stats["tokens"], stats["types"], stats["preds"]
        n1, n2, n3 = stats["word_types"]
        self.unseen = (self.word_d[1] * n1 + self.word_d[2] * n2 + self.word_d[3] * n3) / self.preds if self.preds else 1.0


def train(texts: DataFrame, shard_bytes: int = SHARD_BYTES, folder: str | None = None, hop: int = HOP, held: int = HELD) -> Model:
    """A model of texts(text); null texts count as empty ones (their end is a token). No texts: every word is unknown. Repeated rows count each; extra columns are not looked at.

    folder: a path that driver and executors have mounted (file:// or plain); by default one in spark.checkpoint.dir.
    """
    spark = texts.sparkSession
    folder = mounted(folder or new_dir(spark, "kneser-ney"))
    raw = texts.select(text_or_empty("text").cast("binary").alias("raw"))
    size = texts.agg(F.sum(F.octet_length(text_or_empty("text")))).first()[0] or 0
    bits = min(20, max(3, (size // shard_bytes).bit_length()))
    groups = bits if bits <= hop else (bits + 1) // 2
    n = min(1 << bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << bits >> 2))
    blocks = arrow_map(raw, _pair_batches(bits), "shard int, block binary").repartition(n, "shard").sortWithinPartitions("shard")
    merged = written(arrow_map(blocks, _merge_pairs(folder, bits, groups), "kind string, shard int, block binary, n1 long, n2 long, n3 long, n4 long, n long, wide boolean"), "word-counts")
    pairs = {r["shard"]: r for r in merged.where("kind = 'counts'").drop("block").collect()}
    sent = merged.where("kind <> 'counts'").select("shard", "kind", "block")
    if groups < bits:  # a group's messages may be added up in several tasks
        sent = arrow_map(sent.repartition(n, "shard", F.pmod(F.xxhash64("block"), F.lit(8))).sortWithinPartitions("shard"), _deal(bits, held), "kind string, shard int, block binary").select("shard", "kind", "block")
    words = {r["shard"]: r for r in arrow_map(sent.repartition(n, "shard").sortWithinPartitions("shard"), _merge_words(folder), ", ".join(f"{c} long" for c in ("shard", "n1", "n2", "n3", "n4", "many", "types", "tokens", "preds", "rows"))).collect()}
    total = lambda rows, c: sum(r[c] for r in rows.values())
    stats = {"pair_d": discounts(*(total(pairs, f"n{k}") for k in range(1, 5))), "word_d": discounts(*(total(words, f"n{k}") for k in range(1, 5)))}
    stats |= {c: total(words, c) for c in ("tokens", "types", "preds")} | {"word_types": (total(words, "n1"), total(words, "n2"), total(words, "many"))}
    return Model(folder, bits, {k: (r["n"], "u8" if r["wide"] else "u4") for k, r in pairs.items()}, {k: (r["rows"], "i8") for k, r in words.items()}, stats)


class _Arrays:
    """Arrays of one kind; looked up by sorted hashes, shard by shard, each mapped for that long only, so that open files do not grow with the corpus."""

    def __init__(self, model: Model, kind: str, sizes: dict, fields: int):
        self.path, self.bits, self.sizes, self.fields = f"{model.folder}/{kind}-", model.bits, sizes, fields

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The fields of each key, 0 where it is not held."""
        own, back = np.unique(keys.view(np.uint64), return_inverse=True)  # in this order shards follow each other
        own = own.view(np.int64)
        out = [np.zeros(len(own), np.int64) for _ in range(self.fields)]
        shards = shard_of(own, self.bits)
        starts = _runs(shards)
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            s = int(shards[a])
            n, kind = self.sizes.get(s, (0, ""))
            if not n:
                continue
            rows = np.arange(a, z)
            held = np.memmap(f"{self.path}{s:06d}", np.int64, "r", shape=(n,))
            at = np.minimum(np.searchsorted(held, own[rows]), n - 1)
            hit = held[at] == own[rows]
            at, rows = at[hit], rows[hit]
            wide = int(kind[1])
            for k, o in enumerate(out):
                o[rows] = np.memmap(f"{self.path}{s:06d}", kind, "r", offset=8 * n + k * wide * n, shape=(n,))[at]
        return [o[back] for o in out]


def _score_batches(model: Model):
    def run(batches):
        words = _Arrays(model, "word", model.words, len(WORD_FIELDS))
        pairs = _Arrays(model, "pair", model.pairs, 1)
        known, pair_d, word_d = _Hashes(), np.array(model.pair_d), np.array(model.word_d)

        def scored(head, held):
            second = np.concatenate(held)
            first = np.concatenate([np.concatenate(([START], h[:-1])) for h in held])
            count, preds, *_ = words.find(word_key(second))
            _, _, follow, once, twice, more = words.find(word_key(first))
            (both,) = pairs.find(pair_hash(first, second))
            low = np.maximum(preds - word_d[np.minimum(preds, 3)], 0) / max(model.preds, 1) + model.unseen / (model.types + 1)
            some = np.maximum(follow, 1)
            back = np.where(follow > 0, (pair_d[1] * once + pair_d[2] * twice + pair_d[3] * more) / some, 1.0)
            p = np.log10(np.maximum(both - pair_d[np.minimum(both, 3)], 0) / some + back * low)
            base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            starts = np.r_[0, np.cumsum([len(h) for h in held])[:-1]]
            cols = [pa.array(head[0], pa.int64()), pa.array(head[1], pa.bool_()), pa.array([len(h) for h in held], pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)), pa.array([model.tokens] * len(held), pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(p, starts))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        head, held, n = ([], []), [], 0
        for b in batches:
            for doc, out, raw in zip(*(each(b.column(k)) for k in range(3)), strict=True):
                h = word_hashes(raw, known)
                head[0].append(doc)
                head[1].append(out)
                held.append(h)
                n += len(h)
                if n >= TOKENS // 4:
                    yield scored(head, held)
                    head, held, n = ([], []), [], 0
        if held:
            yield scored(head, held)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, held_out, text): token counts and log10 probabilities of whole texts; perplexity is 10 ** (-score / n_tokens). A row each: repeated rows too; a null or empty text is its end alone."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("held_out").cast("boolean"), text_or_empty("text").cast("binary").alias("raw"))
    return arrow_map(rows, _score_batches(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text): a fifth of the documents, by crc32 of the id as text, is held out; a null id is not."""
    return docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"), "text")


def op5_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    docs = split(load(spark, sf_dir, "documents"))
    return score(docs, train(docs.where("not held_out")))
