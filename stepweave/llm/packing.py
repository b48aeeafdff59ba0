"""Best-fit packing of token sequences by bin completion.

Tasks tokenize whole texts and cut them into pieces; pieces of one length are alike, so the packing is
solved on the counts of the lengths (at most ``capacity`` of them, whatever the corpus holds). Bin
completion takes a length left and enumerates the undominated fillings around it, fullest first: a filling
is dominated if a length left out fits beside it, or in place of some of its pieces that sum to no more.
Branch and bound over these choices prunes a branch whose lower bound can't beat the incumbent, and never
lays a filling whose waste is over what the incumbent allows; the first incumbent is best-fit.

Two searches follow each other until one reaches the lower bound: dives that use a filling as often as the
counts allow, of ever greater width; then one bin at a time over every undominated filling, which proves
its result where it ends. ``steps`` bounds both (None: no bound, so the result is proven least).
Within it the result is a whole packing all the same; ``Packed.proven`` tells. Pieces find their place by
their rank among equals, counted per partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, each, load, text_or_empty, written

CAPACITY = 2048
#: Words whose ids a worker remembers, twice: those met of late, and those before them.
WORDS = 250_000
#: Steps of the search for a packing: what a query spends on the driver, a second or two.
STEPS = 2_000_000
PIECE = "doc_id long, piece int, start long, length long, ids binary, part long, nth long"
#: Lines, each a word: those that the tokenizer surely cuts in three (punctuation, letters that its normalizer only lower-cases,
#: punctuation) in these parts, others with none. Apostrophes are left to the tokenizer.
_PARTED = re.compile(r"^(?:([!-&(-/:-@\[-`{-~]*)([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)$|.*$)", re.M).findall
_workers: dict[str, "_WordIds"] = {}  # per Python worker: tokenizers with their words


class _WordIds:
    """Bytes of the little-endian ids (16 bits each where the vocabulary allows, else 32) of each white-space separated word.

    The tokenizer folds white space and case and splits at white space, so a text's ids are its words' ids in order. Words
    not met of late are learned together: where the model marks the ends of words, their letters pass it in one text, without
    the normalizer and the patterns that such letters do not need.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.plain = None
        if mark:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(size, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(mark)]] = True

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, words: list[bytes]) -> None:
        if not words:
            return
        if not self.plain:
            self.new.update(zip(words, self._slow([w.decode() for w in words]), strict=True))
            return
        found = _PARTED(b"\n".join(words).decode().lower())
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        marks = list({x for head, _, tail in found for x in (head, tail) if x not in self.marks})
        if marks:
            self.marks.update(zip(marks, self._slow(marks), strict=True))
        letters = list(dict.fromkeys(x for _, x, _ in found if x))
        ids, mark, rest = dict(zip(letters, self._letters(letters), strict=True)) if letters else {}, self.marks, []
        for w, (head, x, tail) in zip(words, found, strict=True):
            if x:
                self.new[w] = mark[head] + ids[x] + mark[tail] if head or tail else ids[x]
            else:
                rest.append(w)
        if rest:
            self.new.update(zip(rest, self._slow([w.decode() for w in rest]), strict=True))

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        if len(self.new) > WORDS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for w in set(words).difference(new):
            ids = old.get(w)
            if ids is None:
                missing.append(w)
            else:
                new[w] = ids
        self._learn(missing)
        return list(map(new.__getitem__, words))


def _tokenizer(path: str) -> _WordIds:
    if path not in _workers:
        _workers[path] = _WordIds(path)
    return _workers[path]


def token_bytes(words: _WordIds, raw: bytes, slice_bytes: int = 1 << 13) -> Iterator[bytes]:
    """The ids of a whole text in slices that end between words."""
    pos = 0
    while pos < len(raw):
        end = pos + slice_bytes
        if end < len(raw):
            end = min((p for p in (raw.find(b" ", end), raw.find(b"\n", end)) if p >= 0), default=len(raw))
        yield b"".join(words.of(raw[pos:end].split()))
        pos = end


def _documents(words: _WordIds, rows, slice_bytes: int = 1 << 13) -> Iterator[tuple[object, Iterator[bytes]]]:
    """(id, text) -> (id, slices of its ids): short texts are looked up together, long ones by slices."""

    def together() -> Iterator[tuple[object, Iterator[bytes]]]:
        parts = [raw.split() for _, raw in held]
        found, at = words.of(list(chain.from_iterable(parts))), 0
        for (doc, _), own in zip(held, parts, strict=True):
            yield doc, iter((b"".join(found[at : at + len(own)]),))
            at += len(own)

    held, size = [], 0
    for doc, raw in rows:
        if len(raw) > slice_bytes:
            yield from together()
            held, size = [], 0
            yield doc, token_bytes(words, raw, slice_bytes)
            continue
        held.append((doc, raw))
        size += len(raw)
        if size > slice_bytes:
            yield from together()
            held, size = [], 0
    yield from together()


def _pieces(path: str, capacity: int, end_id: int):
    """Per row of (doc_id, raw): its pieces. part and nth: the task, and how many pieces of this length it had before."""

    def cut(words: _WordIds, slices: Iterator[bytes]) -> Iterator[bytes]:
        width = words.kind.itemsize
        size, left = capacity * width, bytearray()
        for ids in chain(slices, (np.array([end_id], words.kind).tobytes(),)):
            left += ids
            at = 0
            while len(left) - at > size:
                yield bytes(left[at : at + size])
                at += size
            del left[:at]
        yield bytes(left)

    def run(batches):
        part, seen, words = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), _tokenizer(path)
        width = words.kind.itemsize
        for b in batches:
            out: list[tuple] = []
            for doc, slices in _documents(words, zip(each(b.column(0)), each(b.column(1)), strict=True)):
                for piece, ids in enumerate(cut(words, slices)):
                    n = len(ids) // width
                    out.append((doc, piece, piece * capacity, n, ids, part, int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE rows of all documents, ids little-endian in 16 or 32 bits each; a null text is an empty one, which is the end id alone."""
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("raw")), _pieces(tokenizer, capacity, end_id), PIECE)


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: bins that the long pieces need, plus what of the rest can't fit beside them."""
    n, half = np.zeros(capacity + 2, np.int64), capacity // 2
    n[list(counts)] = list(counts.values())
    many, weight = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    cut = np.arange(half + 1)  # pieces under cut are left out, those over capacity - cut stand alone
    high = capacity - cut
    large = many[capacity] - many[high]
    middle, room = many[high] - many[half], (many[high] - many[half]) * capacity - (weight[high] - weight[half])
    rest = weight[half] - np.where(cut > 0, weight[cut - 1], 0)
    return int(max(-(-weight[capacity] // capacity), (large + middle + np.maximum(0, -(-(rest - room) // capacity))).max()))


def _dominated(chosen: Pattern, left: dict[int, int], slack: int) -> bool:
    """Whether a length left out could stand in place of some of the chosen pieces (or of none) that sum to no more than it."""
    held = dict(chosen)
    out = [x for x in left if left[x] > held.get(x, 0)]
    if not out:
        return False
    if min(out) <= slack:
        return True
    sums, at = 1, sorted(held)  # bit s: pieces shorter than x sum to s
    k = 0
    for x in sorted(out):
        while k < len(at) and at[k] < x:
            for _ in range(held[at[k]]):
                sums |= sums << at[k]
            k += 1
        low = max(1, x - slack)
        if sums >> low & ((1 << (x - low + 1)) - 1):
            return True
    return False


class _Spent(Exception):
    """The steps of a search are used up."""


class _Steps:
    def __init__(self, most: int | None):
        self.left = most

    def take(self, n: int = 1) -> None:
        if self.left is not None:
            self.left -= n
            if self.left < 0:
                raise _Spent


def _fillings(left: dict[int, int], k: int, capacity: int, waste: int, steps: _Steps) -> Iterator[tuple[int, Pattern]]:
    """(slack, filling) of the undominated fillings around a piece of length k that waste at most ``waste``: fullest first, then those of longer pieces. Made one at a time."""
    own = dict(left)
    own[k] -= 1
    lengths = [x for x in sorted(left, reverse=True) if own[x] and x <= capacity - k]
    steps.take(8 + 4 * len(lengths))
    # bit s of reach[i]: pieces from lengths[i] on sum to s, so that no step leads nowhere
    reach, room, mask = [1] * (len(lengths) + 1), capacity - k, (1 << (capacity - k + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        sums = reach[i + 1]
        for _ in range(min(own[lengths[i]], room // lengths[i])):
            more = (sums | sums << lengths[i]) & mask
            if more == sums:
                break
            sums = more
        reach[i] = sums

    def walk(i: int, rest: int, chosen: Pattern):
        if not rest:
            yield chosen
            return
        for j in range(i, len(lengths)):
            steps.take()
            if not reach[j] >> rest & 1:
                return
            x = lengths[j]
            for times in range(min(own[x], rest // x), 0, -1):
                if reach[j + 1] >> (rest - times * x) & 1:
                    yield from walk(j + 1, rest - times * x, (*chosen, (x, times)))

    for slack in range(min(waste, room) + 1):
        if reach[0] >> (room - slack) & 1:
            for filling in walk(0, room - slack, ()):
                steps.take(2 * len(own))
                if not _dominated(filling, own, slack):
                    chosen = dict(filling)
                    chosen[k] = chosen.get(k, 0) + 1
                    yield slack, tuple(sorted(chosen.items(), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit on counts: around the longest length left, always the longest that still fits; repeated while the counts allow."""
    left, out = {k: n for k, n in counts.items() if n}, []
    order = sorted(left, reverse=True)
    while order:
        room, chosen = capacity - order[0], [(order[0], 1)]
        for k in order:
            times = min((left[k] - (k == order[0])), room // k)
            if times > 0:
                room -= times * k
                chosen = [(k, times + 1), *chosen[1:]] if k == order[0] else [*chosen, (k, times)]
        times = min(left[k] // n for k, n in chosen)
        out.append((tuple(chosen), times))
        for k, n in chosen:
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return out


class Packed(NamedTuple):
    bins: list[tuple[Pattern, int]]
    bound: int
    proven: bool


def _laid(path) -> list[tuple[Pattern, int]]:
    out = []
    while path:
        path, step = path
        out.append(step)
    return out[::-1]


def _search(counts: dict[int, int], capacity: int, best: int, bound: int, width: int | None, steps: _Steps) -> tuple[list | None, bool]:
    """Depth first: a packing of fewer than ``best`` bins or None, and whether all was searched.

    With a width, so many fillings are tried around the longest length left, each used as often as the counts allow. Without
    one, every undominated filling of one bin at a time, around the length that has fewest of them where no waste is allowed.
    """
    total, found, dead = sum(k * n for k, n in counts.items()), None, set()

    def options(left: dict[int, int], bins: int, waste: int) -> Iterator[tuple[int, Pattern]]:
        room = (best - 1) * capacity - total - waste
        if room < 0 or bins + lower_bound(left, capacity) >= best:
            return iter(())
        if width is not None:
            return islice(_fillings(left, max(left), capacity, room, steps), width)
        state = (bins, frozenset(left.items()))
        if state in dead:
            return iter(())
        dead.add(state)  # searched once for each incumbent; equal counts and bins have wasted alike
        fewest = None
        for k in sorted(left, reverse=True)[: 1 if room else 6]:
            some = _fillings(left, k, capacity, room, steps)
            first = list(islice(some, 4))
            if fewest is None or len(first) < len(fewest[0]):
                fewest = first, some
            if len(first) < 2:
                break
        return chain(*fewest)

    try:
        stack = [(counts, 0, 0, (), options(counts, 0, 0))]
        while stack and best > bound:
            steps.take()
            left, bins, waste, path, own = stack[-1]
            slack, pattern = next(own, (None, None))
            if pattern is None:
                stack.pop()
                continue
            times = 1 if width is None else min(left[x] // n for x, n in pattern)
            used = dict(pattern)
            after = {x: m for x, n in left.items() if (m := n - used.get(x, 0) * times)}
            bins, waste, path = bins + times, waste + times * slack, (path, (pattern, times))
            if after:
                stack.append((after, bins, waste, path, options(after, bins, waste)))
            elif bins < best:
                best, found = bins, path
                dead.clear()
    except _Spent:
        return found and _laid(found), False
    return found and _laid(found), True


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = STEPS) -> Packed:
    """(filling, times) that use up counts exactly, in as few bins as the search finds; steps None: in the least number there is."""
    counts = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths run from 1 to the capacity")
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    bins, whole = sum(t for _, t in best), False
    for width, share in ((1, 0.1), (3, 0.2), (16, 0.2), (None, 0.5)):
        if bins <= bound:
            break
        most = None if steps is None and width is None else int(share * (steps or STEPS))
        found, ended = _search(counts, capacity, bins, bound, width, _Steps(most))
        whole = ended and width is None
        if found:
            best, bins = found, sum(t for _, t in found)
    return Packed(best, bound, whole or bins <= bound)


def places(packing: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces of it per bin, first bin, offset): pieces of a length, by rank, fill the fillings in turn. Sorted by length and rank."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for pattern, times in packing:
        offset = 0
        for k, n in pattern:
            out.append((k, rank.get(k, 0), n, base, offset))
            rank[k] = rank.get(k, 0) + n * times
            offset += k * n
        base += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _placed(table: np.ndarray, columns: list[str]):
    keys = table[:, 0] * (1 << 48) + table[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            ids, crcs = [], []
            for raw, n in zip(each(b.column(columns.index("ids"))), length.tolist(), strict=True):
                ids.append(raw if len(raw) == 4 * n else np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                crcs.append(zlib.crc32(ids[-1]))
            keep = [c for c in columns if c not in ("rank", "ids")]
            yield pa.RecordBatch.from_arrays([*[b.column(columns.index(c)) for c in keep], pa.array(ids, pa.binary()), pa.array(sequence), pa.array(offset), pa.array(crcs, pa.int64())], [*keep, "ids", "sequence_id", "offset", "ids_crc32"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", steps: int | None = STEPS) -> DataFrame:
    """Per piece of each document: (doc_id, piece, start, length, ids, sequence_id, offset, ids_crc32).

    ids: the piece's token ids, little-endian 32-bit numbers; ``sequences`` joins them. ids_crc32 is derived from the placed ids. Extra columns are not looked at.
    Only documents longer than ``capacity`` are cut. A null or empty text is one piece, the end id. Rows with
    equal or null ids are packed like any others; an empty table gives no rows.
    """
    rows = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    per = rows.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = places(complete_bins(counts, capacity, steps).bins)
    before = per.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    ranked = rows.join(before.hint("shuffle_hash"), ["part", "length"])  # the counts are the small side: token ids need not be sorted
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", (F.col("nth") + F.col("before")).alias("rank"))
    return arrow_map(ranked, _placed(table, ranked.columns), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, ids_crc32 long")


def _joined(batches):
    at, held = None, []

    def sequence():
        ids = np.frombuffer(b"".join(held), "<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], ["sequence_id", "length", "ids"])

    for b in batches:
        for own, ids in zip(each(b.column(0)), each(b.column(1)), strict=True):
            if own != at and held:
                yield sequence()
                held = []
            at = own
            held.append(ids)
    if held:
        yield sequence()


def sequences(packed: DataFrame) -> DataFrame:
    """What ``pack`` gave, assembled: (sequence_id, length, ids array<int>), one row per sequence, its pieces in order of their offsets."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.select("sequence_id", "offset", "ids").repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset").select("sequence_id", "ids")
    return arrow_map(rows, _joined, "sequence_id long, length int, ids array<int>")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = pack(load(spark, sf_dir, "documents"), word_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
