"""Quality by ordinal regression: a cumulative logit over hashed text, with ordered thresholds.

Grades: 0 low quality, 1 toxic but written well, 2 good. P(grade <= k) = 1 / (1 + exp(score - threshold_k)),
one weight vector for all grades. One task fits the model to a bounded sample of labelled documents (``SAMPLE``, an even
share of each grade, the smallest hashes of their ids, whatever the size of the corpus); every document is scored.

Features: each distinct word (punctuation off, A-Z lower-cased) and word beginning in two slots of a hashed space, and of
the shapes of words (case, digits, the punctuation around them) each one's share of all words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, arrow_map, each, fresh, load, text_or_empty, written

#: Labelled documents that the model is fitted to at most; slots of words and of shapes; documents that a word must occur in.
SAMPLE, WORD_BITS, SHAPE_BITS, LEAST_DOCUMENTS = 9000, 20, 12, 5
DIMS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Bytes of features that the model is fitted to at most: of the sample in order, documents up to that.
SAMPLE_BYTES = 96 << 20
#: How strongly a slot must go with the grades to get a weight: a chi-square of this share of the documents, and of this at least.
EFFECT, CHI_SQUARE = 0.02, 20.0
#: A document is kept if its probability of the best grade is at least this.
KEEP = 0.5
GRADES = 3
#: Texts that a worker scores at a time.
ROWS = 256
CACHE = 150_000
#: Bytes of a word's beginnings that are features too: inflected words share their stem.
STARTS = (4, 5)
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_KIND = bytes(ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Words(dict):
    """word -> its row; per row the slots of the bare word and of its beginnings (-1: none), and of its shape."""

    def __init__(self):
        super().__init__()
        self.slots = np.empty((0, 2 * (1 + len(STARTS))), np.int32)
        self.shapes = np.empty(0, np.int32)
        self.fresh: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_PUNCTUATION).translate(LOWER)
        shape = _RUN.sub(rb"\1\1", word.translate(_KIND))[:12]
        hashes = (xxhash.xxh64_intdigest(bare) if bare else 0, *(xxhash.xxh64_intdigest(bare[:n], n) if len(bare) >= n else 0 for n in STARTS))
        mask = (1 << WORD_BITS) - 1
        self.fresh.append((*(x for h in hashes for x in ((h & mask, h >> WORD_BITS & mask) if h else (-1, -1))), xxhash.xxh32_intdigest(shape) & ((1 << SHAPE_BITS) - 1)))
        self[word] = row = len(self.shapes) + len(self.fresh) - 1
        return row

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            more = np.array(self.fresh, np.int32)
            self.slots, self.shapes, self.fresh = np.concatenate([self.slots, more[:, :-1]]), np.concatenate([self.shapes, more[:, -1]]), []
        return self.slots, self.shapes


def _counted(raw: bytes, slice_bytes: int = 4 << 20) -> Counter:
    words: Counter = Counter()
    pos = 0
    while pos < len(raw):
        end = min(len(raw), pos + slice_bytes)
        while end < len(raw) and raw[end] > 32:
            end += 1
        words.update(raw[pos:end].split())
        pos = end
    return words


def features(texts, known: _Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of whole texts (bytes), sorted by row and slot: 0.5 for each slot of a word, five times its share of all words for each shape. No words: none.

    wanted: by slot, whether it matters; others are left out.
    """
    if len(known) > CACHE:
        known.__init__()
        known.clear()
    rows, words, times = [], [], []
    for k, raw in enumerate(texts):
        own = _counted(raw)
        rows.append(np.full(len(own), k, np.int64))
        words.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        times.append(np.fromiter(own.values(), np.float64, len(own)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, word, n = map(np.concatenate, (rows, words, times))
    slots, shapes = known.tables()
    if wanted is not None:  # by word first: most have no slot that matters
        matters = np.append(wanted, False)[slots]
        some = np.flatnonzero(matters.any(axis=1)[word])
        keys = (row[some, None] << 32 | slots[word[some]])[matters[word[some]]]
    else:
        keys = (row[:, None] << 32 | slots[word])[slots[word] >= 0]
    keys = np.unique(keys)
    by_shape, back = np.unique(row << 32 | (shapes[word] + (1 << WORD_BITS)), return_inverse=True)
    share = np.bincount(back, weights=n) / np.bincount(row, weights=n, minlength=len(rows))[by_shape >> 32] * 5
    if wanted is not None:
        held = wanted[by_shape & 0xFFFFFFFF]
        by_shape, share = by_shape[held], share[held]
    keys, values = np.r_[keys, by_shape], np.r_[np.full(len(keys), 0.5), share]
    order = np.argsort(keys, kind="stable")
    return keys[order] >> 32, keys[order] & 0xFFFFFFFF, values[order]


def _feature_batches(batches):
    """(id, grade, raw) -> (id, grade, slots, vals); only the shapes' values are sent, those of words are all alike."""
    known = _Words()
    for b in batches:
        row, slot, value = features(each(b.column(2)), known)
        cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
        slots = [slot[a:z].astype(np.int32).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        vals = [value[a:z][slot[a:z] >= 1 << WORD_BITS].astype(np.float32).tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, pa.binary()), pa.array(vals, pa.binary())], ["id", "grade", "slots", "vals"])


class Model:
    """Weights of the slots that have one, and the thresholds."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, thresholds: np.ndarray):
        self.slots, self.values, self.thresholds = slots, values, thresholds

    def weights(self) -> np.ndarray:
        out = np.zeros(DIMS)
        out[self.slots] = self.values
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, dims: int = 0, steps: int = 2000, batch: int = 128, rate: float = 0.05, decay: float = 1e-5, least: int = LEAST_DOCUMENTS) -> Model:
    """Adam on the negative log likelihood. Slots in fewer than ``least`` documents, or that go too weakly with the grades, get no weight. No rows: every score is 0, every grade as likely."""
    thresholds, dims = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)), dims or DIMS
    if not rows:
        return Model(np.empty(0, np.int64), np.empty(0), thresholds)
    # a document's slots differ from each other, so each adds one to its slots' counts
    by_grade, sizes = np.zeros((grades, dims), np.int32), np.bincount([r[0] for r in rows], minlength=grades)
    for grade, s, _ in rows:
        by_grade[grade, s] += 1
    seen = by_grade.sum(axis=0)
    # chi-square of a slot's presence against the grades; under independence, of two degrees of freedom
    chi = np.zeros(dims)
    for k in range(grades):
        if sizes[k]:
            expected = seen * (sizes[k] / len(rows))
            chi += (by_grade[k] - expected) ** 2 / np.maximum(expected, 1e-9)
    chi *= len(rows) / np.maximum(len(rows) - seen, 0.5)
    kept = np.flatnonzero((seen >= min(least, max(1, len(rows) // 4))) & (chi >= max(CHI_SQUARE, EFFECT * len(rows))))
    place = np.full(dims, -1, np.int64)
    place[kept] = np.arange(len(kept))
    data = []
    for grade, s, v in rows:
        own = place[s]
        ok = np.flatnonzero(own >= 0)
        first = len(s) - len(v)  # values are given of the last slots, the shapes'; those of words are all alike
        data.append((grade, own[ok], np.where(ok >= first, np.r_[v, 0.0][np.maximum(ok - first, -1)], 0.5).astype(np.float64)))
    share = np.cumsum(np.bincount([d[0] for d in data], minlength=grades) + 0.5) / (len(data) + 0.5 * grades)
    first = np.log(share[:-1] / (1 - share[:-1]))
    theta = np.r_[first[0], np.log(np.maximum(np.diff(first), 1e-3))]  # ordered: the first threshold, then logs of the steps
    w = np.zeros(len(kept))
    m, v2, tm, tv, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta), 0
    rng = np.random.default_rng(7)
    f = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(-(-steps // -(-len(data) // batch))):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            own = [data[i] for i in order[at : at + batch]]
            y = np.array([d[0] for d in own])
            size = np.array([len(d[1]) for d in own])
            idx, val, row = np.concatenate([d[1] for d in own]), np.concatenate([d[2] for d in own]), np.repeat(np.arange(len(own)), size)
            score = np.bincount(row, weights=w[idx] * val, minlength=len(own))
            cuts = np.cumsum(np.r_[theta[0], np.exp(theta[1:])])
            edges = np.r_[-np.inf, cuts, np.inf]
            up, low = f(edges[y + 1] - score), f(edges[y] - score)
            up[y == grades - 1], low[y == 0] = 1.0, 0.0
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            by_score = (d_up - d_low) / len(own)
            g = np.bincount(idx, weights=by_score[row] * val, minlength=len(w)) + decay * w
            by_cut = np.array([(d_low[y == k + 1].sum() - d_up[y == k].sum()) / len(own) for k in range(grades - 1)])
            tg = np.r_[by_cut.sum(), np.exp(theta[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]]
            step += 1
            for x, gr, a, b in ((w, g, m, v2), (theta, tg, tm, tv)):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(kept, w, np.cumsum(np.r_[theta[0], np.exp(theta[1:])]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels(doc_id, quality, toxic); of repeated ids the worst counts; rows without an id or a quality are left out."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return own.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("t") > 0, 1).otherwise(2).alias("grade"))


def _fit_batches(limit: int):
    """The features of the sample, in order, to one row: the model."""

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for grade, slots, vals in zip(*(each(b.column(k)) for k in (1, 2, 3)), strict=True):
                size += len(slots) + len(vals)
                if size <= limit or not rows:
                    rows.append((grade, np.frombuffer(slots, np.int32), np.frombuffer(vals, np.float32)))
        model = fit_ordinal(rows, GRADES)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in ((model.slots, np.int64), (model.values, np.float64), (model.thresholds, np.float64))], ["slots", "vals", "thresholds"])

    return run


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, grade, at) of at most ``sample`` labelled ids, as many of each grade as there are up to an even share; at: their order, by hash within a grade."""
    own = graded(labels).select(F.col("doc_id").alias("id"), "grade", F.xxhash64("doc_id").alias("h"))
    parts = [own.where(F.col("grade") == g).orderBy("h", "id").limit(-(-sample // GRADES)) for g in range(GRADES)]
    return reduce(DataFrame.unionByName, parts).select("id", "grade", F.col("h").alias("at"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Fits to at most ``sample`` labelled ids, evenly from the grades, one document of each id (of repeated ids the text of the least hash).

    The ids reach the documents by a broadcast of at most ``sample`` rows; one task fits, within SAMPLE_BYTES of features
    (of more, the first by hash are used); the driver gets the weights alone. Labels of ids that docs lacks change nothing.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty(text_col).alias("raw")).join(F.broadcast(sampled(labels, sample)), "id")
    one = raw.groupBy("id", "grade", "at").agg(F.min_by("raw", F.xxhash64("raw")).cast("binary").alias("raw"))
    rows = written(arrow_map(one.select("at", "grade", "raw"), _feature_batches, "id long, grade int, slots binary, vals binary"), "features")
    fitted = arrow_map(rows.repartition(1).sortWithinPartitions("id", "grade", "slots"), _fit_batches(SAMPLE_BYTES), "slots binary, vals binary, thresholds binary").first()
    if fitted is None:
        return fit_ordinal([], GRADES)
    return Model(np.frombuffer(fitted["slots"], np.int64), np.frombuffer(fitted["vals"], np.float64), np.frombuffer(fitted["thresholds"], np.float64))


def score_rows(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """df (its text a string column) with expected grade, and per grade above 0 the probability of at least that grade; the names of these columns."""
    grades = len(model.thresholds) + 1
    names = fresh(df, "expected_grade", *[f"at_least_{k}" for k in range(1, grades)])
    at, kept = df.columns.index(text_col), df.columns

    def run(batches):
        known, weights = _Words(), model.weights()
        wanted = weights != 0
        for b in batches:
            scores = np.empty(b.num_rows)
            for start in range(0, b.num_rows, ROWS):
                texts = b.column(at).slice(start, ROWS)
                row, slot, value = features((x or b"" for x in each(texts.cast(pa.binary()))), known, wanted)
                scores[start : start + len(texts)] = np.bincount(row, weights=weights[slot] * value, minlength=len(texts))
            tails = model.tails(scores)
            new = [pa.array(tails.sum(axis=1)), *[pa.array(np.ascontiguousarray(tails[:, k])) for k in range(grades - 1)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*kept, *names])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return arrow_map(df, run, schema), names


def select(docs: DataFrame, model: Model, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows whose probability of the best grade is at least ``keep``; columns as given. A null or empty text has no features and is judged by the thresholds alone."""
    out, names = score_rows(docs, model, text_col)
    return out.where(F.col(f"`{names[-1]}`") >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probabilities and whether it is kept."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"))
    out, (grade, some, best) = score_rows(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.col(grade).alias("expected_grade"), F.col(some).alias("p_not_low"), F.col(best).alias("p_good"), (F.col(best) >= KEEP).alias("kept"))
