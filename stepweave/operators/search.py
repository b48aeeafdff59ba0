"""Full-text search with BM25 over name, label and properties of nodes.

The index is a table of postings, written once in order of terms, so that a query reads the row groups of its terms alone:
per term and node, where in each column the term stands. Statistics cover all kinds; a kind only filters the result. Lower
ranks are better. Ties go by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import fold, search_tokens
from stepweave.plans.lineage import written

from .rank import best_of_block

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("name", "label", "properties")
#: Tables of so many terms go to all tasks; larger ones are joined by the term.
FEW_TERMS = 200_000
#: Of the blocks in which forms of queries meet nodes: nodes of one, and postings met in one, at most and about at least.
NODES_OF_BLOCK, MOST_HITS, LEAST_HITS = 1 << 17, 2_000_000_000, 20_000_000


@dataclass(frozen=True)
class Index:
    nodes: DataFrame
    postings: DataFrame  # term, id, kind, dl, tf, and per column the places of the term
    terms: DataFrame  # term, kind, n: how many nodes of a kind hold a term
    n: int
    average: float


def _tokens(nodes: DataFrame) -> DataFrame:
    """(id, kind, dl, term, field, place) of each token."""
    own = nodes.select("id", "kind", *[search_tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS]).withColumn("dl", sum((F.size(c) for c in COLUMNS), F.lit(0)))
    # a column's tokens follow the last column's with a gap, so that no phrase runs over
    shift = {c: sum((F.size(x) + 1 for x in COLUMNS[:k]), F.lit(0)) for k, c in enumerate(COLUMNS)}

    def placed(c: str) -> Column:
        return F.transform(c, lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("field"), (i + shift[c]).alias("place")))

    tokens = [placed(c) for c in COLUMNS]
    return own.select("id", "kind", "dl", F.explode(F.concat(*tokens)).alias("t")).select("id", "kind", "dl", "t.*")


def _postings(tokens: DataFrame) -> DataFrame:
    places = [F.array_sort(F.collect_list(F.when(F.col("field") == c, F.col("place")))).alias(c) for c in COLUMNS]
    return tokens.groupBy("term", "id", "kind", "dl").agg(F.count("*").alias("tf"), *places)


def _index(nodes: DataFrame, postings: DataFrame, n: int, words: int) -> Index:
    terms = written(postings.groupBy("term", "kind").agg(F.count("*").alias("n")), "terms")
    return Index(nodes, postings, terms, n, words / n if n and words else 1.0)


def _ordered(postings: DataFrame) -> DataFrame:
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def index(nodes: DataFrame) -> Index:
    # the tokens are dealt by ranges, and their postings lie in order as they are made
    postings = written(_postings(_tokens(nodes).repartitionByRange("term", "id")).sortWithinPartitions("term", "id"), "postings")
    n = nodes.count()
    words = postings.agg(F.sum("tf")).first()[0] or 0
    return _index(nodes, postings, n, words)


def update(ix: Index, nodes: DataFrame, changed: DataFrame) -> Index:
    """The index of nodes, whose rows of changed(id) are new, altered or gone since ix: only these are read anew."""
    ids = changed.select("id").distinct()
    old, new = ix.postings.join(ids, "id", "left_anti").select(*ix.postings.columns), _postings(_tokens(nodes.join(ids, "id", "left_semi")))
    postings = written(_ordered(old.unionByName(new)), "postings")
    return _index(nodes, postings, nodes.count(), postings.agg(F.sum("tf")).first()[0] or 0)


def idf(df: Column, n: int) -> Column:
    raw = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def weight(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def search_terms(ix: Index, queries: DataFrame, kinds: list[str], limit: int = 50, words: DataFrame | None = None) -> DataFrame:
    """queries(q, term) -> (q, kind, id, rank): of each kind the best ``limit`` nodes that hold any of a query's distinct terms.

    Queries with the same terms among a kind's are one form there, and of nodes that weigh the same in all terms asked for only
    the first ``limit`` by id can be among the best of any. Blocks of forms meet blocks of these nodes in one task each, which
    returns the best of its block alone: no table holds pairs of forms and nodes. words(term): the queries' terms, if another
    table has them with less work.
    """
    own = ix.terms.join((queries if words is None else words).select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("kind", "n")).alias("held"))
    asked = own.select("term", idf(F.col("df"), ix.n).alias("idf"), F.inline("held")).where(F.col("kind").isin(kinds))
    asked = written(asked.withColumn("t", F.monotonically_increasing_id()), "asked")
    few = F.broadcast if asked.count() <= FEW_TERMS else lambda df: df
    scored = ix.postings.where(F.col("kind").isin(kinds)).join(few(asked.select("term", "kind", "idf", "t")), ["term", "kind"])
    scored = scored.select("kind", "id", F.struct("t", (F.col("idf") * weight(F.col("tf"), F.col("dl"), ix.average)).alias("s")).alias("held"))
    alike = Window.partitionBy("kind", "held").orderBy("id")
    nodes = scored.groupBy("kind", "id").agg(F.sort_array(F.collect_list("held")).alias("held")).withColumn("k", F.row_number().over(alike))
    nodes = written(nodes.where(F.col("k") <= limit).select("kind", "id", F.col("held.t").alias("t"), F.col("held.s").alias("s")), "weights")

    terms = F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("n"), "t")))
    own = queries.join(few(asked.select("term", "kind", "n", "t")), "term").groupBy("q", "kind").agg(terms.alias("terms"))
    # half of a SHA-256: no two lists of terms have the same
    form = F.unhex(F.substring(F.sha2(F.array_join("terms.t", ",").cast("binary"), 256), 1, 32))
    own = written(own.select("q", "kind", form.alias("form"), F.col("terms.t").alias("terms"), F.aggregate("terms.n", F.lit(0).cast("long"), lambda a, n: a - n).alias("hits")), "own")
    forms = written(own.groupBy("form").agg(F.first("kind").alias("kind"), F.first("terms").alias("terms"), F.first("hits").alias("hits")), "forms")
    count = {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    hits = {r["kind"]: r["n"] for r in forms.groupBy("kind").agg(F.sum("hits").alias("n")).collect()}
    by_node = {k: -(-count[k] // NODES_OF_BLOCK) for k in hits}
    blocks = {k: max(-(-n // MOST_HITS), min(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_HITS))) for k, n in hits.items()}
    by_form = {k: -(-n // by_node[k]) for k, n in blocks.items()}

    def of(counts: dict[str, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in (counts or {"": 1}).items() for x in kv]), F.col("kind"))

    def block(key: str, counts: dict[str, int]) -> Column:
        return F.pmod(F.xxhash64(key), of(counts)).cast("int")

    every = lambda counts: F.explode(F.sequence(F.lit(0), of(counts) - 1))
    dealt = ["kind", "node_block", "form_block"]
    left = forms.select("form", "terms", "kind", block("form", by_form).alias("form_block"), every(by_node).alias("node_block"))
    right = nodes.where(F.col("kind").isin(list(hits))).select("id", "t", "s", "kind", block("id", by_node).alias("node_block"), every(by_form).alias("form_block"))
    best = left.groupBy(*dealt).cogroup(right.groupBy(*dealt)).applyInArrow(best_of_block(limit), "form binary, best array<struct<rank:double,id:string>>")
    best = best.groupBy("form").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, limit).alias("best"))
    return own.select("q", "kind", "form").join(best, "form").select("q", "kind", F.inline("best")).select("q", "kind", "id", "rank")


# --- the query language ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """Words in a row; the last may be the beginning of one; in one column or in any."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


class QueryError(ValueError):
    pass


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[():*])|(?P<word>[0-9A-Za-z_\u0080-\U0010ffff]+))')
_TOKEN = re.compile(r"[^\W_]+")


def _fold(s: str) -> tuple[str, ...]:
    return tuple(_TOKEN.findall(fold(s)))


def parse_query(text: str):
    """Leaf, or ("and" | "or" | "not", left, right). Words side by side are joined by and, tighter than any operator."""
    tokens, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"syntax error near {text[at:at + 10]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not tokens:
        raise QueryError("an empty query")
    pos = 0

    def peek(k=0):
        return tokens[pos + k] if pos + k < len(tokens) else (None, None)

    def binary(word: str, inner):
        def run(column):
            nonlocal pos
            left = inner(column)
            while peek() == ("word", word):
                pos += 1
                left = (word.lower(), left, inner(column))
            return left

        return run

    def primary(column):
        nonlocal pos
        kind, value = peek()
        if kind == "word" and value in ("AND", "OR", "NOT") or kind is None or value in ("*", ":", ")"):
            raise QueryError(f"syntax error near {value!r}")
        pos += 1
        if value == "(":
            inner = either(column)
            if peek()[1] != ")":
                raise QueryError("a parenthesis is not closed")
            pos += 1
            return inner
        if kind == "word" and peek() == ("mark", ":"):
            if value.lower() not in COLUMNS:
                raise QueryError(f"no such column: {value}")
            pos += 1
            return primary(value.lower())
        prefix = peek() == ("mark", "*")
        pos += prefix
        return Leaf(_fold(value.strip('"').replace('""', '"')), prefix, column)

    def implicit(column):
        left = primary(column)
        while peek()[0] and peek()[1] not in ("AND", "OR", "NOT", ")"):
            left = ("and", left, primary(column))
        return left

    either = binary("OR", binary("AND", binary("NOT", implicit)))
    tree = either(None)
    if pos < len(tokens):
        raise QueryError(f"syntax error near {tokens[pos][1]!r}")
    return tree


def _leaves(tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for side in tree[1:] for x in _leaves(side)]


def _after(word: str) -> str:
    """The least text above all that begin with a word."""
    return word + "\U0010ffff"


def _fits_word(leaf: Leaf, k: int) -> Column:
    w, term = leaf.words[k], F.col("term")
    return (term >= w) & (term <= _after(w)) & term.startswith(w) if leaf.prefix and k == len(leaf.words) - 1 else term == w


def _places(leaf: Leaf) -> Column:
    own = F.concat(*[F.col(c) for c in (COLUMNS if leaf.column is None else (leaf.column,))])
    return own


def _occurrences(leaf: Leaf) -> Column:
    """How often a node, whose postings are a group, holds a leaf's words in a row within one column."""
    if not leaf.words:
        return F.lit(0)
    at = [F.flatten(F.collect_list(F.when(_fits_word(leaf, k), _places(leaf)))) for k in range(len(leaf.words))]
    if len(at) == 1:
        return F.size(at[0])
    return F.size(F.filter(at[0], lambda p: F.forall(F.array(*[F.struct(x.alias("x"), F.lit(k).alias("k")) for k, x in enumerate(at[1:], 1)]), lambda r: F.array_contains(r["x"], p + r["k"]))))


def search(ix: Index, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The nodes that a query of the full language fits, with rank, the best ``limit`` of them. Reads the postings of the query's words alone."""
    tree = parse_query(query)
    leaves = list(dict.fromkeys(_leaves(tree)))
    words = [_fits_word(x, k) for x in leaves for k in range(len(x.words))]
    wanted = F.lit(False)
    for w in words:
        wanted = wanted | w
    own = ix.postings.where(wanted).groupBy("id", "kind", "dl").agg(*[_occurrences(x).alias(f"f_{k}") for k, x in enumerate(leaves)])
    own = written(own, "hits")
    stats = own.agg(*[F.count_if(F.col(f"f_{k}") > 0).alias(f"n_{k}") for k in range(len(leaves))]).first()

    def fits(t) -> Column:
        if isinstance(t, Leaf):
            return F.col(f"f_{leaves.index(t)}") > 0
        left, right = fits(t[1]), fits(t[2])
        return left & right if t[0] == "and" else left | right if t[0] == "or" else left & ~right

    rank = F.lit(0.0)
    for x in _leaves(tree):
        k = leaves.index(x)
        f = F.col(f"f_{k}")
        rank = rank - idf(F.lit(float(stats[f"n_{k}"])), ix.n) * F.when(f > 0, weight(f, F.col("dl"), ix.average)).otherwise(0.0)
    found = own.where(fits(tree)).withColumn("rank", rank)
    found = (found if kind is None else found.where(F.col("kind") == kind)).orderBy("rank", "id").limit(limit).select("id", "rank")
    return ix.nodes.join(F.broadcast(found), "id").orderBy("rank", "id")  # at most ``limit`` rows
