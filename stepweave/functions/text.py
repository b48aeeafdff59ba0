"""Text functions of the engine as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that matching leaves out of queries, and what names of files begin and end with.
KEYWORDS = ("given", "when", "then", "and", "but")
STOP_WORDS = ("a", "an", "the", "i", "is", "am", "are", "to", "in", "on", "at", "of", "as", "by", "my", "me")
ROUTER_HEAD, ROUTER_TAILS = "^(?:src/|backend/|server/|app/)?(?:routes/|routers/|api/)?", (r"\.(?:routes|router)\.(?:ts|js|mjs|cjs)$", r"\.(?:ts|js|mjs|cjs)$", "/index$")
CONTRACT_HEAD, CONTRACT_TAILS = "^(?:src/|backend/|contracts/|routes/)+", (r"\.(?:ts|js)$", r"\.(?:contract|routes|router)$")
# End of fixed values.


def _accented() -> tuple[str, str]:
    """Lower-case letters that Unicode composes of a letter and marks, and these letters."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    pairs = [(c, d[0]) for c, d in parts.items() if len(d) > 1 and c == c.lower() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accented()
_FOLD = str.maketrans(ACCENTED, PLAIN)


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(s: str) -> str:
    """A string as search_tokens folds columns."""
    return "".join(x for x in s.lower().translate(_FOLD) if not unicodedata.combining(x))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def query_words(c: Column) -> Column:
    """The words that a step is searched by: a-z and 0-9 of each white-space separated word, without keywords and stop words."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*KEYWORDS, *STOP_WORDS))


def _unkeyed(c: Column) -> Column:
    return F.regexp_replace(c, "^(?i)(given|when|then|and|but) ", "")


def action_name(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_unkeyed(F.lower(trim(c))), '"[^"]*"', ""), r"\b[0-9]+\b", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit("")), F.lit("unnamed action"))


def step_pattern(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_unkeyed(trim(c)), '"[^"]*"', "{string}"), r"\b[0-9]+\b", "{int}")


def search_tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case and without accents, composed or not."""
    return F.regexp_extract_all(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{Mn}", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _named(path: Column, head: str, tails: tuple[str, ...]) -> Column:
    name = F.regexp_replace(path, head, "")
    for tail in tails:
        name = F.regexp_replace(name, tail, "")
    return name


def router_name(path: Column) -> Column:
    """A router's name from its file: usual folders, extensions and a last /index are taken off; of nothing left, the path."""
    return F.coalesce(F.nullif(_named(path, ROUTER_HEAD, ROUTER_TAILS), F.lit("")), path)


def contract_name(path: Column) -> Column:
    """A contract's name from its file: usual folders, however many, then the extension, then a usual ending are taken off."""
    return _named(path, CONTRACT_HEAD, CONTRACT_TAILS)


def compose_path(parent: Column, local: Column, index: Column) -> Column:
    """The full path of a page below its parent's: an absolute one stands alone, one slash at the parent's end is not doubled."""
    joined = F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), local)
    bare = local.isNull() | (local == "")
    return F.when(index | bare, F.coalesce(parent, F.lit("/"))).when(local.startswith("/"), local).when(parent.isNull() | (parent == ""), local).otherwise(joined)
