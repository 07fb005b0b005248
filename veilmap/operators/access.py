"""Row-level access: labels, index keys, grants, the visible set and why a record is in it.

A label is an expression over terms: a & b, a | c, brackets where both mix, quotes around anything but plain words, or
``public``. Terms that read ``public`` or ``inherited`` in any case are refused, and so is NUL in a term. A record's labels
are one disjunction. It is indexed by keys: a term stands for itself, a conjunction for its terms in order, each behind a
NUL, so no term can pass for several. Keys are worked out where items are written and kept with them. A viewer's grant is the keys that its terms satisfy; the visible set is a semi join of items
with the grant, less what is deleted or suppressed, and everything else is computed from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PUBLIC, MOST_NODES = "public", 1024
RESERVED = ("public", "inherited")
_TOKEN = re.compile(r'\s*(?:([&|()])|"((?:[^"\\]|\\.)*)"|([^\s&|()"]+))')


class LabelError(ValueError):
    """A label that can't be read."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise LabelError(f"can't read {text[at:]!r}")
        if m[1]:
            out.append((m[1], m[1]))
        else:
            term = re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3]
            if not term:
                raise LabelError("a term is empty")
            if "\0" in term:
                raise LabelError("a term holds NUL")
            quoted = m[2] is not None
            if term.casefold() in RESERVED and (quoted or term != PUBLIC):
                raise LabelError(f"{term!r} is reserved")
            out.append(("term", term))
        at = m.end()
    return out


def parse(text: str, most: int = MOST_NODES) -> frozenset[frozenset[str]]:
    """A label as its alternatives, each a set of terms that must all be held, with absorbed ones left out.

    The empty set of terms stands for ``public``.
    """
    tokens = _tokens(text)
    if not tokens:
        raise LabelError("a label is empty")
    if tokens == [("term", PUBLIC)]:
        return frozenset([frozenset()])
    at = nodes = 0

    def one():
        nonlocal at, nodes
        if at >= len(tokens):
            raise LabelError("a term is missing")
        kind, value = tokens[at]
        at += 1
        if kind == "(":
            got = either()
            if at >= len(tokens) or tokens[at][0] != ")":
                raise LabelError("a bracket is not closed")
            at += 1
            return got
        if kind != "term":
            raise LabelError(f"unexpected {value!r}")
        if value == PUBLIC:
            raise LabelError("public stands alone")
        nodes += 1
        return {frozenset([value])}

    def either():
        nonlocal at, nodes
        got = one()
        op = None
        while at < len(tokens) and tokens[at][0] in "&|":
            if op and tokens[at][0] != op:
                raise LabelError("brackets are needed where & and | mix")
            op = tokens[at][0]
            at += 1
            nodes += 1
            more = one()
            got = got | more if op == "|" else {a | b for a in got for b in more}
            if len(got) > most or (nodes > most and any(len(a) > 1 for a in got)):
                raise LabelError("a label is too large")
        return got

    got = either()
    if at != len(tokens):
        raise LabelError(f"unexpected {tokens[at][1]!r}")
    return frozenset(a for a in got if not any(b < a for b in got))


def key_of(alternative: frozenset[str]) -> str:
    if not alternative:
        return PUBLIC
    return next(iter(alternative)) if len(alternative) == 1 else "".join("\0" + t for t in sorted(alternative))


def _terms_of(key: str) -> list[str]:
    return key[1:].split("\0") if key.startswith("\0") else [key]


def quoted(term: str) -> str:
    """A term as a label writes it."""
    return term if re.fullmatch(r'[^\s&|()"]+', term) else '"' + term.replace("\\", "\\\\").replace('"', '\\"') + '"'


def normal(text: str) -> str:
    """A label in canonical form."""
    alternatives = sorted(sorted(a) for a in parse(text))
    if alternatives == [[]]:
        return PUBLIC
    both = len(alternatives) > 1
    return "|".join("(" + "&".join(map(quoted, a)) + ")" if both and len(a) > 1 else "&".join(map(quoted, a)) for a in alternatives)


@lru_cache(maxsize=100_000)
def index_keys(labels: tuple[str, ...]) -> tuple[str, ...]:
    """The keys of a record's labels: one disjunction, absorbed as a whole."""
    every = {a for text in labels for a in parse(text)}
    return tuple(sorted(key_of(a) for a in every if not any(b < a for b in every)))


def with_keys(items: DataFrame, labels: str = "labels") -> DataFrame:
    """items with a column keys. Distinct label lists are parsed once; null or empty lists have no key."""

    @F.pandas_udf(ArrayType(StringType()))
    def keys(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: list(index_keys(tuple(x))) if x is not None else [])

    kinds = items.select(labels).where(F.size(labels) > 0).distinct().withColumn("keys", keys(labels)).withColumnRenamed(labels, "kind_")
    return items.join(kinds, items[labels] == F.col("kind_"), "left").drop("kind_").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


_WORD = r'[^\s&|()"\x00]+'


def plain_keys(labels: Column) -> Column:
    """The keys of label lists whose labels are words or conjunctions of words (a&b), by built-in functions alone.

    Any other label fails the query: lists that may hold one go through with_keys.
    """
    plain = lambda x: x.rlike(f"^{_WORD}(&{_WORD})*$") & ((x == PUBLIC) | ~F.exists(F.split(x, "&"), lambda t: F.lower(t).isin(*RESERVED)))
    checked = F.transform(labels, lambda x: F.when(plain(x), x).otherwise(F.raise_error(F.concat(F.lit("not a plain label: "), F.coalesce(x, F.lit("null"))))))
    every = F.array_distinct(F.transform(checked, lambda x: F.array_sort(F.array_distinct(F.split(x, "&")))))
    least = F.filter(every, lambda a: ~F.exists(every, lambda b: (F.size(b) < F.size(a)) & (F.size(F.array_except(b, a)) == 0)))
    keys = F.array_sort(F.transform(least, lambda a: F.when(F.size(a) == 1, a[0]).otherwise(F.concat(F.lit("\0"), F.array_join(a, "\0")))))
    public = F.array_contains(checked, PUBLIC)
    return F.when(labels.isNull(), F.array().cast("array<string>")).when(public, F.array(F.lit(PUBLIC))).otherwise(keys)


def item_keys(items: DataFrame) -> DataFrame:
    """The exploded relation (entity, key)."""
    return items.select("entity", F.explode("keys").alias("key"))


@dataclass(frozen=True)
class Viewer:
    """Who asks: the terms held, or everything that has a key."""

    terms: frozenset[str] = frozenset()
    read_all: bool = False

    @staticmethod
    def of(*terms: str) -> Viewer:
        return Viewer(frozenset(terms))

    def satisfies(self, key: str) -> bool:
        if self.read_all or key == PUBLIC:
            return True
        return set(_terms_of(key)) <= self.terms

    def held(self, label: str | None) -> bool:
        """Whether a view, layer or artifact of this label is open to the viewer; without label it is."""
        return label is None or any(self.satisfies(key_of(a)) for a in parse(label))


def satisfied(key, viewer: Viewer):
    """Whether one key column is satisfied by the viewer."""
    terms = F.array(*[F.lit(t) for t in sorted(viewer.terms)]) if viewer.terms else F.array().cast("array<string>")
    parts = F.split(F.substring(key, 2, 1 << 30), "\0")
    return (key == PUBLIC) | F.array_contains(terms, key) | (key.startswith("\0") & F.forall(parts, lambda p: F.array_contains(terms, p)))


def authorised(items: DataFrame, viewer: Viewer) -> DataFrame:
    """Items one of whose keys the viewer satisfies. The test runs on the item's own short key list: no join, no shuffle,
    and an item with several keys counts once."""
    if viewer.read_all:
        return items.where(F.size("keys") > 0)
    return items.where(F.exists("keys", lambda k: satisfied(k, viewer)))


def authorised_by_relation(items: DataFrame, keys: DataFrame, viewer: Viewer) -> DataFrame:
    """As authorised, where keys are kept as the relation (entity, key): a semi join with the satisfied part."""
    own = keys if viewer.read_all else keys.where(satisfied(F.col("key"), viewer))
    return items.join(own.select("entity"), "entity", "left_semi")


def visible(items: DataFrame, viewer: Viewer, deleted: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """The visible set: authorised items without those in either overlay (entity)."""
    out = authorised(items, viewer)
    for gone in (deleted, suppressed):
        if gone is not None:
            out = out.join(gone.select("entity"), "entity", "left_anti")
    return out


def witness(keys: Iterable[str], viewer: Viewer) -> list[str]:
    """Why a record is visible: the clauses that the viewer satisfies, those of fewest terms first, as labels write them."""
    held = [_terms_of(k) for k in set(keys) if viewer.satisfies(k)]
    return ["&".join(map(quoted, ts)) for ts in sorted(held, key=lambda ts: (len(ts), ts))]


def why_visible(items: DataFrame, viewer: Viewer) -> DataFrame:
    """items with the clauses that let the viewer see them, those of fewest terms first, as labels write them."""
    held = F.filter("keys", lambda k: satisfied(k, viewer) | F.lit(viewer.read_all))
    parts = F.transform(held, lambda k: F.when(k.startswith("\0"), F.split(F.substring(k, 2, 1 << 30), "\0")).otherwise(F.array(k)))
    ranked = F.array_sort(F.transform(parts, lambda ts: F.struct(F.size(ts).alias("n"), ts.alias("ts"))))
    quote = lambda t: F.when(t.rlike(f"^{_WORD}$"), t).otherwise(F.concat(F.lit('"'), F.regexp_replace(t, r'([\\"])', r"\\$1"), F.lit('"')))
    return items.withColumn("why", F.transform(ranked, lambda s: F.array_join(F.transform(s["ts"], quote), "&")))


def writable(rows: DataFrame, viewer: Viewer) -> DataFrame:
    """Rows that a writer may name: the write scope is the writer's own authorised set."""
    return authorised(rows, viewer)
