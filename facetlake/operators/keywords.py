"""KW1-KW11: structured keyword predicates and BM25F relevance over term tables.

An expression becomes a handful of leaves (words and phrases), each looked up in the term
tables, then one aggregation per document: the boolean structure and the score are plain
column expressions over per-leaf sums. One shuffle, whatever the expression.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.stemming import stem
from facetlake.functions.text import fold_word
from facetlake.operators.index_tables import TermIndex
from facetlake.plans.catalog import IndexField

# Parameters of the relevance formula.
K1, B = 1.2, 0.75


class Expr:
    """A keyword predicate."""


@dataclass(frozen=True)
class Word(Expr):
    """KW1: the word occurs in any field of the scope."""

    text: str
    scope: str = "all"


@dataclass(frozen=True)
class Phrase(Expr):
    """KW6, KW7: the words follow each other in one field, at most ``slop`` positions apart."""

    text: str
    slop: int = 1
    scope: str = "all"


@dataclass(frozen=True)
class AllOf(Expr):
    """KW2."""

    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class AnyOf(Expr):
    """KW3."""

    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class NoneOf(Expr):
    """KW4: true when no part matches; adds no score."""

    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Boosted(Expr):
    """KW8: multiplies the score of a part."""

    part: Expr
    factor: float


def all_of(*parts: Expr) -> Expr:
    return AllOf(parts)


def any_of(*parts: Expr) -> Expr:
    return AnyOf(parts)


def none_of(*parts: Expr) -> Expr:
    return NoneOf(parts)


def multi_keywords(entries: Sequence[Expr]) -> Expr:
    """KW10: several keyword entries must all match."""
    return AllOf(tuple(entries))


def fields_of_scope(index_fields: Sequence[IndexField], scope: str) -> list[IndexField]:
    """KW9: fields listing the scope; an unknown scope is an error."""
    fields = [f for f in index_fields if scope in f.scopes]
    if not fields:
        raise KeyError(f"unknown scope {scope!r}")
    return fields


_TOKEN = re.compile(r"\w+(?:\.\w+)*")


def query_terms(text: str, analyzer: str) -> list[str]:
    """Query words as the field's analyzer stores them."""
    if analyzer == "id":
        return [text]
    if analyzer == "text":
        return [fold_word(stem(w)) for w in _TOKEN.findall(text)]
    # As in the stored fields: fold, then split.
    return _TOKEN.findall(fold_word(text))


# --- leaves -----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Alternative:
    leaf: int
    field: IndexField
    terms: tuple[str, ...]
    slop: int  # 0: the terms may stand anywhere in the field.


class _Leaves:
    def __init__(self, index_fields: Sequence[IndexField]):
        self.index_fields = index_fields
        self.numbers: dict[Expr, int] = {}
        self.alternatives: list[_Alternative] = []

    def number(self, leaf: Word | Phrase) -> int:
        if leaf not in self.numbers:
            self.numbers[leaf] = n = len(self.numbers)
            slop = leaf.slop if isinstance(leaf, Phrase) else 0
            for field in fields_of_scope(self.index_fields, leaf.scope):
                terms = tuple(query_terms(leaf.text, field.analyzer))
                if terms:
                    self.alternatives.append(_Alternative(n, field, terms, slop))
        return self.numbers[leaf]

    def collect(self, expr: Expr) -> None:
        if isinstance(expr, (Word, Phrase)):
            self.number(expr)
        elif isinstance(expr, Boosted):
            self.collect(expr.part)
        else:
            for part in expr.parts:
                self.collect(part)


def _matches_nothing_found(expr: Expr) -> bool:
    """Whether a document without any leaf hit satisfies the expression."""
    if isinstance(expr, (Word, Phrase)):
        return False
    if isinstance(expr, Boosted):
        return _matches_nothing_found(expr.part)
    results = [_matches_nothing_found(p) for p in expr.parts]
    if isinstance(expr, AllOf):
        return all(results)
    if isinstance(expr, AnyOf):
        return any(results)
    return not any(results)


def _evaluate(expr: Expr, leaves: _Leaves) -> tuple[Column, Column]:
    """(matches, score) columns over the per-leaf sums ``s0, s1, ...``."""
    if isinstance(expr, (Word, Phrase)):
        hit = F.col(f"s{leaves.numbers[expr]}")
        return hit.isNotNull(), F.coalesce(hit, F.lit(0.0))
    if isinstance(expr, Boosted):
        match, score = _evaluate(expr.part, leaves)
        return match, score * F.lit(float(expr.factor))
    parts = [_evaluate(p, leaves) for p in expr.parts]
    matches = [m for m, _ in parts]
    if isinstance(expr, AllOf):
        return (
            reduce(lambda a, b: a & b, matches, F.lit(True)),
            reduce(lambda a, b: a + b, [s for _, s in parts], F.lit(0.0)),
        )
    some = reduce(lambda a, b: a | b, matches, F.lit(False))
    if isinstance(expr, NoneOf):
        return ~some, F.lit(0.0)
    gated = [F.when(m, s).otherwise(F.lit(0.0)) for m, s in parts]
    return some, reduce(lambda a, b: a + b, gated, F.lit(0.0))


# --- lookups ----------------------------------------------------------------------------


def _term_table(index: TermIndex, alternatives: Sequence[_Alternative]) -> DataFrame:
    """The query as a table, with statistics: one row per leaf, field and term.

    Its size is that of the query, so broadcasting it is safe at any data size.
    """
    spark = index.postings.sparkSession
    rows = [
        F.struct(
            F.lit(a.leaf).alias("leaf"),
            F.lit(a.field.name).alias("field"),
            F.lit(order).alias("ord"),
            F.lit(term).alias("term"),
            F.lit(len(a.terms)).alias("n_terms"),
            F.lit(a.slop).alias("slop"),
            F.lit(a.field.analyzer == "id").alias("verbatim"),
            F.lit(float(a.field.boost)).alias("boost"),
        )
        for a in alternatives
        for order, term in enumerate(a.terms)
    ]
    query = spark.range(1).select(F.inline(F.array(*rows)))
    wanted = _wanted(alternatives)
    return (
        F.broadcast(query)
        .join(index.term_stats.filter(wanted), ["field", "term"])
        .join(index.field_stats, "field")
    )


def _wanted(alternatives: Sequence[_Alternative]) -> Column:
    """Literal predicate on field and term, so that the scan skips files and row groups."""
    fields = sorted({a.field.name for a in alternatives})
    terms = sorted({t for a in alternatives for t in a.terms})
    return F.col("field").isin(fields) & F.col("term").isin(terms)


def bm25f(tf: Column, length: Column, df: Column, sum_len: Column, n_docs: Column,
          boost: Column) -> Column:
    """KW11: relevance of one term in one field; the field's boost weighs its frequency."""
    idf = F.log(n_docs / (df + 1)) + 1
    weight = tf * boost
    norm = K1 * ((1 - B) + B * length / (sum_len / n_docs))
    return idf * weight * (K1 + 1) / (weight + norm)


def _scored(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting rows of the query's terms with their partial scores."""
    score = F.when(F.col("verbatim"), F.col("boost")).otherwise(
        bm25f(F.col("tf"), F.col("len"), F.col("df"), F.col("sum_len"), F.col("n_docs"),
              F.col("boost"))
    )
    return postings.join(F.broadcast(terms), ["field", "term"]).select(
        "id", "leaf", "field", "ord", "n_terms", "slop", score.alias("score")
    )


def _follow(lists: Column, slop: Column) -> Column:
    """Whether one position can be taken from each list, each 1..slop after the one before."""
    def step(reached: Column, here: Column) -> Column:
        nexts = F.flatten(
            F.transform(F.sequence(F.lit(1), slop), lambda d: F.transform(reached, lambda p: p + d))
        )
        return F.array_intersect(here, nexts)

    rest = F.slice(lists, F.lit(2), F.size(lists))
    return F.size(F.aggregate(rest, F.get(lists, F.lit(0)), step)) > 0


def phrase_matches(index: TermIndex, terms: DataFrame, wanted: Column) -> DataFrame:
    """``leaf, field, id`` of the documents holding a phrase.

    Grouped per document part: a group has one row per phrase word, and its positions come
    from one source text.
    """
    found = index.positions.filter(wanted).join(
        F.broadcast(terms.filter("n_terms > 1 AND slop > 0")), ["field", "term"]
    )
    grouped = found.groupBy("leaf", "field", "id", "part", "n_terms", "slop").agg(
        F.sort_array(F.collect_list(F.struct("ord", "positions"))).alias("words")
    )
    complete = grouped.filter(F.size("words") == F.col("n_terms"))
    lists = F.transform("words", lambda w: w["positions"])
    return complete.filter(_follow(lists, F.col("slop"))).select("leaf", "field", "id").distinct()


def keyword_hits(
    index: TermIndex, expr: Expr | None, index_fields: Sequence[IndexField]
) -> DataFrame:
    """``id, score`` of the documents matching the expression (F1: all without one)."""
    if expr is None:
        return index.ids.withColumn("score", F.lit(0.0))
    leaves = _Leaves(index_fields)
    leaves.collect(expr)
    alternatives = leaves.alternatives
    if alternatives:
        hits = _leaf_scores(index, alternatives, len(leaves.numbers))
    else:
        # No word of the expression has a token, so no leaf finds anything.
        hits = index.ids.filter(F.lit(False)).select(
            "id", *[F.lit(None).cast("double").alias(f"s{n}") for n in range(len(leaves.numbers))])
    if _matches_nothing_found(expr):
        hits = index.ids.join(hits, "id", "left")
    match, score = _evaluate(expr, leaves)
    return hits.filter(match).select("id", score.alias("score"))


def _leaf_scores(
    index: TermIndex, alternatives: Sequence[_Alternative], n_leaves: int
) -> DataFrame:
    """One row per document with the summed score of each leaf, NULL where it has no hit."""
    wanted = _wanted(alternatives)
    terms = _term_table(index, alternatives)
    scored = _scored(index.postings.filter(wanted), terms)
    rows = scored.filter("n_terms = 1").select("id", "leaf", "score")
    several = [a for a in alternatives if len(a.terms) > 1]
    if several:
        parts = scored.filter("n_terms > 1")
        if any(a.slop for a in several):
            near = phrase_matches(index, terms, wanted)
            rows = rows.unionByName(
                parts.filter("slop > 0").join(near, ["leaf", "field", "id"], "left_semi")
                .select("id", "leaf", "score")
            )
        if any(not a.slop for a in several):
            whole = (
                parts.filter("slop = 0").groupBy("id", "leaf", "field", "n_terms")
                .agg(F.sum("score").alias("score"), F.max("ord").alias("last"),
                     F.count(F.lit(1)).alias("found"))
                .filter("found = n_terms").select("id", "leaf", "score")
            )
            rows = rows.unionByName(whole)
    return rows.groupBy("id").agg(*[
        F.sum(F.when(F.col("leaf") == n, F.col("score"))).alias(f"s{n}") for n in range(n_leaves)
    ])


def scope_terms(keywords: Mapping[str, Sequence[str]]) -> Expr:
    """Keyword entries per scope, each entry's words all required."""
    entries = [
        AllOf(tuple(Word(w, scope) for w in text.split()))
        for scope, texts in keywords.items() for text in texts if text.strip()
    ]
    return multi_keywords(entries)
