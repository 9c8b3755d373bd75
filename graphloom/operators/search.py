"""Ranked full-text search over named objects: BM25 over name, kind and content with boosts, ANDed terms, prefixes, exact names first."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The boost of each field, BM25's parameters, and question words that say nothing.
BOOSTS = {"name": 10.0, "kind": 4.0, "content": 1.0}
K1, B = 1.2, 0.75
LIMIT = 50
STOPWORDS = frozenset(
    """a an the is are was were am be been being do does did doing what who whom whose which how why where when and or but to of in on for with at by from
    about into than then this that these those it its their they them he she we you i my your our can could would should will shall have has had not no if as
    there here any some""".split()
)


def query_terms(query: str) -> list[str]:
    """Lower-case words; a trailing * makes a prefix."""
    return [t for t in re.findall(r"[^\W_]+\*?", query.lower())]


def question_terms(question: str) -> list[str]:
    """The words of a question of at least two letters, without stopwords, in order and once each."""
    return list(dict.fromkeys(t for t in re.findall(r"[^\W_]+", question.lower()) if len(t) > 1 and t not in STOPWORDS))


def indexed_text(props: Column) -> Column:
    """The text of an object's properties: excerpt, symbols and ocr_text where they are not empty, joined by blanks."""
    some = lambda k: F.nullif(F.get_json_object(props[k], "$"), F.lit(""))
    return F.concat_ws(" ", some("excerpt"), some("symbols"), some("ocr_text"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search(objects: DataFrame, query: str, limit: int | None = LIMIT, any_term: bool = False) -> DataFrame:
    """(id, name, kind, score): the best matches of objects (id, name, kind, content), full-name equality first, ties by id.

    Every term must match in some field (one of them with any_term). A query without terms finds nothing. One pass over the objects computes term
    frequencies and, in the same aggregation, document frequencies and mean lengths; only matching rows are scored.
    """
    terms = query_terms(query)
    spark = objects.sparkSession
    if not terms:
        return spark.createDataFrame([], "id string, name string, kind string, score double")
    fields = list(BOOSTS)
    tokens = objects.select("id", "name", "kind", *[_tokens(F.col(f)).alias(f"t_{f}") for f in fields])
    hit = lambda f, t: F.size(F.filter(F.col(f"t_{f}"), lambda w: w.startswith(t[:-1]) if t.endswith("*") else w == t))
    cols = {(f, i): hit(f, t).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)}
    tf = tokens.select("id", "name", "kind", *[F.size(f"t_{f}").alias(f"len_{f}") for f in fields], *cols.values())
    stats = tf.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields], *[F.sum((F.col(f"tf_{f}_{i}") > 0).cast("double")).alias(f"df_{f}_{i}") for f, i in cols])
    matches = [reduce(lambda a, b: a | b, [F.col(f"tf_{f}_{i}") > 0 for f in fields]) for i in range(len(terms))]
    wanted = reduce((lambda a, b: a | b) if any_term else (lambda a, b: a & b), matches)
    return _ranked(tf.where(wanted), stats, len(terms), query, limit)


def inverted(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (term, field, id, tf), lengths (id, name, kind, len_name, len_kind, len_content)): write them once, sorted by term, for many queries.

    A query then reads the postings of its terms alone, which files sorted by term prune to, and the lengths of the objects that match.
    """
    fields = list(BOOSTS)
    tokens = objects.select("id", "name", "kind", *[_tokens(F.col(f)).alias(f"t_{f}") for f in fields])
    posted = [tokens.select(F.explode(f"t_{f}").alias("term"), F.lit(f).alias("field"), "id") for f in fields]
    postings = reduce(DataFrame.unionByName, posted).groupBy("term", "field", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return postings, tokens.select("id", "name", "kind", *[F.size(f"t_{f}").alias(f"len_{f}") for f in fields])


def search_inverted(postings: DataFrame, lengths: DataFrame, query: str, limit: int | None = LIMIT, any_term: bool = False) -> DataFrame:
    """What search gives, from inverted."""
    terms, fields = query_terms(query), list(BOOSTS)
    if not terms:
        return postings.sparkSession.createDataFrame([], "id string, name string, kind string, score double")
    of = lambda t: F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t
    wanted = postings.where(reduce(lambda a, b: a | b, [of(t) for t in terms]))
    tf = wanted.groupBy("id").agg(*[F.coalesce(F.sum(F.when((F.col("field") == f) & of(t), F.col("tf"))), F.lit(0)).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)])
    df = tf.agg(*[F.coalesce(F.sum((F.col(f"tf_{f}_{i}") > 0).cast("double")), F.lit(0.0)).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))])
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields]).crossJoin(df)  # one row each
    matches = [reduce(lambda a, b: a | b, [F.col(f"tf_{f}_{i}") > 0 for f in fields]) for i in range(len(terms))]
    matched = tf.where(reduce((lambda a, b: a | b) if any_term else (lambda a, b: a & b), matches)).join(lengths, "id")
    return _ranked(matched, stats, len(terms), query, limit)


def _ranked(tf: DataFrame, stats: DataFrame, n_terms: int, query: str, limit: int | None) -> DataFrame:
    score = F.lit(0.0)
    for f in BOOSTS:
        for i in range(n_terms):
            df, n, x = F.col(f"df_{f}_{i}"), F.col("n"), F.col(f"tf_{f}_{i}")
            norm = K1 * (1 - B + B * F.col(f"len_{f}") / F.when(F.col(f"avg_{f}") > 0, F.col(f"avg_{f}")).otherwise(1.0))
            score = score + BOOSTS[f] * F.log(1 + (n - df + 0.5) / (df + 0.5)) * x * (K1 + 1) / (x + norm)
    scored = tf.crossJoin(F.broadcast(stats)).select("id", "name", "kind", F.round(score, 6).alias("score"))  # stats is one row
    ranked = scored.orderBy(F.desc((F.lower(F.col("name")) == query.lower().strip()).cast("int")), F.desc("score"), "id")
    return ranked.limit(limit) if limit else ranked


def ask(objects: DataFrame, question: str, limit: int = LIMIT) -> DataFrame:
    """The first of these that finds something: all keywords of the question, any of them, the question as a query."""
    terms = question_terms(question)
    for attempt in ([(" ".join(terms), False)] if terms else []) + ([(" ".join(terms), True)] if len(terms) > 1 else []):
        found = search(objects, attempt[0], limit, attempt[1])
        if not found.isEmpty():
            return found
    return search(objects, question, limit)


def phrase_search(objects: DataFrame, phrase: str, limit: int = LIMIT) -> DataFrame:
    """Objects with the words of a phrase side by side in one field, ranked like their ANDed terms."""
    words = [w.rstrip("*") for w in query_terms(phrase)]
    text = lambda f: F.concat(F.lit(" "), F.array_join(_tokens(F.col(f)), " "), F.lit(" "))
    there = reduce(lambda a, b: a | b, [text(f).contains(f" {' '.join(words)} ") for f in BOOSTS])
    return search(objects, " ".join(words), None).join(objects.where(there).select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(limit)
