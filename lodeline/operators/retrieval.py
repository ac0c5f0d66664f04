"""Hybrid retrieval: BM25, rank fusion, boosts, a similarity guard; nearest vectors are in ``vectors``.

Queries are a bounded table; documents are not. Postings are cut to the words of
the queries before anything is shuffled, and ranks are taken per query with a
limit, so that each task keeps no more than the best rows of each query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodeline.functions.rules import small
from lodeline.functions.text import WORD, tokens
from lodeline.operators import keywords
from lodeline.operators.keywords import Times, with_hits
from lodeline.session import checkpointed

#: Constants of Okapi BM25 and of rank fusion.
K1, B, EPSILON = 1.5, 0.75, 0.25
DENSE, SPARSE, RANK0, BOOST = 1.2, 1.0, 60, 0.05
DECIMALS = 6


@dataclass
class Index:
    """The tokens of documents: held (category, id, terms) has them in order."""

    held: DataFrame

    @property
    def stats(self) -> DataFrame:
        """(category, id, dl): how many tokens each document has."""
        return self.held.select("category", "id", F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("dl"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(category, term, id, tf) for some terms (term) alone: others are left out before anything is shuffled."""
        rows = self.held.select("category", "id", F.explode("terms").alias("term")).join(terms, "term", "left_semi")
        return rows.groupBy("category", "term", "id").agg(F.count(F.lit(1)).alias("tf"))


def index(docs: DataFrame, id_col: str, text_col: str, category: str, word: str = WORD, least: int = 2) -> Index:
    """The inverted index of a table of documents, by category."""
    return Index(docs.select(F.col(category).alias("category"), F.col(id_col).alias("id"), tokens(F.col(text_col), least, word).alias("terms")))


def term_frequencies(found: Index) -> DataFrame:
    """(category, term, df): in how many documents of its category each term is; each task adds up its own documents first."""
    return found.held.select("category", F.explode(F.array_distinct("terms")).alias("term")).groupBy("category", "term").agg(F.count(F.lit(1)).alias("df"))


def collection(found: Index) -> DataFrame:
    """(category, n, avgdl) of each category."""
    return found.stats.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def inverse_frequencies(found: Index) -> DataFrame:
    """(category, term, idf); a negative value is replaced by a share of the category's mean over its vocabulary.

    The vocabulary's counts are written once; the two tables with a row for each category are broadcast.
    """
    raw = checkpointed(term_frequencies(found)).join(F.broadcast(collection(found)), "category").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("category").agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean), "category").select("category", "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def ranked(df: DataFrame, group: str | list[str], score: str, tie: str, most: int, as_: str = "rank") -> DataFrame:
    """The ``most`` best rows of each group with their rank from 0; equal scores in the order of ``tie``."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    return df.withColumn(as_, F.row_number().over(w) - 1).where(F.col(as_) < most)


#: Terms by queries of a category, at most, whose weights a task holds; more are joined. Documents scored at once.
WEIGHTS, DOCUMENTS = 1 << 23, 1024


@dataclass(frozen=True)
class Asked:
    """What a category's documents are asked: the weight of each term in each query, and the category's mean length."""

    queries: list
    terms: dict[str, int]
    weights: np.ndarray
    avgdl: float

    def scores(self, documents: list[list[str] | None]) -> np.ndarray:
        """The score of each document for each query."""
        out = np.zeros((len(documents), len(self.queries)))
        for i, held in enumerate(documents):
            counts = Counter(map(self.terms.get, held or ()))
            counts.pop(None, None)
            if counts:
                at, tf = np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
                out[i] = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(held) / self.avgdl))) @ self.weights[at]
        return out


class Top:
    """Of scores that come document by document those that may be among the ``most`` best of their query, equals after rounding included."""

    def __init__(self, queries: int, most: int):
        self.best = np.zeros((queries, most))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list = []
        self.kept = 0

    def floor(self) -> np.ndarray:
        return self.best.min(axis=1) - 10.0**-DECIMALS

    def see(self, scores: np.ndarray, ids: list) -> None:
        most = self.best.shape[1]
        self.best = -np.partition(-np.concatenate((self.best, scores.T), axis=1), most - 1, axis=1)[:, :most]
        at, query = np.nonzero((scores > 0) & (scores >= self.floor()))
        self.held.append((query, at + len(self.ids), scores[at, query]))
        self.ids += ids
        if len(self.ids) >= 2 * self.kept + 20_000:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray]:
        query, at, score = map(np.concatenate, zip(*self.held, strict=True))
        ok = score >= self.floor()[query]
        used, at = np.unique(at[ok], return_inverse=True)
        self.ids, self.held, self.kept = [self.ids[i] for i in used.tolist()], [(query[ok], at, score[ok])], len(used)
        return self.held[0]


def _best_scored(found: Index, asked: DataFrame, idf: DataFrame, most: int) -> DataFrame | None:
    """(query_id, category, id, score) of what may be among the best, from one pass over the documents; None if the weights are more than a task is to hold.

    ``asked`` is (query_id, category, term, times), a null category standing for
    every one, ``idf`` (category, term, idf) of the terms asked: both grow with the queries.
    """
    if asked.count() > WEIGHTS:
        return None
    lines, lengths = asked.collect(), {r.category: r.avgdl for r in collection(found).collect()}
    known = {(r.category, r.term): r.idf for r in idf.collect()}
    shared: dict = {}
    for category, avgdl in lengths.items():
        own = [r for r in lines if r.category in (None, category) and (category, r.term) in known]
        queries, terms = ({v: i for i, v in enumerate(dict.fromkeys(values))} for values in ((r.query_id for r in own), (r.term for r in own)))
        if len(queries) * len(terms) > WEIGHTS:
            return None
        weights = np.zeros((len(terms), len(queries)))
        for r in own:
            weights[terms[r.term], queries[r.query_id]] = known[category, r.term] * r.times
        if own:
            shared[category] = Asked(list(queries), terms, weights, avgdl)
    sent = found.held.sparkSession.sparkContext.broadcast(shared)
    kinds = dict(asked.dtypes)["query_id"], dict(found.held.dtypes)["category"], dict(found.held.dtypes)["id"]
    query_kind = to_arrow_type(asked.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict = {}
        types: list = []
        for batch in batches:
            types = [f.type for f in batch.schema]
            for low in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(low, DOCUMENTS)
                rows: dict = {}
                for i, category in enumerate(part.column(0).to_pylist()):
                    if category in sent.value:
                        rows.setdefault(category, []).append(i)
                for category, at in rows.items():
                    own = part.take(pa.array(at))
                    top = tops.setdefault(category, Top(len(sent.value[category].queries), most))
                    top.see(sent.value[category].scores(own.column(2).to_pylist()), own.column(1).to_pylist())
        for category, top in tops.items():
            query, at, score = top.prune()
            names = sent.value[category].queries
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query.tolist()], query_kind), pa.array([category] * len(query), types[0]), pa.array([top.ids[i] for i in at.tolist()], types[1]), pa.array(score)], ["query_id", "category", "id", "score"])

    return found.held.where("category IS NOT NULL").select("category", "id", "terms").mapInArrow(run, f"query_id {kinds[0]}, category {kinds[1]}, id {kinds[2]}, score double")


def bm25(found: Index, queries: DataFrame, query_id: str, query_text: str, most: int = 15, word: str = WORD, least: int = 2, category: str | None = None) -> DataFrame:
    """(query_id, category, id, score, rank): the best documents of each category for each query, those that score above 0.

    With ``category``, a column of the queries, the documents of a query's own
    category alone are scored. A task scores its documents for all queries and
    hands on those that may be among the best, so that no posting is shuffled.
    """
    mine = (F.col(category) if category else F.lit(None)).cast(dict(found.held.dtypes)["category"]).alias("category")
    asked = queries.where(F.col(category).isNotNull() if category else F.lit(True)).select(F.col(query_id).alias("query_id"), mine, F.explode(tokens(F.col(query_text), least, word)).alias("term")).groupBy("query_id", "category", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = small(checkpointed(asked))
    terms = small(asked.select("term").distinct())
    idf = checkpointed(inverse_frequencies(found).join(terms, "term", "left_semi"))
    best = _best_scored(found, asked, idf, most)
    if best is not None:
        return ranked(best.withColumn("score", F.round("score", DECIMALS)), ["query_id", "category"], "score", "id", most).where("score > 0")
    weighed = (
        found.postings(terms)
        .join(idf, ["category", "term"])
        .join(found.stats, ["category", "id"])
        .join(F.broadcast(collection(found).select("category", "avgdl")), "category")
    )
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = weighed.select("category", "id", "term", part.alias("part")).join(asked.withColumnRenamed("category", "__own"), "term").where("__own IS NULL OR __own = category").groupBy("query_id", "category", "id").agg(F.round(F.sum(F.col("part") * F.col("times")), DECIMALS).alias("score"))
    return ranked(scored, ["query_id", "category"], "score", "id", most).where("score > 0")


def dot(x: Column, y: Column) -> Column:
    """The sum of the products of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of numbers, in double precision; null if either is null or zero."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    a, b = double(a), double(b)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, id, score): reciprocal ranks of both lists, from 0, weighed and added; an id in one list alone has its part."""
    part = lambda df, weight: df.select("query_id", "id", (F.lit(weight) / (RANK0 + F.col("rank"))).alias("part"))
    return part(dense, DENSE).unionByName(part(sparse, SPARSE)).groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def _titles_counted(titles: DataFrame, asked: DataFrame, least: int) -> DataFrame | None:
    """(query_id, id, n) of title_hits from one pass over the titles (id, category, held); None if the times asked are more than a task is to hold."""
    known = asked.where("category IS NOT NULL")
    # the terms by the queries of every category, before anything is collected
    sizes = known.groupBy("category").agg((F.count_distinct("term") * F.count_distinct(F.struct("query_id"))).alias("cells"))
    if (sizes.agg(F.sum("cells")).first()[0] or 0) > keywords.TIMES:
        return None
    lines: dict = {}
    for r in known.collect():
        lines.setdefault(r.category, []).append((r.query_id, r.term, r.times))
    sent = titles.sparkSession.sparkContext.broadcast({category: Times.of(own) for category, own in lines.items()})
    kinds = dict(asked.dtypes)["query_id"], dict(titles.dtypes)["id"]
    query_kind = to_arrow_type(asked.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict = {}
            for i, category in enumerate(batch.column(0).to_pylist()):
                if category in sent.value:
                    rows.setdefault(category, []).append(i)
            for category, at in rows.items():
                wanted = sent.value[category]
                for low in range(0, len(at), wanted.texts):
                    part = batch.take(pa.array(at[low : low + wanted.texts]))
                    n = wanted.sums((1, part.column(2).to_pylist()))
                    text, query = np.nonzero(n >= max(least, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(wanted.queries, query_kind).take(pa.array(query)), part.column(1).take(pa.array(text)), pa.array(n[text, query].astype(np.int64))], ["query_id", "id", "n"])

    return titles.select("category", "id", "held").mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, n bigint")


def title_hits(docs: DataFrame, queries: DataFrame, id_col: str, title: str, query_id: str, query_text: str, least: int = 2, word: str = WORD, category: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, id, n): documents whose title holds so many of a query's terms, repeated terms counted each time.

    With ``category``, the columns of documents and of queries that must agree,
    documents meet the queries of their own alone. The terms that a title holds
    anywhere in it, parts of words included, are found in one pass over the title,
    and a task counts them for all queries at once.
    """
    own = lambda c: (F.col(c) if c else F.lit(0)).alias("category")
    mine, wanted = category or (None, None)
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text), 2, word)).alias("term"), own(wanted)).groupBy("query_id", "category", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = checkpointed(asked)
    titles = with_hits(docs.select(F.col(id_col).alias("id"), F.lower(title).alias("title"), own(mine)), "title", asked.select("term"), "held").select("id", "category", "held")
    counted = _titles_counted(titles, asked, least)
    return _titles_joined(checkpointed(titles.where(F.size("held") > 0)), asked, least) if counted is None else counted


def _titles_joined(titles: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """As _titles_counted, for more queries than a task is to hold.

    If a query's terms in the order of how many titles hold them, the rarest
    first, are left out one by one until fewer than ``least`` repeats are left, a
    hit holds one of those: only titles that do are counted.
    """
    postings = titles.select("id", "category", F.explode("held").alias("term"))
    known = asked.join(postings.groupBy("category", "term").agg(F.count(F.lit(1)).alias("df")), ["category", "term"])
    ordered = known.groupBy("query_id", "category").agg(F.sort_array(F.collect_list(F.struct("df", "term", "times"))).alias("terms")).where(F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, t: n + t["times"]) >= least)
    # a term is a candidate while it and the commoner ones after it have ``least`` repeats or more
    after = lambda i: F.aggregate(F.slice("terms", i + 1, F.size("terms")), F.lit(0).cast("bigint"), lambda n, t: n + t["times"])
    firsts = ordered.select("query_id", "category", "terms", F.explode(F.transform(F.filter("terms", lambda t, i: after(i) >= least), lambda t: t["term"])).alias("term"))
    pairs = firsts.select("query_id", "category", "term").join(postings, ["category", "term"]).select("query_id", "category", "id").distinct()
    n = F.aggregate(F.filter("terms", lambda t: F.array_contains("held", t["term"])), F.lit(0).cast("bigint"), lambda n, t: n + t["times"])
    met = pairs.join(ordered.select("query_id", "terms"), "query_id").join(titles.select("id", "category", "held"), ["id", "category"])
    return met.select("query_id", "id", n.alias("n")).where(F.col("n") >= least)


def priority_hits(queries: DataFrame, priorities: DataFrame, docs: DataFrame, id_col: str, query_id: str, query_text: str) -> DataFrame:
    """(query_id, id): targets of the keywords (keyword, target) that a query holds, once for each, if they are documents at all."""
    held = with_hits(queries.select(F.col(query_id).alias("query_id"), F.col(query_text).alias("text")), "text", priorities.select("keyword"), "held")
    met = held.select("query_id", F.explode("held").alias("keyword")).join(priorities, "keyword").select("query_id", F.col("target").alias("id"))
    return met.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi").select("query_id", "id")


def boosted(fused: DataFrame, boosts: DataFrame) -> DataFrame:
    """(query_id, id, score, n_boosts): n boosts double a score n times; an id that isn't among the fused ones starts from BOOST, doubled once less."""
    n = boosts.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n_boosts"))
    both = fused.join(n, ["query_id", "id"], "full_outer")
    times = F.coalesce("n_boosts", F.lit(0))
    score = F.when(F.col("score").isNotNull(), F.col("score") * F.pow(F.lit(2.0), times)).otherwise(BOOST * F.pow(F.lit(2.0), times - 1))
    return both.select("query_id", "id", F.round(score, 9).alias("score"), times.cast("bigint").alias("n_boosts"))


def guarded(hits: DataFrame, dense: DataFrame, least: float = 0.10) -> DataFrame:
    """Ranked hits (query_id, id, score, n_boosts, rank) without those of queries whose best hit is too far.

    If the best hit is boosted, or isn't among the dense ones, all stay; else its
    similarity has to reach ``least``.
    """
    top = hits.where("rank = 0").join(dense.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    ok = top.where((F.col("n_boosts") > 0) | F.col("similarity").isNull() | (F.col("similarity") >= least)).select("query_id")
    return hits.join(ok, "query_id", "left_semi")


def hybrid(dense: DataFrame, sparse: DataFrame, boosts: DataFrame, most: int = 3, least: float = 0.10) -> DataFrame:
    """Fusion, boosts, the best ``most`` of each query and the guard, in this order."""
    # a few rows a query, each read more than once
    dense = checkpointed(dense)
    fused = checkpointed(ranked(boosted(fuse(dense, sparse), boosts), "query_id", "score", "id", most))
    return guarded(fused, dense, least)
