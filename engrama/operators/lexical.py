"""Lexical search: postings, corpus statistics and BM25.

Statistics cover the whole live corpus; a filter narrows only what is scored. ``bm25_topk`` scans the texts once,
keeps the asked terms of each row in the shared folder, and from these takes statistics and scores each row where it lies; ``bm25`` gives all scores, joining tokens with the queries' terms before they are counted;
``bm25_indexed`` reads the asked terms' postings from an index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..schema import BM25_B, BM25_K1
from ..sources.scratch import stored
from .knn import CONSTRAINTS, FILTERED_BY, blocks_of
from .ranking import top_k
from .termscan import Weights, best_rows_by_terms, term_statistics, with_terms


def postings(corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf)"""
    return corpus.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return corpus.select(key, F.size(tokenize(F.col(text))).cast("long").alias("dl"))


def doc_frequencies(corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return corpus.select(F.explode(F.array_distinct(tokenize(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: n, avgdl"""
    return corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokenize(F.col(text)))).alias("avgdl"))


def query_terms(requests: DataFrame) -> DataFrame:
    """(qid, term, times): repeated terms count as often as they stand."""
    return requests.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(requests: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text", keep=None) -> DataFrame:
    """(qid, id, score) of all rows that share a term with a query. ``keep`` filters scored rows: statistics stay global."""
    terms = query_terms(requests)
    wanted = terms.select("term").distinct()
    tokenised = corpus.select(key, tokenize(F.col(text)).alias("tokens"))
    hits = tokenised.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term")
    posted = hits.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    return _score(posted, corpus_stats(corpus, text), terms, key, keep)


def _score(posted: DataFrame, stats: DataFrame, terms: DataFrame, key: str, keep) -> DataFrame:
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    whole = stats.select(F.struct("n", "avgdl")).scalar()
    weighed = df.withColumn("s", whole).withColumn("idf", F.log((F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).select("term", "idf", "s.avgdl")
    scored = posted.join(weighed, "term").join(terms, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    found = scored.groupBy("qid", key).agg(F.sum(part).alias("score"))
    return found if keep is None else keep(found)  # after the sums: a row per request and record instead of one per term


def write_index(corpus: DataFrame, path: str, buckets: int = 256, key: str = "id", text: str = "text") -> None:
    """Postings with their documents' lengths, partitioned by a hash of the term and sorted by it, and the corpus statistics.

    A search reads the folders of its terms' hashes, and of these the row groups that can hold the term.
    """
    tokenised = corpus.select(key, tokenize(F.col(text)).alias("tokens"))
    posted = tokenised.select(key, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    # a term in a third of all documents is one key: its postings are dealt out by document too
    dealt = posted.withColumn("bucket", bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    corpus_stats(corpus, text).write.parquet(f"{path}/stats")


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bm25_indexed(requests: DataFrame, path: str, buckets: int = 256, key: str = "id", keep=None) -> DataFrame:
    """``bm25`` from what ``write_index`` wrote. The join on bucket and term prunes partitions by the queries' terms."""
    spark = requests.sparkSession
    terms = query_terms(requests)
    wanted = terms.select("term", bucket(F.col("term"), buckets).alias("bucket")).distinct()
    posted = spark.read.parquet(f"{path}/postings").join(wanted, ["bucket", "term"])
    return _score(posted, spark.read.parquet(f"{path}/stats"), terms, key, keep)


def term_weights(requests: list[dict], df: dict[str, int], n: int) -> list[tuple[int, str, float]]:
    """(place of the request, term, times the term stands in it by its rarity); terms that no row holds are left out."""
    out = []
    for i, r in enumerate(requests):
        times: dict[str, int] = {}
        for t in r["terms"]:
            times[t] = times.get(t, 0) + 1
        out += [(i, t, m * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1.0)) for t, m in times.items() if t in df]
    return out


def bm25_topk(requests: DataFrame, corpus: DataFrame, k: int, key: str = "id", text: str = "text", filtered: bool = False, now: int | None = None, where: Column | None = None, block: int = 4096) -> DataFrame:
    """(qid, id, score, rank). ``where``, ``filtered`` (the requests' own constraints) and ``now`` narrow the scored rows.

    ``requests`` are a stated set, taken in blocks; corpus rows are never shuffled.
    """
    asked = requests.select("qid", tokenize(F.col("query")).alias("terms"), *(CONSTRAINTS if filtered else ()))
    more = [(F.lit(True) if where is None else F.coalesce(where, F.lit(False))).alias("__scored"), *(map(F.col, FILTERED_BY) if filtered or now is not None else ())]
    out = None
    for part in blocks_of(asked, block):
        vocabulary = sorted({t for r in part for t in r["terms"]})
        found = stored(with_terms(corpus, key, vocabulary, text=F.col(text), more=more), "terms")
        df, n, total = term_statistics(found, vocabulary)
        weights = Weights([{c: v for c, v in r.items() if c != "terms"} for r in part], term_weights(part, df, n), vocabulary)
        one = best_rows_by_terms(found.filter("__scored"), weights, k, key, (BM25_K1, BM25_B, total / max(1, n)), filtered, now)
        out = one if out is None else out.unionByName(one)
    return top_k(out, "score", k, key=key)
