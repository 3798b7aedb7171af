"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked, one marginal after
the other, until each marginal meets its target; a cell is never asked for more tokens than it has. A document is
then sampled with its cell's calibrated probability, by a hash of its key: the same documents at every run.

The cell table has a row per combination of categories, not per document. Up to ``few`` rows of it (counted first) are raked in one task;
a larger table stays distributed: each step sums weights by category, with map-side parts, and joins the sums back, and each round is written
to the shared folder. Both give the same weights. The table is joined to the documents by broadcast where Spark finds it under the session's
threshold, else by a shuffle that AQE may split. A cap on what a cell has can leave marginals unmet: ``marginals`` tells by how much.

Defined results: null categories are the category ``(none)``; empty or null texts weigh nothing and get their cell's
probability (0 in a cell without tokens); rows of one key share their fate; an empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, unused

NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"

#: (topic, pattern): the first that fits, else ``prose``. A stand-in for a topic column; give ``topic`` to use another.
TOPICS = (("markup", r"[#*$%&]{3}| \| "), ("legal", r"(?i)licen[cs]ed? |copyright"), ("records", r"[0-9]{4,}"))


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def shares(dimension: str, target: Mapping[str, float] | float) -> Column:
    """Unscaled target share of a category with ``__tokens`` tokens: a given one ('*': any other), or a power of its tokens."""
    if isinstance(target, Mapping):
        out = F.lit(float(target.get("*", 0.0)))
        for value, share in target.items():
            out = F.when(F.col(dimension) == value, float(share)).otherwise(out)
        return out
    return F.pow(F.col("__tokens").cast("double"), F.lit(float(target)))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float, rounds: int = 12, few: int = 100_000) -> DataFrame:
    """``cells`` (categories and ``tokens``) with ``weight`` (they sum to about 1) and ``probability``.

    ``targets``: per dimension, shares by category or the power of the tokens that shares go with.
    ``rate``: share of all tokens to sample. Categories without tokens take no share.
    """
    small = cells.limit(few + 1).count() <= few
    whole = (_raked_in_one if small else _raked_in_parts)(cells, targets, rate, rounds)
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(float(rate)) * F.col("__all") / F.col("tokens"))).otherwise(0.0)
    return whole.withColumn("probability", probability).select(*cells.columns, "weight", "probability")


def _most(rate: float) -> Column:
    """The weight at which a cell gives all it has."""
    return F.coalesce(F.try_divide(F.col("tokens"), F.lit(float(rate)) * F.col("__all")), F.lit(0.0))


def _raked_in_one(cells: DataFrame, targets: Mapping, rate: float, rounds: int) -> DataFrame:
    total = F.sum("tokens").over(W.partitionBy())
    whole = cells.repartition(1).withColumn("__all", total.cast("double")).withColumn("weight", F.coalesce(F.try_divide("tokens", "__all"), F.lit(0.0)))
    for d, target in targets.items():
        whole = whole.withColumn("__tokens", F.sum("tokens").over(W.partitionBy(d)))
        share = F.when(F.col("__tokens") > 0, shares(d, target)).otherwise(0.0)
        whole = whole.withColumn(f"__share_{d}", share).withColumn("__first", F.row_number().over(W.partitionBy(d).orderBy(*targets)))
        asked = F.sum(F.when(F.col("__first") == 1, F.col(f"__share_{d}")).otherwise(0.0)).over(W.partitionBy())
        whole = whole.withColumn(f"__share_{d}", F.coalesce(F.try_divide(F.col(f"__share_{d}"), asked), F.lit(0.0)))
    for _ in range(rounds):
        for d in targets:
            now = F.sum("weight").over(W.partitionBy(d))
            whole = whole.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"__share_{d}") / now).otherwise(0.0))
        whole = whole.withColumn("weight", F.least("weight", _most(rate)))
    return whole


def _beside(rows: DataFrame, by: str, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` (``__by`` and others) for their category."""
    return rows.join(found, rows[by].eqNullSafe(found["__by"])).drop("__by")


def target_shares(cells: DataFrame, d: str, target: Mapping[str, float] | float) -> DataFrame:
    """(__by, share) of the categories of one dimension; shares sum to 1."""
    sums = cells.groupBy(F.col(d).alias("__by")).agg(F.sum("tokens").alias("__tokens"))
    raw = sums.withColumn(d, F.col("__by")).select("__by", F.when(F.col("__tokens") > 0, shares(d, target)).otherwise(0.0).alias("raw"))
    return raw.select("__by", F.coalesce(F.try_divide("raw", raw.agg(F.sum("raw")).scalar()), F.lit(0.0)).alias("share"))


def _raked_in_parts(cells: DataFrame, targets: Mapping, rate: float, rounds: int) -> DataFrame:
    whole = cells.withColumn("__all", cells.agg(F.sum("tokens").cast("double")).scalar()).withColumn("weight", F.coalesce(F.try_divide("tokens", "__all"), F.lit(0.0)))
    for d, target in targets.items():
        whole = _beside(whole, d, target_shares(cells, d, target).withColumnRenamed("share", f"__share_{d}"))
    whole = materialize(whole, "rake")
    for _ in range(rounds):
        for d in targets:
            whole = _beside(whole, d, whole.groupBy(F.col(d).alias("__by")).agg(F.sum("weight").alias("__now")))
            moved = F.when(F.col("__now") > 0, F.col("weight") * F.col(f"__share_{d}") / F.col("__now")).otherwise(0.0)
            whole = whole.withColumn("weight", moved).drop("__now")
        whole = materialize(whole.withColumn("weight", F.least("weight", _most(rate))), "rake")
    return whole


def marginals(raked: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> DataFrame:
    """(dimension, value, target, weight): the share asked of each category and what the weights of ``raked`` give it."""
    out = None
    for d, target in targets.items():
        given = raked.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("weight"))
        asked = target_shares(raked, d, target)
        one = given.join(asked, given["value"].eqNullSafe(asked["__by"])).select(F.lit(d).alias("dimension"), "value", F.col("share").alias("target"), "weight")
        out = one if out is None else out.unionByName(one)
    return out


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) by the key and seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


#: What ``with_probability`` calls its columns.
NAMES = ("__source", "__lang", "__topic", "__words", "__probability", "__sampled")


def with_probability(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float, key: str = "doc_id", text: str = "text", topic: Column | None = None, rounds: int = 12, seed: int = 7, names: Sequence[str] = NAMES, few: int = 100_000) -> DataFrame:
    """``docs`` (all columns) with source, language, topic, number of words, probability and whether it is sampled, called ``names``."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"there are columns {sorted(clash)}; give other names")
    *by, words, probability, sampled = names
    marked = docs.withColumns({
        by[0]: F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        by[1]: F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        by[2]: topic if topic is not None else topic_of(text_or_empty(text)),
        words: F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long"),
    })
    cells = marked.groupBy(*by).agg(F.sum(words).alias("tokens"))
    places = dict(zip(("source", "lang", "topic"), by, strict=True))
    raked = materialize(rake(materialize(cells, "mix-cells"), {places[d]: t for d, t in targets.items()}, rate, rounds, few), "mix-weights")
    found = raked.select(*by, F.col("probability").alias(probability))
    return marked.join(found, by).withColumn(sampled, uniform(key, seed) < F.col(probability)).select(*docs.columns, *names)


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float, **options) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    names = unused(docs.columns, *NAMES)
    return with_probability(docs, targets, rate, names=names, **options).filter(f"`{names[-1]}`").select(*docs.columns)
