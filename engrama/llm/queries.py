"""The ten operators with production parameters, as the contract's queries, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, htmlextract, linededup, mixing, ogg, packing, quality, simhash, toxicity, urlfilter
from .common import read_table

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
TARGETS = {"source": 0.8, "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, "*": 0.02}, "topic": 0.9}
RATE, ROUNDS, SEED = 0.8, 12, 7
TOXIC = 0.7


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages"), RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = linededup.keep_bitmaps(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    dropped = F.coalesce(F.aggregate(F.map_values("__kept"), F.lit(0).cast("long"), lambda a, w: a + 64 - F.bit_count(w)), F.lit(0).cast("long"))
    kept = F.when(F.col("__kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(linededup.kept_lines(), "\n"))
    return marked.select("doc_id", n.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.with_verdict(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "__quality.*")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract_pages(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_probability(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), TARGETS, RATE, rounds=ROUNDS, seed=SEED)
    return mixed.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__words").alias("tokens"), F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = dac.read(dac.write(read_table(spark, sf_dir, "documents")))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ogg.read_texts(ogg.store_texts(read_table(spark, sf_dir, "documents")))
    tail = F.crc32(F.expr("substring(payload, -16, 16)"))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_url_filter, op3_toxicity, op4_line_dedup, op5_quality, op6_html, op7_mixing, op8_token_files, op9_simhash, op10_ogg)}


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(first <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def mixing_sql(targets=TARGETS, rate: float = RATE, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The raking as one chain of CTEs."""
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in mixing.TOPICS)
    steps = [
        f"docs AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE {topics} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '{mixing.WORDS}')) AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))",
        "cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM docs GROUP BY ALL)",
        f"w0 AS (SELECT *, sum(tokens) OVER ()::DOUBLE AS everything, tokens / sum(tokens) OVER () AS w, {', '.join(f'sum(tokens) OVER (PARTITION BY {d})::DOUBLE AS tokens_{d}' for d in targets)} FROM cells)",
    ]
    for d, target in targets.items():
        share = f"pow(tokens_{d}, {target})" if not isinstance(target, dict) else "CASE " + " ".join(f"WHEN {d} = '{v}' THEN {x}" for v, x in target.items() if v != "*") + f" ELSE {target.get('*', 0.0)} END"
        steps.append(f"raw_{d} AS (SELECT DISTINCT {d}, CASE WHEN tokens_{d} > 0 THEN {share}::DOUBLE ELSE 0 END AS share FROM w0)")
        steps.append(f"target_{d} AS (SELECT {d}, share / sum(share) OVER () AS share_{d} FROM raw_{d})")
    steps.append("r0 AS (SELECT * FROM w0 " + " ".join(f"JOIN target_{d} USING ({d})" for d in targets) + ")")
    n = 0
    for _ in range(rounds):
        for d in targets:
            steps.append(f"r{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * share_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM r{n})")
            n += 1
        steps.append(f"r{n + 1} AS (SELECT * REPLACE (least(w, tokens / ({rate} * everything)) AS w) FROM r{n})")
        n += 1
    steps.append(f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, w * {rate} * everything / tokens) ELSE 0 END AS probability FROM r{n})")
    u = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / {2**52}.0::DOUBLE"
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(probability, 6) AS probability, ({u}) < probability AS sampled FROM docs JOIN p USING (source, lang, topic)"


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": LINES_SQL, "op7_mixing": mixing_sql()}
