import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.__main__ import parser
from engrama.functions import text as tx
from engrama.functions import vectors as vx
from engrama.functions.embedding import embed, features_of, hash_embed
from engrama.functions.entities import entities_of, extract_entities
from engrama.functions.time import stamp_to_ms


def test_tokenize(spark):
    texts = ["Hello, World-wide 2nd", "", None, "É_à x", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.tokenize(F.col("t"))).collect()]
    assert got == [tx.tokens_of(t) for t in texts] == [["hello", "world", "wide", "2nd"], [], [], ["é", "à", "x"], ["a", "b"]]


def test_chunks(spark):
    df = spark.createDataFrame([("x" * 1500,), ("",), ("y",)], "t string")
    got = [r[0] for r in df.select(tx.chunks(F.col("t"), 800, 120)).collect()]
    assert list(map(len, got[0])) == [800, 800, 140] and got[1] == [] and got[2] == ["y"]
    with pytest.raises(ValueError):
        tx.chunks(F.col("t"), 10, 10)


def test_vectors(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-1, 1) for _ in range(16)], [rng.uniform(-1, 1) for _ in range(16)]) for _ in range(20)] + [([0.0] * 4, [1.0] * 4), ([2.0, 2.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    q = df.withColumn("qa", vx.sq8_encode(F.col("a"))).withColumn("qb", vx.sq8_encode(F.col("b")))
    out = q.select("a", "b", vx.dot(F.col("a"), F.col("b")).alias("dot"), vx.normalize(F.col("a")).alias("n"), vx.sq8_decode(F.col("qa")).alias("da"), vx.sq8_decode(F.col("qb")).alias("db"), vx.sq8_dot(F.col("a"), F.col("qb")).alias("asym"), vx.sq8_dot_between(F.col("qa"), F.col("qb")).alias("sym"), "qa").collect()
    for r in out:
        a, b = np.array(r["a"]), np.array(r["b"])
        assert r["dot"] == pytest.approx(float(a @ b))
        norm = np.linalg.norm(a)
        assert np.allclose(r["n"], a / norm if norm else a)
        assert np.abs(np.array(r["da"]) - a).max() <= r["qa"]["delta"] / 2 + 1e-12
        assert all(0 <= c <= 255 for c in r["qa"]["codes"])
        assert r["asym"] == pytest.approx(float(a @ np.array(r["db"])), abs=1e-9)
        assert r["sym"] == pytest.approx(float(np.array(r["da"]) @ np.array(r["db"])), abs=1e-9)


def test_sq8_of_a_unit_vector(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=128)
    v /= np.linalg.norm(v)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    d = df.select(vx.sq8_decode(vx.sq8_encode(F.col("v"))).alias("d")).first()["d"]
    assert np.abs(np.array(d) - v).max() < 2 / 255


@pytest.mark.parametrize(
    ("text", "tags", "want"),
    [
        ("Dana Whitfield filed INC-90312 against the billing API for Project Phoenix", ["oncall"], ["oncall", "dana whitfield", "inc-90312", "api", "project phoenix"]),
        ("Deploys are failing again", [], []),
        ("Then Dana left. Bob stayed", [], ["dana"]),
        ("we saw Dana, Bob there", [], ["dana bob"]),
        ("Project E1234 and E1234 Project", [], ["project e1234", "e1234", "project"]),
        ("ask THE team", [], ["the"]),
        ("in Q3 it fell", [], ["q3"]),
        ("the É line", [], ["é"]),
        ("", ["a", "Tag", "tag"], ["tag"]),
        (None, None, []),
    ],
)
def test_entities(text, tags, want):
    assert entities_of(text, tags) == want


def test_entities_are_capped(spark):
    many = [f"tag{i}" for i in range(40)]
    assert entities_of("x", many) == many[:16]
    df = spark.createDataFrame([("we met Dana", ["x1"]), (None, None)], "t string, g array<string>")
    assert [r[0] for r in df.select(extract_entities("t", "g")).collect()] == [["x1", "dana"], []]


def test_stamps(spark):
    df = spark.createDataFrame([("Dec 15, 2025, 08:41:23",), ("Dec 5, 2025, 08:41:23",), ("2025-12-15",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(stamp_to_ms(F.col("t"))).collect()]
    assert got[0] == 1_765_788_083_000 and got[2:] == [None, None, None]


def test_command_line():
    args = parser().parse_args(["serve", "--root", "/x", "--key", "abcdefgh:ns", "--port", "1"])
    assert (args.command, args.root, args.key, args.port) == ("serve", "/x", ["abcdefgh:ns"], 1)
    with pytest.raises(SystemExit):
        parser().parse_args(["demo"])


def test_embedding(spark):
    f = dict(features_of("deploy now"))
    assert f["deploy"] == 1.0 and f["#dep"] == 0.4 and f["deploy_now"] == 0.7 and "#now" not in f
    v = embed("the deploy failed")
    assert math.isclose(float(v @ v), 1.0) and not embed("").any() and not embed(None).any()
    assert float(v @ embed("deploys failed")) > float(v @ embed("quarterly budget review"))
    df = spark.createDataFrame([("the deploy failed",)], "t string")
    assert np.allclose(df.select(hash_embed(F.col("t"))).first()[0], v)


def test_entities_in_the_engine_as_outside(spark):
    """Random words with marks, and runs of thousands of names."""
    rng = random.Random(12)
    parts = ["Dana", "Whitfield", "the", "The", "INC-90312", "API", "Q3", "É", "Éa", "x1", "deploy.", "Done!", "(Bob)", "E1234", "--", "...", "a", "THE", "Ünder", "ß9x", "New", "YORK", "mid-", "It"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(300)]
    texts += [None, "", "  ", "Dana " * 30_000, "Dana\x0bBob Eve\x85Zoe", "!" * 20_000 + " Dana Bob", "\nStart Here now. Then go"]
    df = spark.createDataFrame([(t, ["Tag", "y"] if i % 3 else None) for i, t in enumerate(texts)], "t string, g array<string>")
    for r in df.select("t", "g", extract_entities(F.col("t"), F.col("g")).alias("e")).collect():
        assert r["e"] == entities_of(r["t"], r["g"]), r["t"]
