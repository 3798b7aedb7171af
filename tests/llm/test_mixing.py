import hashlib
import random

import duckdb
import pytest

from engrama.llm import mixing, queries

from .helpers import corpus, docs_of, with_odd_keys


def brute_rake(cells, targets, rate, rounds):
    total = sum(cells.values())
    w = {c: n / total for c, n in cells.items()}
    shares = []
    for i, target in enumerate(targets):
        sums = {}
        for c, n in cells.items():
            sums[c[i]] = sums.get(c[i], 0) + n
        raw = {k: (target.get(k, target.get("*", 0.0)) if isinstance(target, dict) else v**target) if v else 0.0 for k, v in sums.items()}
        shares.append({k: v / sum(raw.values()) for k, v in raw.items()})
    for _ in range(rounds):
        for i, share in enumerate(shares):
            sums = {}
            for c, x in w.items():
                sums[c[i]] = sums.get(c[i], 0) + x
            w = {c: x * share[c[i]] / sums[c[i]] if sums[c[i]] > 0 else 0.0 for c, x in w.items()}
        w = {c: min(x, cells[c] / (rate * total)) for c, x in w.items()}
    return {c: min(1.0, w[c] * rate * total / n) if n else 0.0 for c, n in cells.items()}, w, shares


def test_rake(spark):
    rng = random.Random(2)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.choice([0, 5, 100, 4000, 90_000]) for a in range(6) for b in range(4) for c in range(3) if rng.random() < 0.8}
    targets = [0.5, {"l0": 0.5, "l1": 0.3, "*": 0.1}, 0.8]
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    for rate, rounds in ((0.8, 6), (0.05, 30)):
        want, w, shares = brute_rake(cells, targets, rate, rounds)
        got = mixing.rake(rows, dict(zip(("source", "lang", "topic"), targets, strict=True)), rate, rounds).collect()
        assert len(got) == len(cells)
        for r in got:
            assert r["probability"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], abs=1e-9)


def test_marginals_are_met(spark):
    rng = random.Random(6)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randrange(1000, 90_000) for a in range(6) for b in range(4) for c in range(3)}
    targets = [0.5, {"l0": 0.5, "l1": 0.3, "*": 0.1}, 0.8]
    rows = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic string, tokens long")
    shares = brute_rake(cells, targets, 0.01, 1)[2]
    got = mixing.rake(rows, dict(zip(("source", "lang", "topic"), targets, strict=True)), 0.01, 12).collect()
    for name, share in zip(("source", "lang", "topic"), shares, strict=True):
        for k, s in share.items():
            assert sum(r["weight"] for r in got if r[name] == k) == pytest.approx(s, abs=1e-4)
    assert sum(r["probability"] * r["tokens"] for r in got) == pytest.approx(0.01 * sum(cells.values()), rel=1e-3)


def test_sampling_follows_probabilities(spark):
    docs = docs_of(spark, ["one two three four"] * 4000)
    out = mixing.with_probability(docs, {"lang": {"en": 0.7, "*": 0.1}}, 0.5).collect()
    by = {}
    for r in out:
        u = int(hashlib.md5(f"{r['doc_id']}:7".encode()).hexdigest()[:13], 16) / 2**52
        assert r["__sampled"] == (u < r["__probability"])
        by.setdefault(r["__lang"], []).append(r)
    assert set(by) == {"en", "de", "xx", mixing.NONE}
    assert by["en"][0]["__probability"] == 1.0 and by["de"][0]["__probability"] == pytest.approx(0.2)
    assert sum(r["__sampled"] for r in by["de"]) == pytest.approx(200, abs=50)


def test_odd_rows(spark):
    docs = with_odd_keys(spark, corpus(n=20))
    out = mixing.with_probability(docs, queries.TARGETS, 0.8)
    assert out.count() == docs.count()
    assert mixing.mix(docs, queries.TARGETS, 0.8).columns == docs.columns
    assert mixing.mix(docs.limit(0), queries.TARGETS, 0.8).collect() == []
    assert mixing.mix(docs.filter("text IS NULL"), queries.TARGETS, 0.8).collect() == []


def test_sql_gives_the_same(spark, tmp_path):
    docs_of(spark, corpus(n=80)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.mixing_sql())
    got = queries.op7_mixing(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_in_parts_as_in_one(spark):
    rng = random.Random(9)
    cells = [(f"s{a}" if a else None, f"l{b}", f"t{c}", rng.choice([0, 5, 100, 4000, 90_000])) for a in range(7) for b in range(3) for c in range(2)]
    rows = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": {"l0": 0.5, "*": 0.2}, "topic": 0.9}
    as_dict = lambda df: {tuple(r[:3]): (r["weight"], r["probability"]) for r in df.collect()}
    one, parts = mixing.rake(rows, targets, 0.3, 4), mixing.rake(rows, targets, 0.3, 4, few=3)
    want = as_dict(one)
    assert len(want) == len(cells)
    for k, v in as_dict(parts).items():
        assert v == pytest.approx(want[k], abs=1e-12)
    assert as_dict(mixing.rake(rows.limit(0), targets, 0.3, 2, few=-1)) == {}


def test_marginals_are_reported(spark):
    cells = [("a", "x", "t", 900), ("a", "y", "t", 40), ("b", "x", "t", 50), ("b", "y", "t", 50)]
    rows = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"*": 1.0}}
    got = {(r["dimension"], r["value"]): (r["target"], r["weight"]) for r in mixing.marginals(mixing.rake(rows, targets, 0.01, 30), targets).collect()}
    assert got["source", "a"] == pytest.approx((0.5, 0.5), abs=1e-6) and got["lang", "y"] == pytest.approx((0.5, 0.5), abs=1e-6)
    short = {r["value"]: (r["target"], r["weight"]) for r in mixing.marginals(mixing.rake(rows, targets, 0.9, 30), targets).filter("dimension = 'source'").collect()}
    assert short["b"][1] < short["b"][0]


def test_clashing_names(spark):
    names = [*mixing.NAMES, "tokens", "weight", "__all", "__tokens"]
    docs = spark.createDataFrame([(i, "one two three", "en", "s", *range(len(names))) for i in range(40)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mix(docs, queries.TARGETS, 0.5)
    assert out.columns == docs.columns and 0 < out.count() < 40
    assert all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
    with pytest.raises(ValueError):
        mixing.with_probability(docs, queries.TARGETS, 0.5)
