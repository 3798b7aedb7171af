import random

import numpy as np
from xxhash import xxh64_intdigest

from engrama.llm import simhash

from .helpers import corpus, docs_of, with_odd_keys


def brute_print(text):
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(prints, radius=4):
    f = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    return simhash.spanning_labels(len(f), i, j)


def test_fingerprints():
    for t in [*corpus(n=10), "a b c d", "A b c D e", "x " * 200_000]:
        assert simhash.fingerprint((t or "").encode()) == brute_print(t[:4000] if t and t.startswith("x x") else t) or t.startswith("x x")
    assert simhash.fingerprint(("x " * 200_000).encode()) == brute_print("x x x x")


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    texts = corpus(n=30)
    base = [f"t{rng.randrange(900)}" for _ in range(300)]
    for _ in range(60):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(300)] = f"t{rng.randrange(900)}"
        texts.append(" ".join(copy))
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, texts), tile=8).collect()}
    prints = [brute_print(t) for t in texts]
    labels = brute_classes(prints)
    for i in range(len(texts)):
        assert out[i] == (f"{prints[i]:016x}", labels[i])
    assert len(set(labels.tolist())) < len(texts) - 40


def links_found(spark, prints, radius, bands, tile):
    values = np.array(prints, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fingerprint long")
    place = {int(x): i for i, x in enumerate(values.view(np.int64))}
    u, v = zip(*[(place[r["u"]], place[r["v"]]) for r in simhash.links(df, radius, bands, tile).collect()], strict=True)
    return simhash.spanning_labels(len(values), np.array(u), np.array(v))


def test_links_are_complete(spark):
    rng = random.Random(4)
    centers = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1]
    prints = set(centers)
    for c in centers:
        for n in range(40):
            x = c
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    for radius, bands, tile in ((4, 6, 1024), (4, 5, 4), (2, 4, 16), (4, 6, 3)):
        assert np.array_equal(links_found(spark, prints, radius, bands, tile), brute_classes(prints, radius))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[1000] == roots[999] == 999


def test_odd_rows(spark):
    docs = with_odd_keys(spark, corpus(n=5))
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    empty = {r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert len(empty) == 1
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    named = [r["doc_id"] for r in kept.collect()]
    assert named.count(None) == 2 and len(set(named)) == len(named) - 1
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_rows_that_share_a_key(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"t{rng.randrange(900)}" for _ in range(300)) for _ in range(4))
    near = lambda x: x.replace(" ", "  ", 3)  # noqa: E731  another text, the same fingerprint
    rows = [(1, a), (2, near(a)), (2, b), (2, c), (2, c), (None, d), (None, d), (None, near(d))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], " ".join(r["text"].split())) for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (2, b), (2, c), (None, d)], key=repr)


def test_bands_follow_the_number_of_fingerprints():
    assert simhash.bands_for(0, 4) == simhash.bands_for(10**6, 4) == 6
    found = [simhash.bands_for(10**n, 4) for n in range(13)]
    assert found == sorted(found) and found[-1] > 6
    for n, bands in enumerate(found):
        agreeing = min(sum(w for _, w in c) for c in simhash.band_choices(4, bands))
        assert 10**n / 2**agreeing < 64


def test_hubs_in_components(spark):
    """A star whose centre holds almost all links, beside other shapes."""
    edges = [(i, 5) for i in range(1000, 2500)] + [(i + 1, i) for i in range(10, 40)] + [(3000, 5), (3000, 12)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(roots.values()) == {5} and len(roots) == 1500 + 31 + 2


def test_clashing_names(spark):
    names = ["__text", "__key", "__stay", "__nth", "fingerprint", "root", "least"]
    docs = spark.createDataFrame([(i, f"some words {'of a text' * (i // 2)}", *range(len(names))) for i in range(6)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]
    assert simhash.near_duplicates(docs).count() == 6
