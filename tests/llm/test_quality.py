import random
from collections import Counter

import numpy as np
import pytest

from engrama.llm import quality

from .helpers import corpus, docs_of, with_odd_keys

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text:
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def brute_base(text):
    text = text or ""
    words = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def prose(rng, n):
    pool = quality.COMMON["en"]
    return " ".join(rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def made():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60, 400)) for _ in range(40)]
    texts += [prose(rng, 60) + "\n" + "same line\n" * 4 + " \n \n", "a b c " * 40, "### $$$ %%% " * 60, prose(rng, 300).upper(), "é à " * 60]
    return texts + corpus(n=10)


def test_base_counts(spark):
    texts = made()
    for r in quality.with_verdict(docs_of(spark, texts)).select("doc_id", "__quality.*").collect():
        want = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])


def brute_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    d = sum(0.5 * a * np.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * np.log2(b / c) for b, c in zip(q, m) if b)
    return max(d, 0) ** 0.5


def test_distance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p, q = rng.integers(0, 5, 8), rng.integers(0, 5, 8)
        p[0] += 1
        q[1] += 1
        assert quality.distance(p, q) == pytest.approx(brute_distance(p, q), abs=1e-9)
    assert quality.distance(np.array([1.0, 0]), np.array([0, 3.0])) == pytest.approx(1)
    assert quality.distance(np.array([2.0, 4]), np.array([1.0, 2])) == pytest.approx(0, abs=1e-7)


def test_verdicts(spark):
    rng = random.Random(8)
    good = [prose(rng, rng.randrange(120, 400)) for _ in range(60)]
    odd = [" ".join("".join(rng.choice("#$%&*|") for _ in range(4)) for _ in range(200)), prose(rng, 300).upper(), " ".join(f"{rng.randrange(10**6)}" for _ in range(200))]
    texts = good + odd
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "'en' AS lang")
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == set(range(60))


def test_odd_rows(spark):
    docs = with_odd_keys(spark, corpus(n=5))
    out = quality.with_verdict(docs)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "__quality"]
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs.limit(0)).collect() == []


def brute_kept(text, lang):
    """The verdict written plainly, character by character and word by word."""
    n_words, chars, *_, failed = brute_base(text)
    if failed:
        return False
    table = {"lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": BLANKS, "stop": ".,;:!?'\"-()", "symbol": "#*$%&|<>"}
    table["upper"] = table["lower"].upper()
    counts = Counter(next((k for k, v in table.items() if c in v), "beyond" if ord(c) > 127 else "other") for c in text)
    by_class = [counts[k] for k in quality.CLASSES]
    reference = quality.CLASS_SHARES.get(lang)
    if reference is None:
        pooled = np.mean(list(quality.CLASS_SHARES.values()), axis=0)
        at = {k: i for i, k in enumerate(quality.CLASSES)}
        keep = ["digit", "blank", "stop", "symbol", "other"]
        letters = ["lower", "upper", "beyond"]
        reference = [pooled[at[k]] for k in keep] + [sum(pooled[at[k]] for k in letters)]
        by_class = [counts[k] for k in keep] + [sum(counts[k] for k in letters)]
    slack = lambda bins, n: (bins - 1 + 3 * (2 * (bins - 1)) ** 0.5) / (8 * n * np.log(2))
    if chars >= 200 and brute_distance(by_class, reference) ** 2 > 0.22**2 + slack(len(reference), chars):
        return False
    common = quality.COMMON.get(lang, [])
    if n_words >= 100 and common:
        found = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in split(text))
        hits = [found[w] for w in common]
        zipf = [1 / (r + 2) for r in range(len(common))]
        shares = [0.35 * z / sum(zipf) for z in zipf] + [0.65]
        if brute_distance([*hits, n_words - sum(hits)], shares) ** 2 > 0.33**2 + slack(len(shares), n_words):
            return False
    return True


def test_query(spark, tmp_path):
    from engrama.llm import queries

    rng = random.Random(21)
    texts = [*made(), prose(rng, 40_000), "слово и ещё одно " * 3, " ".join(f"слово{i} и ещё" for i in range(90)), " | ".join(prose(rng, 300).split())]
    texts += [" ".join(w + "#*%&"[i % 4] * 3 for i, w in enumerate(prose(rng, 200).split()))]
    rows = docs_of(spark, texts * 2)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    langs = {r["doc_id"]: (r["text"], r["lang"]) for r in rows.collect()}
    out = queries.op5_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(texts) * 2
    verdicts = {brute_kept(*langs[r["doc_id"]]) for r in out}
    for r in out:
        assert r["kept"] == brute_kept(*langs[r["doc_id"]]), r["doc_id"]
    assert verdicts == {True, False}


def test_a_verdict_does_not_depend_on_neighbours(spark):
    rng = random.Random(5)
    docs = docs_of(spark, [prose(rng, 200) for _ in range(4)] + [" ".join("#$%|" for _ in range(200 + i)) for i in range(40)]).selectExpr("doc_id", "text", "'en' AS lang", "1 AS __quality")
    kept = [r["doc_id"] for r in quality.keep_good(docs).collect()]
    assert sorted(kept) == [0, 1, 2, 3] and quality.keep_good(docs).columns == docs.columns
    with pytest.raises(ValueError):
        quality.with_verdict(docs)


def test_fitted_references(spark):
    rng = random.Random(6)
    trusted = docs_of(spark, [prose(rng, 300) for _ in range(8)]).selectExpr("text", "'en' AS lang")
    known = quality.references(trusted)
    assert known["en"][1][-1] == pytest.approx(0.6, abs=0.05) and known["de"][1][-1] == pytest.approx(0.65)
    docs = docs_of(spark, [prose(rng, 300)]).selectExpr("text", "'en' AS lang")
    assert quality.keep_good(docs, known=known, limits=(0.05, 0.05)).count() == 1 and quality.keep_good(docs, limits=(0.05, 0.05)).count() == 0
