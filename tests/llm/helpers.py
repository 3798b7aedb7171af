"""Documents with every odd case, and small brute-force helpers."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, key string, piece int, offset string, h long, ids string, id string, row string, pos int, salt int, line string, first string, rank int, tile int, root long, u long, v long, weight string, probability string, topic string, tokens string"
EXTRA = len(DOCS.split(",")) - 5


def rows(texts, start=0):
    out = []
    for i, t in enumerate(texts):
        out.append((start + i, t, ["en", "de", None, "xx"][i % 4], ["s1", "s1", "s2", None][i % 4], None if t is None else len(t), *[None] * EXTRA))
    return out


def docs_of(spark, texts, start=0):
    """Documents that also have columns named like everything the operators use inside."""
    return spark.createDataFrame(rows(texts, start), DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    texts += [None, "", " \n\t", "one", texts[0], texts[0], texts[1] + " z", "\n\n", words(rng, 6000), "é ß 日本 " * 30, "a\x0bb\x0cc\r\nd \x1c e\x85f\xa0g"]
    return texts


def with_odd_keys(spark, texts):
    """Also a null key, and one row twice."""
    made = rows(texts)
    made += [made[0], (None, "no key at all here", "en", "s1", 3, *[None] * EXTRA), (None, None, None, None, None, *[None] * EXTRA)]
    return spark.createDataFrame(made, DOCS)
