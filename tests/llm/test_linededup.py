import hashlib

from engrama.llm import linededup, queries

from .helpers import DOCS, EXTRA, corpus, docs_of, with_odd_keys

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(pairs):
    first = {}
    for i, t in sorted(pairs, key=lambda p: p[0]):
        for x in (t or "").split("\n"):
            first.setdefault(key(x), i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in pairs}


SHARED = ["a shared line of text", "  A SHARED line of text\t", "tiny", "another shared line", "Überlange ÉÈ Zeile", "überlange éè zeile"]


def texts():
    out = corpus(n=20)
    for i in range(40):
        out.append("\n".join([f"own line number {i} here", *SHARED[i % 5 :], SHARED[i % 3], SHARED[i % 3], ""]))
    out.append("\n".join(f"line {i % 130} of a long document" for i in range(300)))
    out.append("\n".join(f"LINE {i} of a long document" for i in range(200)))
    return out


def test_brute_force(spark):
    made = texts()
    docs = docs_of(spark, made)
    want = brute(list(enumerate(made)))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert {i: t or "" for i, t in got.items()} == want
    for salts in (1, 7):
        assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs, salts=salts).collect()} == got
    assert linededup.dedup_lines(docs).columns == docs.columns


def test_query_columns(spark, tmp_path):
    made = texts()
    docs_of(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(list(enumerate(made)))
    for r in queries.op4_line_dedup(spark, str(tmp_path)).collect():
        t = made[r["doc_id"]] or ""
        kept = want[r["doc_id"]]
        assert r["n_lines"] == t.count("\n") + 1
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert r["n_lines"] - r["n_dropped"] == (kept.count("\n") + 1 if kept or r["n_dropped"] < r["n_lines"] else 0)


def test_odd_keys(spark):
    line = "the very same line"
    rows = [(5, line), (5, line), (5, line + "\nx"), (None, line), (3, None), (7, line)]
    docs = spark.createDataFrame([(i, t, None, None, None, *[None] * EXTRA) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs).collect()]
    assert sorted(got, key=repr) == sorted([(5, ""), (5, ""), (5, "x"), (None, line), (3, None), (7, "")], key=repr)
    got = [(r["doc_id"], r["text"]) for r in linededup.dedup_lines(docs.filter("doc_id IS NOT NULL")).collect()]
    assert sorted(got, key=repr) == sorted([(5, line), (5, line), (5, line + "\nx"), (3, None), (7, "")], key=repr)
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
    assert linededup.dedup_lines(with_odd_keys(spark, corpus(n=5))).count() == 5 + 11 + 3


def test_bitmaps_keep(spark):
    """Bit p of word w says whether line 64 w + p stays; absent words are all ones."""
    made = texts()
    want = brute(list(enumerate(made)))
    for r in linededup.keep_bitmaps(docs_of(spark, made)).collect():
        lines, words = (r["text"] or "").split("\n"), r["__kept"] or {}
        stay = [x for p, x in enumerate(lines) if words.get(p // 64, -1) >> p % 64 & 1]
        assert "\n".join(stay) == want[r["doc_id"]] and all(w != -1 for w in words.values())


def test_clashing_names(spark):
    names = ["__kept", "__id", "__row", "__kept_", "range", "h", "words", "first"]
    docs = spark.createDataFrame([(i, "a shared line of text\nown", *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    out = linededup.dedup_lines(docs).collect()
    assert out[0].__fields__ == docs.columns and sorted((r["doc_id"], r["text"]) for r in out) == [(0, "a shared line of text\nown"), (1, "own"), (2, "own")]
    assert all([r[n] for n in names] == list(range(len(names))) for r in out)
