"""Quality rules: divergence of a document from its language.

Each language of ``common`` has a reference: shares of character classes, and shares of its common words, which follow from their order by
Zipf's law. References are fixed values, so a document's verdict never depends on its neighbours; ``references`` fits others
from trusted text. A document is compared with the reference of its language by Jensen-Shannon distance (base 2, from 0 to 1) and
rejected beyond a limit. Histograms of short texts scatter: the squared distance of n counts in k bins from their source is about
a chi-square of k - 1 degrees over 8 n ln 2, of which its mean and three deviations are allowed beside the limit; the class histogram is judged from ``least_chars``
word characters on, the word histogram from ``least_words`` words on; shorter documents pass that rule.
One map: no row is shuffled, nothing is gathered.

Defined results: null text has no word and fails the base rules; where the language is null or has no reference, no word is common, and all
letters are one class, whatever their script; repeated rows are judged alike; an empty table gives an empty result; keys and other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, unused

#: Common words of each language, the most frequent first; a parameter.
COMMON = {
    "en": "the of and to in is that it for was on are as with be this by from at have or an not he which but they his had all we one can there been if more when will would".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass kann wir hat aus bei sind nach wird einer um am noch wie einem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais comme on sa nous cette ses aux elle deux".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me".split(),
}
OTHER = "*"
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other", "beyond")
SYMBOLS = b"#*$%&|<>"
#: Shares of the classes in ordinary text of a language, in the order of ``CLASSES``.
CLASS_SHARES = {
    "en": (0.79, 0.025, 0.005, 0.165, 0.025, 0.0005, 0.0005, 0.0005),
    "de": (0.77, 0.05, 0.005, 0.14, 0.025, 0.0005, 0.0005, 0.015),
    "fr": (0.76, 0.025, 0.005, 0.165, 0.025, 0.0005, 0.0005, 0.03),
    "es": (0.77, 0.025, 0.005, 0.165, 0.025, 0.0005, 0.0005, 0.025),
}
#: Of the words of ordinary text, the share that the listed common words make up.
COMMON_SHARE = 0.35
LETTERS = [CLASSES.index(c) for c in ("lower", "upper", "beyond")]


def word_shares(n: int, share: float = COMMON_SHARE) -> np.ndarray:
    """Shares of ``n`` common words by Zipf's law, then of all others."""
    z = 1 / (np.arange(n) + 2.0)
    return np.append(share * z / z.sum(), 1 - share) if n else np.ones(1)


def folded(by_class: np.ndarray) -> np.ndarray:
    """A class histogram with all letters as one class."""
    return np.append(np.delete(by_class, LETTERS), by_class[LETTERS].sum())


def fixed_references(common: dict[str, list[str]] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language: class and word shares; a language without class shares, and any not in ``common``, is judged by letters as one class."""
    common = COMMON if common is None else common
    out = {k: (np.array(CLASS_SHARES[k]), word_shares(len(v))) for k, v in common.items() if k in CLASS_SHARES}
    return out | {OTHER: (folded(np.mean(list(CLASS_SHARES.values()), axis=0)), np.ones(1))}


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 have none."""
    table = np.full(256, CLASSES.index("other"))
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, *range(9, 14))), ("stop", b".,;:!?'\"-()"), ("symbol", SYMBOLS), ("beyond", range(0xC0, 256))):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = -1
    return table


_TABLE = _class_table()


def class_histogram(by_byte: np.ndarray) -> np.ndarray:
    used = _TABLE >= 0
    return np.bincount(_TABLE[used], weights=by_byte[used], minlength=len(CLASSES))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def base_counts(raw: bytes, by_byte: np.ndarray, words: list[bytes]) -> tuple[int, int, int, int]:
    """Word characters, symbols, repeated lines, repeated words of UTF-8 text."""
    chars = int(by_byte[:0x80].sum() + by_byte[0xC0:].sum() - by_byte[32] - by_byte[9:14].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return chars, int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)


def word_histogram(raw: bytes, common: list[bytes]) -> np.ndarray:
    """Counts of the common words, then of all others."""
    words = raw.lower().split()
    found = Counter(filter(set(common).__contains__, words))
    hits = np.array([found[w] for w in common], float)
    return np.append(hits, len(words) - hits.sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0)))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def allowed(limit: float, bins: int, n: int) -> float:
    """The largest distance that passes: the limit and what chance adds with ``n`` counts."""
    return (limit**2 + (bins - 1 + 3 * (2 * (bins - 1)) ** 0.5) / (8 * n * np.log(2))) ** 0.5


def _language(lang: str | None, common: dict) -> str:
    return lang if lang in common else OTHER


def _encoded(common: dict[str, list[str]]) -> dict[str, list[bytes]]:
    return {k: [w.encode() for w in v] for k, v in common.items()} | {OTHER: []}


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON, least_words: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """References fitted from trusted documents of at least ``least_words`` words, each weighing 1; languages without any keep the fixed ones."""
    lists = _encoded(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for x, language in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw, k = x.as_buffer().to_pybytes(), _language(language, common)
                by_word = word_histogram(raw, lists[k])
                if by_word.sum() >= least_words:
                    by_class = class_histogram(np.bincount(np.frombuffer(raw, np.uint8), minlength=256))
                    at = sums.setdefault(k, [np.zeros(len(by_class)), np.zeros(len(by_word))])
                    at[0] += by_class / by_class.sum()
                    at[1] += by_word / by_word.sum()
        rows = [(k, kind, i, float(v)) for k, both in sums.items() for kind, h in enumerate(both) for i, v in enumerate(h)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.float64()], strict=True)], ["lang", "kind", "i", "value"])

    summed = docs.select(text_or_empty(text).cast("binary").alias("t"), F.col(lang).cast("string").alias("l")).mapInArrow(run, "lang string, kind int, i int, value double")
    sums = {k: (np.zeros(len(CLASSES)), np.zeros(len(v) + 1)) for k, v in lists.items()}
    for r in summed.groupBy("lang", "kind", "i").agg(F.sum("value").alias("value")).collect():  # languages times bins
        sums[r["lang"]][r["kind"]][r["i"]] = r["value"]
    out = fixed_references(common)
    for k, (by_class, by_word) in sums.items():
        if by_class.sum():  # to six digits: whatever the order of the sums
            by_class = folded(by_class) if k == OTHER else by_class
            out[k] = tuple(np.round(h / h.sum(), 6) for h in (by_class, by_word))
    return out


VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"


def judge(raw: bytes, reference: tuple[np.ndarray, np.ndarray], common: list[bytes], limits: tuple[float, float], least_chars: int, least_words: int) -> tuple:
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    chars, symbols, lines, repeats = base_counts(raw, by_byte, words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    by_class = by_word = None
    bins = len(reference[0])
    if chars >= least_chars:
        found = class_histogram(by_byte)
        by_class = distance(found if bins == len(CLASSES) else folded(found), reference[0])
    if len(words) >= least_words and common:
        by_word = distance(word_histogram(raw, common), reference[1])
    kept = not failed and (by_class is None or by_class <= allowed(limits[0], bins, chars)) and (by_word is None or by_word <= allowed(limits[1], len(common) + 1, len(words)))
    return len(words), chars, symbols, lines, repeats, failed, by_class, by_word, kept


#: Class and word distance beyond which a document is rejected.
LIMITS = (0.22, 0.33)


def with_verdict(docs: DataFrame, text: str = "text", lang: str = "lang", common: dict[str, list[str]] = COMMON, limits: tuple[float, float] = LIMITS, least_chars: int = 200, least_words: int = 100, known: dict | None = None, name: str = "__quality") -> DataFrame:
    """``docs`` (all columns) with ``name``, a struct of counts, distances and the verdict ``kept``. ``known``: references, by default the fixed ones."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}; give another name")
    known, lists = known or fixed_references(common), _encoded(common)

    @F.pandas_udf(VERDICT)
    def run(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        named = (x if x in known else OTHER for x in languages)
        rows = [judge(bytes(t), known[k], lists[k], limits, least_chars, least_words) for t, k in zip(texts, named, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in VERDICT.split(", ")])

    return docs.withColumn(name, run(text_or_empty(text).cast("binary"), F.col(lang).cast("string")))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass."""
    (name,) = unused(docs.columns, "__quality")
    return with_verdict(docs, name=name, **options).filter(f"`{name}`.kept").select(*docs.columns)
