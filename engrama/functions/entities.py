"""Entity extraction: tags, identifiers, short capitals and runs of names, as column expressions.

Each word is given a mark that says what it is, and the marked words are put into one string; a pattern over that string then finds the
entities as islands: a run of names is its first name's mark and all that follows up to a mark that no run can hold. Marks are white space,
which no word contains.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capitalised words that are no names.
STOPWORDS = ("the", "a", "an", "i", "we", "you", "it", "this", "that", "these", "those", "my", "our", "your", "their", "his", "her", "its", "they", "he", "she", "if", "when", "then", "also", "but", "and", "or", "not", "no", "yes", "today", "yesterday", "tomorrow")
MOST = 16

#: Marks: a name, a name at the start of a sentence, a name that stands alone at the start of an island, an identifier or capitals, any other word.
NAME, FIRST, LONE, TERM, OTHER = "\t", "\n", "\x0b", "\x0c", "\r"
_BLANKS = r"[\s\x0B\x85\p{Z}]+"
_BARE = r"^[^\p{L}\p{N}-]*+(.*[\p{L}\p{N}-])"
_NAME = r"^\p{Lu}[\p{Ll}\p{N}]*+$"
_STOPS = (".", "!", "?", ":", ";")
#: What every entity of a text has; other words are no more than a mark.
_TELLING = r"[\p{Lu}\p{N}]"
_ISLAND = f"[{NAME}{FIRST}][^{TERM}{OTHER}]*+|[{LONE}{TERM}][^{NAME}{FIRST}{LONE}{TERM}{OTHER}]++"
_IN_RUN = f"[{NAME}{FIRST}{LONE}]"


def _marked(word: Column, starts: Column) -> Column:
    """A word with its mark; ``starts``: whether a sentence starts with it."""
    size = F.octet_length(word)
    number = word.rlike(r"\p{N}")
    term = (number & word.rlike(r"\p{L}") & (size >= 3)) | (size.between(2, 6) & word.rlike(r"^\p{Lu}++$"))
    name = word.rlike(_NAME) & ~F.lower(word).isin(*STOPWORDS)
    mark = F.when(name, F.when(term, LONE).when(starts, FIRST).otherwise(NAME)).when(term, TERM).otherwise(OTHER)
    return F.when((word == "") | (mark == OTHER), OTHER).otherwise(F.concat(mark, word))


def _found(text: Column) -> Column:
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda x: x != "")
    bare = lambda x: F.when(x.rlike(_TELLING), F.regexp_extract(x, _BARE, 1)).otherwise("")
    words = F.transform(raw, lambda x: F.struct(bare(x).alias("word"), F.substring(x, -1, 1).isin(*_STOPS).alias("stops")))
    before = F.concat(F.array(F.struct(F.lit("").alias("word"), F.lit(True).alias("stops"))), words)  # one more than there are words
    marked = F.array_join(F.zip_with(words, before, lambda w, b: F.coalesce(_marked(w["word"], b["stops"]), F.lit(""))), "")
    islands = F.filter(F.regexp_extract_all(marked, F.lit(f"({_ISLAND})"), 1), lambda m: ~(m.startswith(FIRST) & ~F.substring(m, 2, 2**31 - 1).rlike(_IN_RUN)))
    return F.transform(islands, lambda m: F.regexp_replace(F.substring(m, 2, 2**31 - 1), _IN_RUN, " "))


def extract_entities(text: Column, tags: Column) -> Column:
    """Lower-cased entities, tags first, each once, at most ``MOST``."""
    own = F.coalesce(tags, F.array().cast("array<string>"))
    keys = F.filter(F.transform(F.concat(own, _found(text)), lambda e: F.lower(e)), lambda e: F.octet_length(e) >= 2)
    return F.slice(F.array_distinct(keys), 1, MOST)


def _mark(word: str, starts: bool) -> str:
    size = len(word.encode())
    term = size >= 3 and regex.search(r"\p{N}", word) and regex.search(r"\p{L}", word) or 2 <= size <= 6 and regex.fullmatch(r"\p{Lu}+", word)
    if regex.search(_NAME, word) and word.lower() not in STOPWORDS:
        return (LONE if term else FIRST if starts else NAME) + word
    return TERM + word if term else OTHER


def entities_of(text: str | None, tags=()) -> list[str]:
    """``extract_entities`` of one text, outside of Spark."""
    raw = [x for x in regex.split(_BLANKS, text or "") if x]
    bare = [m[1] if (m := regex.search(_BARE, x)) else "" for x in raw]
    starts = [True, *(x.endswith(_STOPS) for x in raw[:-1])]
    islands = regex.findall(_ISLAND, "".join(map(_mark, bare, starts)))
    found = [regex.sub(_IN_RUN, " ", m[1:]) for m in islands if m[0] != FIRST or regex.search(_IN_RUN, m[1:])]
    keys = [e.lower() for e in (*(tags if tags is not None else ()), *found)]
    return list(dict.fromkeys(k for k in keys if len(k.encode()) >= 2))[:MOST]
