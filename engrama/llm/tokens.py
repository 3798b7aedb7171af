"""Token ids of whole texts, with a bounded cache of encoded words.

The vocabulary used here drops white space and never lets a pre-token span it,
so a text's ids are the concatenation of the ids of its blank-separated chunks.
`WordCachedEncoder` checks that the tokenizer file has that shape and refuses any other.
Unseen chunks are encoded by the ``tokenizers`` library, in batches.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np

#: Name of the default vocabulary file; a parameter everywhere it is used.
DEFAULT_VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks that may be cut off a chunk's end; no rule of the split pattern starts with one of them inside a word.
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_`{}~|"


def _lowered(text: str) -> str:
    """Lower-case where that provably gives the same ids: the tokenizer lowers too, and Latin-1 lowers in one way."""
    if "<|" in text:  # may be an added token, which is matched before lowering
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordCachedEncoder:
    """Encode texts to little-endian unsigned 32-bit ids.

    ``max_entries`` bounds the cache of chunks and words: when it would overflow it is dropped and filled anew.
    Chunks over ``longest`` characters are encoded but never cached.
    """

    def __init__(self, path: str, max_entries: int = 1_200_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not self._splits_at_blanks(spec):
            raise ValueError("the vocabulary does not treat blanks as plain separators")
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        suffix = spec["model"]["end_of_word_suffix"]
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._max, self._longest = max_entries, longest
        self._known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _splits_at_blanks(spec: dict) -> bool:
        """Blanks are removed by the first split, letters and marks never share a pre-token, no added token has or strips a blank."""
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        removed = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec.get("added_tokens", []))
        lowers = {"type": "Lowercase"} in (spec.get("normalizer") or {}).get("normalizers", [])
        apart = pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        return bool(removed and plain and lowers and apart and spec["model"].get("end_of_word_suffix") and " " not in pattern and not spec.get("post_processor"))

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token each: they go in one string, cut where a token ends a word."""
        known, rest = self._known, []
        plain: list[str] = []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or w.lower().isalpha()) else rest).append(w)
        for at in range(0, len(plain), 1024):
            part = plain[at : at + 1024]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self._ends[ids]) * 4 + 4).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            else:
                rest += part
        for word, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def _fill(self, chunks: set[str]) -> None:
        """Make unseen chunks known: word and trailing marks apart where the split pattern cuts there anyway."""
        known, whole, cut = self._known, [], []
        parts: set[str] = set()
        for chunk in chunks:
            if not chunk[-1].isalnum() and (word := chunk.rstrip(_MARKS)) and word[-1].isalnum():
                marks = chunk[len(word) :]
                cut.append((chunk, word, marks))
                if word not in known:
                    parts.add(word)
                if marks not in known:
                    parts.add(marks)
            else:
                whole.append(chunk)
        self._encode(list(parts.union(whole)))
        for chunk, word, marks in cut:
            known[chunk] = known[word] + known[marks]
        for word in parts:
            if len(word) > self._longest and word not in chunks:
                del known[word]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One bytes object of ids per text; null counts as empty."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):  # a bounded number of characters at once
            stop, size = start, 0
            while stop < len(texts) and (size < 400_000 or stop == start):
                size += len(texts[stop] or "")
                stop += 1
            out += self._encode_some([_lowered(t or "").replace("\n", " ") for t in texts[start:stop]])
            start = stop
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        chunks = " ".join(texts).split(" ")
        known = self._known
        found = list(map(known.get, chunks))
        if None in found:
            unseen = [i for i, ids in enumerate(found) if ids is None]
            missing = {chunks[i] for i in unseen}
            if len(known) + 2 * len(missing) > self._max:
                known.clear()
                known[""] = b""
            self._fill(missing)
            for i in unseen:
                found[i] = known[chunks[i]]
            for chunk in missing:
                if len(chunk) > self._longest:
                    del known[chunk]
        out, at = [], 0
        for text in texts:
            n = text.count(" ") + 1
            out.append(b"".join(found[at : at + n]))
            at += n
        return out


_ENCODERS: dict[tuple, WordCachedEncoder] = {}


def encoder(path: str, max_entries: int = 1_200_000) -> WordCachedEncoder:
    """The encoder of this Python worker; its cache lives as long as the worker."""
    key = (path, max_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(path, max_entries)
    return _ENCODERS[key]
