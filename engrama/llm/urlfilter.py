"""URL filters: listed rules, else logistic regression on hashed character n-grams of host and path.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the bias
alone (allowed); repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"

#: The labelled table the model learns from by default, label 1: block. Invented urls of reserved domains, by kind of site: wagers, adult
#: pages, link and mail abuse, sold remedies, trackers, malicious pages; then sites to allow, some with words near to these. Subdomains
#: (blog, m, www) are as common on either side, so that they say nothing.
LABELLED: tuple[tuple[str, int], ...] = (
    ("https://casino-palace.example.com/en/slots/7", 1), ("http://online-casino.example.net/bonus", 1), ("https://www.grand-casino.example.org/de/9", 1), ("https://bets-today.example.org/odds", 1), ("http://www.best-bets.example.net/en/31", 1),
    ("https://m.sure-bets.example.com/fr/2", 1), ("http://free-spins.example.org/en/2", 1), ("https://jackpot-win.example.net/play", 1), ("http://blog.lucky-win.example.com/es/12", 1), ("https://blog.poker-room.example.net/tables", 1), ("http://blog.free-money.example.com/en/8", 1),
    ("https://www.adult-chat.example.org/live", 1), ("http://www.adult-cams.example.net/en/44", 1), ("http://xxx-videos.example.com/hot/9", 1), ("https://m.adult-films.example.com/de/5", 1), ("http://blog.sexy-cams.example.net/en/3", 1), ("https://blog.x-rated.example.com/clips/2", 1), ("http://blog.model-x.example.org/fr/61", 1),
    ("https://www.link-farm.example.net/links/all", 1), ("http://blog.click-farm.example.org/en/19", 1), ("http://seo-spam.example.com/buy-links", 1), ("https://m.spam-mail.example.net/en/70", 1), ("http://www.spam-links.example.org/es/4", 1), ("https://content-farm.example.com/fr/1", 1),
    ("https://blog.diet-pills.example.com/order", 1), ("http://pills-online.example.net/buy", 1), ("https://m.sleep-pills.example.org/de/33", 1), ("http://cheap-meds.example.com/en/6", 1), ("https://www.cheap-loans.example.net/apply", 1), ("http://cheap-watches.example.org/sale", 1), ("https://replica-bags.example.net/sale", 1),
    ("https://ads-server.example.com/banner/3", 1), ("http://blog.popup-ads.example.net/show", 1), ("https://m.ads-network.example.org/en/6", 1), ("http://click-track.example.com/r?id=9", 1), ("https://pixel-track.example.net/p.gif", 1), ("http://www.user-track.example.org/en/50", 1),
    ("http://malware-drop.example.net/setup.exe", 1), ("https://phish-login.example.org/account", 1), ("http://m.crack-keys.example.com/download", 1), ("https://warez-files.example.net/en/5", 1),
    ("https://thunder.example.net/en/14", 0), ("https://island.example.net/en/322#top", 0), ("http://hand.example.net/fr/7.html", 0), ("https://lantern.example.net/en/81/", 0), ("https://hill-walks.example.net/en/2", 0),
    ("http://example.com/", 0), ("https://example.net/about", 0), ("https://www.example.org/", 0), ("https://example.org/de/index.html", 0),
    ("https://blog.garden.example.com/en/12", 0), ("http://www.history.example.org/en/345.html", 0), ("https://m.weather.example.net/de/7", 0), ("https://library.example.org/fr/90/", 0), ("http://news.example.com/en/2020/3", 0),
    ("https://docs.science.example.net/es/81?page=2&ref=x", 0), ("https://blog.cooking.example.org/fr/5#top", 0), ("http://www.museum.example.com/en/777/", 0), ("https://school.example.net/de/61.html", 0), ("http://m.river.example.org/en/10?utm_source=feed", 0),
    ("https://blog.station.example.net/en/230", 0), ("https://theatre.example.com/es/19", 0), ("http://www.nation.example.org/en/4", 0), ("https://mountain.example.com/de/55", 0), ("http://blog.other.example.net/fr/8.html", 0),
    ("https://m.there.example.com/en/91", 0), ("http://thought.example.org/en/31/", 0), ("https://www.garnet.example.net/es/600", 0), ("http://hearth.example.com/en/72?page=2&ref=x", 0), ("https://blog.motion.example.org/de/13", 0),
    ("http://www.water.example.net/en/5", 0), ("https://forest.example.com/fr/28#top", 0), ("http://m.letters.example.org/en/404", 0), ("https://train.example.net/es/3", 0), ("https://www.wheat.example.com/en/650", 0),
    ("https://blog.weather.example.com/de/925#top", 0), ("https://blog.harbour.example.org/es/47", 0), ("http://blog.ashes.example.com/en/8/", 0), ("https://farm-shop.example.org/de/6", 0), ("http://www.old-farm.example.net/en/73", 0),
    ("https://tracks-and-trails.example.com/en/9", 0), ("http://m.race-track.example.org/fr/15", 0), ("https://adult-education.example.net/de/2", 0), ("http://free-software.example.org/en/88", 0), ("https://win-win.example.com/es/7.html", 0),
    ("https://m.ads.example.net/de/104", 0), ("http://shop-windows.example.com/fr/2", 0), ("https://train-times.example.org/en/17", 0), ("http://blog.sea-side.example.net/es/40", 0), ("https://www.book-club.example.com/en/11", 0),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


#: Weight of the path's n-grams beside the host's.
PATH_SHARE = 0.3


def ngrams(host: str, path: str, sizes: Iterable[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams, each once, and their values: host and path are scaled to fixed lengths, so a long path doesn't drown a host."""
    ids, values = [], []
    for mark, part, share in (("h", f"^{host}$", 1.0), ("p", f"^{path}$", PATH_SHARE)):
        found = sorted({zlib.crc32(f"{mark}{part[i : i + n]}".encode()) % buckets for n in sizes for i in range(len(part) - n + 1)})
        ids += found
        values += [share / max(1, len(found)) ** 0.5] * len(found)
    return np.array(ids, np.int64), np.array(values)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def probability(self, host: str, path: str) -> float:
        """That the url is to be blocked."""
        raw = self.bias
        if host or path:
            ids, values = ngrams(host, path, self.sizes, len(self.weights))
            raw += float(self.weights[ids] @ values)
        return float(1 / (1 + np.exp(-raw)))


def train(labelled: Iterable[tuple[str | None, int]] = LABELLED, sizes: tuple[int, ...] = (3, 4, 5), buckets: int = 1 << 16, epochs: int = 500, rate: float = 0.5, decay: float = 1e-4, prior: float = -0.5) -> Model:
    """Gradient steps on the logistic loss of a small labelled table. ``prior``: the fixed bias, the leaning without evidence."""
    pairs = [(split_url(u), y) for u, y in labelled]
    rows = [ngrams(*hp, sizes, buckets) for hp, _ in pairs]
    w = np.zeros(buckets)
    if not rows:
        return Model(w, prior, tuple(sizes))
    y = np.array([v for _, v in pairs], float)
    ids, values = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    for _ in range(epochs):
        error = 1 / (1 + np.exp(-(np.bincount(at, w[ids] * values, len(rows)) + prior))) - y
        w -= rate * (np.bincount(ids, error[at] * values, buckets) + decay * w)
    return Model(w, prior, tuple(sizes))


class Rules:
    """(verdict, host, path) rules. A rule fits its host and all subdomains where the path starts with the rule's; the longest wins."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict, or nulls."""
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = (), labelled: Iterable[tuple[str | None, int]] = LABELLED, key: str = "page_id", url: str = "url", limit: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, probability) of every row. Model and rules are small tables of the caller's."""
    shared = pages.sparkSession.sparkContext.broadcast((train(labelled), Rules(rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, listed = shared.value
        for batch in batches:
            rows = []
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                rule, verdict = listed.match(host, path)
                p = model.probability(host, path)
                rows.append((host, path, rule, verdict or (BLOCK if p >= limit else ALLOW), p))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.string()] * 4, pa.float64()], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "host", "path", "rule", "verdict", "probability"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(url).cast("string").alias("url")).mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string, probability double")
