"""Request metrics in the Prometheus text format, and request logging."""

from __future__ import annotations

import json
import logging
import time
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from threading import Lock

from .operators.aggregates import EDGES

LOG = logging.getLogger("engrama.requests")
GAUGES = (("memories", "total_memories", "Live memories."), ("vector_indexed", "vector_indexed", "Memories with a vector."), ("lexical_indexed", "lexical_indexed", "Memories with text."), ("graph_entities", "entities", "Distinct entities."), ("wal_tail_ops", "wal_tail_ops", "Operations since the last checkpoint."))


def escape(label: str) -> str:
    return label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


class Histogram:
    def __init__(self):
        self.counts = [0] * (len(EDGES) + 1)
        self.sum = 0.0

    def record(self, seconds: float) -> None:
        self.counts[bisect_left(EDGES, seconds)] += 1
        self.sum += seconds

    def cumulative(self) -> list[int]:
        out, total = [], 0
        for c in self.counts:
            total += c
            out.append(total)
        return out


class Metrics:
    def __init__(self):
        self.requests: Counter = Counter()
        self.latency: dict[str, Histogram] = {}
        self.rejected = 0
        self.lock = Lock()

    def record(self, route: str, status: int, seconds: float) -> None:
        with self.lock:
            self.requests[route, status] += 1
            self.latency.setdefault(route, Histogram()).record(seconds)
            self.rejected += status in (401, 403)

    def render(self, stats: dict[str, dict]) -> str:
        """``stats``: per namespace, the row of ``aggregates.stats``."""
        out = []

        def head(name: str, kind: str, text: str) -> None:
            out.extend([f"# HELP engrama_{name} {text}", f"# TYPE engrama_{name} {kind}"])

        for name, field, text in GAUGES:
            head(name, "gauge", text)
            out.extend(f'engrama_{name}{{namespace="{escape(ns)}"}} {s[field]}' for ns, s in sorted(stats.items()))
        with self.lock:
            head("requests_total", "counter", "Requests by route and status.")
            out.extend(f'engrama_requests_total{{route="{escape(r)}",status="{s}"}} {n}' for (r, s), n in sorted(self.requests.items()))
            head("requests_rejected_total", "counter", "Requests refused for want of a key or scope.")
            out.append(f"engrama_requests_rejected_total {self.rejected}")
            head("request_duration_seconds", "histogram", "Latency by route.")
            for route, h in sorted(self.latency.items()):
                label, counts = escape(route), h.cumulative()
                out.extend(f'engrama_request_duration_seconds_bucket{{route="{label}",le="{e}"}} {n}' for e, n in zip([*EDGES, "+Inf"], counts, strict=True))
                out.extend([f'engrama_request_duration_seconds_sum{{route="{label}"}} {h.sum}', f'engrama_request_duration_seconds_count{{route="{label}"}} {counts[-1]}'])
        return "\n".join(out) + "\n"


def log_request(style: str, method: str, route: str, namespace: str, status: int, ms: float) -> None:
    """``style``: text, json or off. Server errors are errors, client errors warnings."""
    if style not in ("text", "json", "off"):
        raise ValueError(f"unknown log style {style}")
    if style == "off":
        return
    level = logging.ERROR if status >= 500 else logging.WARNING if status >= 400 else logging.INFO
    fields = {"method": method, "route": route, "namespace": namespace, "status": status, "ms": round(ms, 3)}
    LOG.log(level, json.dumps(fields) if style == "json" else f"{method} {route} {status} {ms:.1f}ms ns={namespace}")


def observed(metrics: Metrics, route: str, call: Callable, style: str = "off", namespace: str = "default"):
    """Run ``call`` and record how it went; an error with a ``status`` counts as that."""
    start, status = time.perf_counter(), 200
    try:
        return call()
    except Exception as e:
        status = getattr(e, "status", 500)
        raise
    finally:
        seconds = time.perf_counter() - start
        metrics.record(route, status, seconds)
        log_request(style, "POST", route, namespace, status, seconds * 1000)
