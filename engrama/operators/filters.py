"""Predicates on memories, as columns: Catalyst pushes them to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def unexpired(now: Column | int) -> Column:
    now = F.lit(now) if isinstance(now, int) else now
    return F.col("expires_at").isNull() | (F.col("expires_at") > now)


def visible_to(agent: str | None) -> Column | None:
    """Shared, unowned or own memories; None sees all."""
    if agent is None:
        return None
    return (F.col("visibility") == "shared") | F.col("agent_id").isNull() | (F.col("agent_id") == agent)


def predicates(kinds: Sequence[str] = (), tags: Sequence[str] = (), session_id: str | None = None, agent_id: str | None = None, since: int | None = None, until: int | None = None, as_agent: str | None = None, now: int | None = None) -> Column | None:
    """The conjunction of all constraints given; None if there is none."""
    parts = []
    if kinds:
        parts.append(F.col("kind").isin(*kinds))
    if tags:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)
    if session_id is not None:
        parts.append(F.col("session_id") == session_id)
    if agent_id is not None:
        parts.append(F.col("agent_id") == agent_id)
    if since is not None:
        parts.append(F.col("created_at") >= since)
    if until is not None:
        parts.append(F.col("created_at") <= until)
    if (seen := visible_to(as_agent)) is not None:
        parts.append(seen)
    if now is not None:
        parts.append(unexpired(now))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def matching(df, **constraints):
    p = predicates(**constraints)
    return df if p is None else df.filter(p)


def request_matches(m: str, r: str, now: int) -> Column:
    """Whether memory columns under alias ``m`` meet the request under alias ``r``; null or empty constraints are none."""
    c = lambda a, n: F.col(f"{a}.{n}")
    none = lambda n: c(r, n).isNull() | (F.size(c(r, n)) == 0)
    out = none("kinds") | F.array_contains(c(r, "kinds"), c(m, "kind"))
    out &= none("tags") | (F.size(F.array_except(c(r, "tags"), c(m, "tags"))) == 0)
    for n in ("session_id", "agent_id"):
        out &= c(r, n).isNull() | (c(r, n) == c(m, n))
    out &= c(r, "since").isNull() | (c(m, "created_at") >= c(r, "since"))
    out &= c(r, "until").isNull() | (c(m, "created_at") <= c(r, "until"))
    out &= c(r, "as_agent").isNull() | (c(m, "visibility") == "shared") | c(m, "agent_id").isNull() | (c(m, "agent_id") == c(r, "as_agent"))
    out &= c(m, "expires_at").isNull() | (c(m, "expires_at") > now)
    return F.coalesce(out, F.lit(False))
