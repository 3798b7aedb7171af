"""Interfaces of pluggable models and clients of common HTTP protocols (standard library only)."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.ingest import parse_indices


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def __call__(self, query: str, docs: list[str]) -> list[float]: ...


class Summarizer(Protocol):
    def __call__(self, memories: list[str]) -> str: ...


class Extractor(Protocol):
    """Gives a model's answer for a conversation and the facts already known."""

    def __call__(self, conversation: str, known: list[str]) -> str: ...


def embedding_column(embedder: Embedder, prefix: str = "", batch: int = 64) -> Callable[[Column], Column]:
    """An Arrow UDF over a batch embedder; null texts are not sent and get null. ``prefix``: for models that tell queries from passages."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        given = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        for a in range(0, len(given), batch):
            some = given[a : a + batch]
            for i, v in zip(some, embedder([prefix + texts.iloc[i] for i in some]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out, dtype=object)

    return run


def _post(url: str, body: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310  the caller names the endpoint
        return json.loads(answer.read())


def embeddings_client(base_url: str, model: str, key: str = "", post=_post) -> Embedder:
    """``POST /embeddings`` with {model, input}; answers are put in the order of their ``index``."""

    def embed(texts: list[str]) -> list[list[float]]:
        answer = post(f"{base_url.rstrip('/')}/embeddings", {"model": model, "input": texts}, {"Authorization": f"Bearer {key}"} if key else {})
        rows = sorted(answer["data"], key=lambda r: r["index"])
        if len(rows) != len(texts):
            raise ValueError("another number of vectors than of texts")
        return [r["embedding"] for r in rows]

    return embed


def content_client(base_url: str, model: str, key: str, post=_post) -> Embedder:
    """``POST /models/<model>:embedContent``, a text at a time; the vector is under embedding.values."""

    def embed(texts: list[str]) -> list[list[float]]:
        url = f"{base_url.rstrip('/')}/models/{model}:embedContent"
        return [post(url, {"content": {"parts": [{"text": t}]}}, {"x-goog-api-key": key})["embedding"]["values"] for t in texts]

    return embed


def dimension_of(embedder: Embedder) -> int:
    """By a probe."""
    size = len(embedder(["dimension probe"])[0])
    if not size:
        raise ValueError("the embedder returned an empty vector")
    return size


def chat_client(base_url: str, model: str, key: str = "", post=_post) -> Callable[[str, str], str]:
    """``POST /chat/completions``: (system, user) -> content."""

    def chat(system: str, user: str) -> str:
        body = {"model": model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return post(f"{base_url.rstrip('/')}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {})["choices"][0]["message"]["content"]

    return chat


def parse_scores(answer: str, n: int) -> list[float]:
    """n numbers from 0 to 10 as 0..1, possibly in a code fence."""
    body = answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    scores = json.loads(body)
    if not isinstance(scores, list) or len(scores) != n:
        raise ValueError("another number of scores than of documents")
    return [min(1.0, max(0.0, float(s) / 10)) for s in scores]


def chat_reranker(chat: Callable[[str, str], str]) -> Reranker:
    def rerank(query: str, docs: list[str]) -> list[float]:
        listed = "\n".join(f"{i}. {d}" for i, d in enumerate(docs, 1))
        return parse_scores(chat("Rate from 0 to 10 how well each document answers the query. Answer with a JSON array of numbers only.", f"Query: {query}\n{listed}"), len(docs))

    return rerank


def chat_summarizer(chat: Callable[[str, str], str]) -> Summarizer:
    def summarize(memories: list[str]) -> str:
        return chat("Condense these notes into one short paragraph. Keep names, numbers and decisions.", "\n".join(f"- {m}" for m in memories)).strip()

    return summarize


def chat_extractor(chat: Callable[[str, str], str]) -> Extractor:
    def extract(conversation: str, known: list[str]) -> str:
        stored = "Already stored:\n" + "\n".join(f"- {k}" for k in known) + "\n\n" if known else ""
        return chat('List the lasting facts of this conversation as a JSON array of {"text", "kind", "importance"}.', f"{stored}Conversation:\n{conversation}")

    return extract


def chat_superseder(chat: Callable[[str, str], str]) -> Callable[[str, list[str]], list[int]]:
    def superseded(fact: str, existing: list[str]) -> list[int]:
        listed = "\n".join(f"{i}. {e}" for i, e in enumerate(existing, 1))
        return parse_indices(chat("Which numbered facts does the new fact replace? Answer with a JSON array of numbers.", f"New fact: {fact}\n{listed}"), len(existing))

    return superseded


def keyword_reranker(query: str, docs: Iterable[str]) -> list[float]:
    """Share of the query's distinct tokens that a document holds."""
    from .functions.text import tokens_of

    wanted = set(tokens_of(query))
    return [len(wanted & set(tokens_of(d))) / len(wanted) if wanted else 0.0 for d in docs]
