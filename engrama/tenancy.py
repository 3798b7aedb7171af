"""Namespaces, API keys and errors of a server in front of the engine."""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import SparkSession

from .sources.store import Files

DEFAULT = "default"
_NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")


class ApiError(Exception):
    status = 500


class BadRequest(ApiError):
    status = 400


class Unauthorized(ApiError):
    status = 401


class Forbidden(ApiError):
    status = 403


def validate(name: str) -> str:
    """A namespace becomes a folder: nothing else may pass."""
    if not _NAME.fullmatch(name):
        raise BadRequest("a namespace has 1 to 64 characters of A-Z, a-z, 0-9, _ and -")
    return name


class Registry:
    """Engines by namespace; ``factory`` opens one in a folder. A root that holds a collection itself is the default namespace."""

    def __init__(self, spark: SparkSession, root: str, factory: Callable):
        self.spark, self.root, self.factory = spark, root.rstrip("/"), factory
        self.files = Files(spark, root)
        self.open: dict[str, object] = {}
        self.lock = Lock()
        self.legacy = self.files.exists("manifest")

    def folder(self, name: str) -> str:
        return self.root if self.legacy and name == DEFAULT else f"{self.root}/{validate(name)}"

    def get_or_create(self, name: str = DEFAULT):
        validate(name)
        with self.lock:
            if name not in self.open:
                self.open[name] = self.factory(self.spark, self.folder(name), name)
            return self.open[name]

    def list(self) -> list[str]:
        found = {n for n in self.files.list() if _NAME.fullmatch(n) and self.files.exists(f"{n}/manifest")}
        return sorted(found | set(self.open) | ({DEFAULT} if self.legacy else set()))

    def drop(self, name: str) -> bool:
        validate(name)
        if self.legacy and name == DEFAULT:
            raise BadRequest("the default namespace lives in the root and cannot be dropped")
        with self.lock:
            known = self.open.pop(name, None) is not None
            there = self.files.exists(name)
            if there:
                self.files.delete(name)
            return known or there

    def open_existing(self) -> int:
        names = self.list()
        for n in names:
            self.get_or_create(n)
        return len(names)


@dataclass(frozen=True)
class ApiKey:
    key: str
    namespaces: frozenset[str] | None = None

    @classmethod
    def parse(cls, spec: str) -> ApiKey:
        """``KEY`` (all namespaces) or ``KEY:ns1,ns2``."""
        key, colon, scope = spec.partition(":")
        if len(key.strip()) < 8:
            raise BadRequest("an API key has at least 8 characters")
        if not colon:
            return cls(key.strip())
        names = frozenset(validate(n.strip()) for n in scope.split(",") if n.strip())
        if not names:
            raise BadRequest("an empty scope")
        return cls(key.strip(), names)

    @property
    def admin(self) -> bool:
        return self.namespaces is None

    def may_access(self, namespace: str) -> bool:
        return self.namespaces is None or namespace in self.namespaces


def key_of(headers: Mapping[str, str]) -> str | None:
    low = {k.lower(): v for k, v in headers.items()}
    bearer = low.get("authorization", "")
    return bearer[7:].strip() if bearer.lower().startswith("bearer ") else low.get("x-api-key")


def namespace_of(headers: Mapping[str, str]) -> str:
    return {k.lower(): v for k, v in headers.items()}.get("x-namespace") or DEFAULT


class Auth:
    """No keys: open to all."""

    def __init__(self, keys: list[ApiKey] | None = None):
        self.keys = list(keys or ())

    def authenticate(self, presented: str) -> ApiKey | None:
        """Compares with every key, whatever matched before."""
        found = None
        for k in self.keys:
            if hmac.compare_digest(k.key.encode(), presented.encode()):
                found = k
        return found

    def resolve(self, headers: Mapping[str, str], admin: bool = False) -> str:
        """The namespace a request may use."""
        name = validate(namespace_of(headers))
        if not self.keys:
            return name
        presented = key_of(headers)
        known = self.authenticate(presented) if presented else None
        if known is None:
            raise Unauthorized("no key, or an unknown one")
        if admin and not known.admin or not known.may_access(name):
            raise Forbidden("the key does not reach that far")
        return name
