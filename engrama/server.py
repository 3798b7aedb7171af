"""Thin fronts: HTTP over ``routes`` and JSON-RPC lines over ``tool``; standard library only."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from .api import ADMIN, Engine, routes, tool
from .metrics import Metrics, observed
from .tenancy import ApiError, Auth, BadRequest, Registry

MOST_BYTES = 256 << 20


def handler(registry: Registry, auth: Auth, metrics: Metrics, style: str = "off") -> type[BaseHTTPRequestHandler]:
    table = routes(registry)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _answer(self, status: int, body: str, kind: str = "application/json") -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _run(self, body: dict) -> None:
            route = self.path.partition("?")[0]
            try:
                if route == "/healthz":
                    return self._answer(200, '"ok"')
                namespace = auth.resolve(self.headers, admin=route in ADMIN)
                if route == "/metrics":
                    return self._answer(200, metrics.render({n: e.stats() for n, e in registry.open.items()}), "text/plain; version=0.0.4")
                if route not in table:
                    return self._answer(404, json.dumps({"error": "no such route"}))
                found = observed(metrics, route, lambda: table[route](namespace, body), style, namespace)
                self._answer(200, json.dumps(found, default=str))
            except ApiError as e:
                if e.status in (401, 403):
                    metrics.record(route, e.status, 0.0)
                self._answer(e.status, json.dumps({"error": str(e)}))
            except (KeyError, TypeError, ValueError) as e:
                self._answer(400, json.dumps({"error": str(e)}))

        def do_GET(self):
            query = dict(p.partition("=")[::2] for p in self.path.partition("?")[2].split("&") if p)
            self._run(query)

        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                return self._answer(413, json.dumps({"error": "too large"}))
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                return self._answer(400, json.dumps({"error": "not JSON"}))
            self._run(body)

    return Handler


def serve(registry: Registry, auth: Auth, port: int = 8080, style: str = "text") -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(registry, auth, Metrics(), style))


TOOLS = [
    {"name": "memory_remember", "description": "Store a memory.", "inputSchema": {"type": "object", "properties": {"text": {"type": "string"}, "kind": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}, "importance": {"type": "number"}, "session_id": {"type": "string"}}, "required": ["text"]}},
    {"name": "memory_recall", "description": "Find memories.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}, "strategy": {"type": "string"}}, "required": ["query"]}},
    {"name": "memory_forget", "description": "Delete a memory.", "inputSchema": {"type": "object", "properties": {"id": {"type": "string"}}, "required": ["id"]}},
]


def answer(engine: Engine, message: dict, agent_id: str | None = None) -> dict | None:
    """The reply to one JSON-RPC message; None to a notification."""
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "engrama", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            found = tool(engine, params.get("name", ""), params.get("arguments") or {}, agent_id)
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, default=str)}]}}
        except (BadRequest, KeyError, TypeError) as e:
            return reply | {"error": {"code": -32602, "message": str(e)}}
    return reply | {"error": {"code": -32601, "message": "method not found"}}


def stdio(engine: Engine, agent_id: str | None = None, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line), agent_id)
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if reply is not None:
            out.write(json.dumps(reply) + "\n")
            out.flush()
