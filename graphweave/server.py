"""The gateway over HTTP: queries at any path, schema updates at ``/<source>/apply``."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from graphweave.errors import GraphError
from graphweave.gateway import Gateway
from graphweave.operators.lowering import FUSED, NESTED


def handler(gateway: Gateway, mode: str = FUSED) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: Any = None) -> None:
            data = b"" if body is None else (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(405)

        do_PUT = do_DELETE = do_PATCH = do_GET

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.path.rstrip("/").endswith("/apply"):
                return self._apply(self.path.strip("/").split("/")[0], body)
            try:
                asked = json.loads(body)
                query, variables = asked["query"], asked.get("variables") or {}
            except (ValueError, KeyError, TypeError, AttributeError):
                return self._answer(400)
            self._answer(200, gateway.execute(query, variables, asked.get("operationName"), NESTED, mode).to_json())

        def _apply(self, name: str, body: bytes) -> None:
            try:
                gateway.apply(name, json.loads(body)["sdl"])
                self._answer(200, {"ok": True})
            except (GraphError, ValueError, KeyError, TypeError) as e:
                self._answer(500, {"error": str(e)})

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def server(gateway: Gateway, port: int = 0, mode: str = FUSED) -> ThreadingHTTPServer:
    """A server that is not running yet; port 0 picks a free one."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(gateway, mode))
