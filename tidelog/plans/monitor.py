"""Metrics over HTTP: /, /stats, /cache and /health as JSON; anything else is not found."""
from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

PATHS = ("/", "/stats", "/cache", "/health")


def answer(store, path: str) -> tuple[int, dict]:
    """Status and content for a path; from the handle's own counters, no job runs."""
    if path == "/":
        return 200, {"service": "tidelog", "paths": list(PATHS)}
    if path == "/stats":
        return 200, store.stats()
    if path == "/cache":
        return 200, store.cache_stats()
    if path == "/health":
        return 200, {"status": "ok", "version": store.manifest.version}
    return 404, {"error": "not found", "path": path}


class Monitor:
    """Serves a store's metrics from a thread of its own; port 0 takes any that is free."""

    def __init__(self, store, port: int, host: str = "127.0.0.1"):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802  the server's own name
                status, content = answer(store, self.path.split("?")[0])
                raw = json.dumps(content, sort_keys=True).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_) -> None:
                return

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.port = self._server.server_address[1]
        self._thread = Thread(target=self._server.serve_forever, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()
        self._thread.join()
