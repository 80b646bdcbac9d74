"""Health and metrics over HTTP."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .metrics import Metrics


def serve(metrics: Metrics, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """/metrics and /health (503 once a query has failed), in a thread of their own; shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            if self.path == "/metrics":
                code, body = 200, metrics.text()
            elif self.path == "/health":
                code, body = (200, "ok\n") if metrics.healthy() else (503, "failed: " + ", ".join(sorted(metrics.failed)) + "\n")
            else:
                code, body = 404, "not found\n"
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
