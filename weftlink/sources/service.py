"""A thin HTTP front over the engine's tables: a page, summary, entity search, pair scoring and downloads, one thread per request."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from weftlink.operators import evaluation, search

CHUNK = 1 << 20


def routes(spark: SparkSession, entities: DataFrame, records: DataFrame, matches: DataFrame, matcher=None) -> dict[str, Callable[[dict], dict]]:
    """Path -> function from parameters to a JSON-ready answer; of use without a server, too."""

    def stats(_: dict) -> dict:
        return {"countries": [r.asDict() for r in evaluation.run_summary(records, matches).collect()]}

    def find(q: dict) -> dict:
        rows = search.entity_search(entities, q.get("search", ""), q.get("country", "ALL"), q.get("filter", "ALL")).collect()
        return {"count": len(rows), "entities": [r.asDict(recursive=True) for r in rows]}

    def predict(q: dict) -> dict:
        a, b = {"name": q.get("s1_name"), "address": q.get("s1_addr")}, {"name": q.get("c_name"), "address": q.get("c_addr"), "id": q.get("c_id", "S2-CUSTOM")}
        r = search.explain_pair(spark, matcher, a, b).head().asDict()
        return r | {"features": json.loads(r["features"])}

    return {"/api/stats": stats, "/api/entities": find} | ({"/api/predict": predict} if matcher else {})


KINDS = {".tsv": "text/tab-separated-values", ".zip": "application/zip", ".html": "text/html"}


def serve(answers: dict[str, Callable[[dict], dict]], files: dict[str, str], port: int = 8000, page: str | None = None) -> ThreadingHTTPServer:
    """A server (not started) for ``routes``, for downloads (path -> local file, sent in chunks) and for a page (local file) at its root."""

    class Handler(BaseHTTPRequestHandler):
        def _head(self, status: int, kind: str = "application/json", **more: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, POST, OPTIONS")
            self.send_header("Access-Control-Allow-Headers", "Content-Type")
            for name, value in more.items():
                self.send_header(name.replace("_", "-"), value)
            self.end_headers()

        def _answer(self, path: str, q: dict) -> None:
            if path in ("/", "/index.html") and page and Path(page).is_file():
                return self._send(Path(page))
            if path in files and Path(files[path]).is_file():
                file = Path(files[path])
                return self._send(file, Content_Disposition=f'attachment; filename="{file.name}"')
            try:
                status, body = (200, answers[path](q)) if path in answers else (404, {"error": "not found"})
            except Exception as e:  # the caller gets every failure as an answer
                status, body = 500, {"error": str(e)[:500]}
            self._head(status)
            self.wfile.write(json.dumps(body, default=str).encode())

        def _send(self, file: Path, **more: str) -> None:
            self._head(200, KINDS.get(file.suffix, "application/octet-stream"), **more)
            with open(file, "rb") as f:
                while part := f.read(CHUNK):
                    self.wfile.write(part)

        def do_OPTIONS(self) -> None:
            self._head(200)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            self._answer(url.path, {k: v[0] for k, v in parse_qs(url.query).items()})

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            self._answer(urlparse(self.path).path, json.loads(body or b"{}"))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
