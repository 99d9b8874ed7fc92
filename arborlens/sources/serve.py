"""The read surface: every query as pages of JSON, over HTTP or called directly, with hooks around reads.

A page is cut by Spark in the query's own order of columns, so a reader holds as many rows as it asked for, not the result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

#: The largest page.
MOST = 1000


def read(spark: SparkSession, folder: str, queries: dict[str, Callable], name: str, offset: int = 0, limit: int = 100, hooks: tuple[Callable, ...] = ()) -> dict:
    """A page of a query: {"query", "columns", "total", "offset", "rows"}. Each hook is asked first and may refuse by raising PermissionError."""
    if name not in queries:
        raise KeyError(name)
    for hook in hooks:
        hook(name)
    df = queries[name](spark, folder)
    limit = MOST if limit < 0 else min(limit or 100, MOST)
    page = df.orderBy(*df.columns).offset(max(0, offset)).limit(limit)
    return {"query": name, "columns": df.columns, "total": df.count(), "offset": max(0, offset), "rows": [json.loads(x) for x in page.toJSON().collect()]}


def server(spark: SparkSession, folder: str, queries: dict[str, Callable], port: int = 0, hooks: tuple[Callable, ...] = ()) -> ThreadingHTTPServer:
    """An HTTP server on this machine: GET / lists the queries, GET /<query>?offset=&limit= gives a page. Call serve_forever on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            asked = {k: int(v[0]) for k, v in parse_qs(url.query).items() if k in ("offset", "limit") and v[0].lstrip("-").isdigit()}
            try:
                body, status = ({"queries": sorted(queries)} if url.path == "/" else read(spark, folder, queries, url.path.strip("/"), hooks=hooks, **asked)), 200
            except KeyError:
                body, status = {"error": "no such query"}, 404
            except PermissionError as e:
                body, status = {"error": str(e)}, 403
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
