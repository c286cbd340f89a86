"""Connectors as Python data sources. The transport is an option, so that tests read files.

``rest``: paged GET requests that follow a key, with spacing, retries and
back-off. One partition per request list entry; a partition's pages are read one
after another, so that a retried task repeats its own calls only.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = (429, 500, 502, 503, 504)


def fetch_json(url: str, headers: dict[str, str], timeout: float = 60, tries: int = 5, pause: float = 1.0):
    """GET and parse; retries on limits and server errors after the time the server names, or doubling pauses. ``file:`` paths are read."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or k == tries - 1:
                raise
            time.sleep(float(e.headers.get("Retry-After") or pause * 2**k))
    raise RuntimeError("unreachable")


def credential(options: dict, name: str = "api_key", env: str = "MARKET_API_KEY") -> str:
    key = options.get(name) or os.environ.get(env)
    if not key:
        raise RuntimeError(f"no credential: give the option {name} or set {env}")
    return key


class Request(InputPartition):
    def __init__(self, params: dict):
        self.params = params


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        return [Request(p) for p in json.loads(self.options.get("requests", "[{}]"))]

    def read(self, partition) -> Iterator[tuple]:
        o, params, last = self.options, dict(partition.params), 0.0
        headers = {"x-api-key": credential(o)} if o.get("auth") == "key" else {}
        while True:
            wait = float(o.get("spacing", 0)) - (time.time() - last)
            if wait > 0:
                time.sleep(wait)
            last = time.time()
            url = o["url"]
            if not url.startswith("file:") and params:
                url += "?" + urllib.parse.urlencode(params)
            elif url.startswith("file:") and params.get("page"):
                url += f".{params['page']}"
            page = fetch_json(url, headers)
            for row in page.get(o.get("field", "data"), []):
                yield (json.dumps(partition.params), json.dumps(row, ensure_ascii=False))
            follow = page.get(o.get("page_key", "pagination_key"))
            if not follow:
                return
            params[o.get("page_param", "pagination_key")] = follow


class RestSource(DataSource):
    """``spark.read.format("rest")``: (request, record), both JSON text."""

    @classmethod
    def name(cls) -> str:
        return "rest"

    def schema(self) -> str:
        return "request string, record string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)
