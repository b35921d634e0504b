"""Lookups on the web behind protocols. Each has a source that finds nothing; online ones get their transport from the caller."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schemas import BIB_RECORDS, SEARCH_RESULTS

#: Takes (method, address, parameters, headers) and returns decoded JSON, or None for no answer.
Transport = Callable[[str, str, dict[str, Any], dict[str, str]], Any]
SNIPPET = 800


class WebSearch(Protocol):
    name: str
    available: bool

    def search(self, query: str, most: int) -> list[dict[str, str]]: ...


class NoWebSearch:
    name, available = "none", False

    def search(self, query: str, most: int) -> list[dict[str, str]]:
        return []


class HttpSearch:
    """A search service: how to ask it and where its answer holds the results. Any failure is an empty answer."""

    available = True
    #: Of each service its method, address, the list in its answer and the names of title, address and snippet.
    SERVICES = {
        "tavily": ("POST", "https://api.tavily.com/search", ("results",), ("title", "url", "content")),
        "brave": ("GET", "https://api.search.brave.com/res/v1/web/search", ("web", "results"), ("title", "url", "description")),
        "searxng": ("GET", "", ("results",), ("title", "url", "content")),
    }

    def __init__(self, name: str, transport: Transport, key: str = "", address: str = ""):
        self.name, self.transport, self.key = name, transport, key
        self.method, default, self.where, self.names = self.SERVICES[name]
        self.address = address or default

    def search(self, query: str, most: int) -> list[dict[str, str]]:
        ask = {"tavily": {"query": query, "max_results": most}, "brave": {"q": query, "count": most}, "searxng": {"q": query, "format": "json"}}[self.name]
        head = {"tavily": {"Authorization": f"Bearer {self.key}"}, "brave": {"X-Subscription-Token": self.key}}.get(self.name, {})
        try:
            found = self.transport(self.method, self.address, ask, head)
            for part in self.where:
                found = (found or {}).get(part)
        except Exception:  # noqa: BLE001  a search that fails finds nothing
            return []
        title, url, text = self.names
        return [{"title": x.get(title) or "", "url": x.get(url) or "", "snippet": (x.get(text) or "")[:SNIPPET]} for x in (found or [])[:most]]


def web_search(name: str, transport: Transport | None, env: dict[str, str], address: str = "") -> WebSearch:
    """The named service, or none where it lacks a key, an address or a transport."""
    key = env.get({"tavily": "TAVILY_API_KEY", "brave": "BRAVE_API_KEY"}.get(name, ""), "")
    usable = transport is not None and name in HttpSearch.SERVICES and (address if name == "searxng" else key)
    return HttpSearch(name, transport, key, address) if usable else NoWebSearch()


def search_all(queries: DataFrame, make: Callable[[], WebSearch], most: int = 5, pause_s: float = 0.0) -> DataFrame:
    """Results of distinct queries(query). The pause holds in each partition, so the rate follows from their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = []
            for q in b["query"]:
                rows += [(q, i, r["title"], r["url"], r["snippet"]) for i, r in enumerate(client.search(q, most), 1)]
                time.sleep(pause_s)
            yield pd.DataFrame(rows, columns=["query", "rank", "title", "url", "snippet"])

    return queries.select("query").where("query <> ''").distinct().mapInPandas(run, SEARCH_RESULTS)


def lookup_all(refs: DataFrame, transport: Transport, base: str, kind: str, pause_s: float = 0.15, rows: int = 5) -> DataFrame:
    """(asked, rank, item) with item a variant: what a bibliographic service says of distinct keys of refs. kind 'doi' asks for
    one work by refs.doi, 'text' searches by refs.query, and 'title' asks a service of open records for refs.query."""
    key = "doi" if kind == "doi" else "query"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            out = []
            for asked in b["asked"]:
                try:
                    if kind == "doi":
                        found = [((transport("GET", f"{base}/{asked.strip().rstrip('.')}", {}, {}) or {}).get("message"))]
                    elif kind == "title":
                        found = (transport("GET", base, {"search": asked[:300], "per-page": 3}, {}) or {}).get("results") or []
                    else:
                        answer = transport("GET", base, {"query.bibliographic": asked[:400], "rows": rows}, {}) or {}
                        found = (answer.get("message") or {}).get("items") or []
                except Exception:  # noqa: BLE001  a lookup that fails finds nothing
                    found = []
                out += [(asked, i, json.dumps(x)) for i, x in enumerate(found, 1) if x]
                time.sleep(pause_s)
            yield pd.DataFrame(out, columns=["asked", "rank", "json"])

    asked = refs.select(F.col(key).alias("asked")).where("asked is not null and asked <> ''").distinct()
    return asked.mapInPandas(run, "asked string, rank int, json string").select("asked", "rank", F.parse_json("json").alias("item"))


def no_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BIB_RECORDS)


def no_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SEARCH_RESULTS)
