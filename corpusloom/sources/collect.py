"""A Spark data source for services that hand out their records page by page.

One partition reads one query. How a service pages (cursor, offset, page number or token), which statuses are tried
again and how long is waited are options; the transport is a function of the caller, so that nothing here opens a connection
by itself.
"""

from __future__ import annotations

import email.utils
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Statuses worth another try, and the shape of a collected hit.
AGAIN = (408, 425, 429, 500, 502, 503, 504)
ENVELOPE = "schema_version string, source string, query_id string, record_ordinal long, retrieved_at_utc string, request_id string, raw_format string, raw_record string"


@dataclass(frozen=True)
class Reply:
    status: int
    body: Any
    headers: dict[str, str] = field(default_factory=dict)


def retry_after(value: str | None, now: datetime | None = None) -> float | None:
    """Seconds to wait by a Retry-After header: a number, an HTTP date or an ISO time; None if it is none of them."""
    if not value or not value.strip():
        return None
    text, now = value.strip(), now or datetime.now(timezone.utc)
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    for read in (email.utils.parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            when = read(text)
        except (TypeError, ValueError):
            continue
        return max(0.0, ((when if when.tzinfo else when.replace(tzinfo=timezone.utc)) - now).total_seconds())
    return None


def pause(attempt: int, asked: float | None, least: float = 0.25, most: float = 30.0) -> float:
    """Seconds before the next try: what the service asks for, else doubling from the least; both clamped."""
    return min(most, max(least, asked if asked is not None else least * 2**attempt))


def fetch(send: Callable[[dict], Reply], request: dict, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """One request, tried again for passing troubles."""
    for attempt in range(tries):
        reply = send(request)
        if reply.status < 400:
            return reply
        if reply.status not in AGAIN or attempt == tries - 1:
            break
        sleep(pause(attempt, retry_after(reply.headers.get("Retry-After"))))
    raise RuntimeError(f"status {reply.status} after {attempt + 1} tries")


@dataclass(frozen=True)
class Service:
    """style: cursor (next cursor from the reply), token (same, absent at first), offset or page (counted here).

    records and total: dotted paths in a reply; next: the path of the next cursor; key: path in a record that must not
    repeat; stable_total: whether the total must not change from page to page; page_size may only be lowered. window: how
    many records of one query the service gives at all; a query with more must be split.
    """

    name: str
    style: str
    records: str
    next: str = ""
    total: str = ""
    key: str = ""
    parameter: str = "cursor"
    first: Any = "*"
    size_parameter: str = "per_page"
    page_size: int = 100
    stable_total: bool = False
    cap: int | None = None
    window: int | None = None

    def lowered(self, page_size: int) -> Service:
        if not 0 < page_size <= self.page_size:
            raise ValueError("a page size may only be lowered")
        from dataclasses import replace

        return replace(self, page_size=page_size)


def _at(body: Any, path: str) -> Any:
    for name in filter(None, path.split(".")):
        body = body.get(name) if isinstance(body, dict) else None
    return body


def pages(service: Service, query: dict, send: Callable[[dict], Reply], **how) -> Iterator[list[Any]]:
    """Records of one query, page by page, until a page is empty, the total is reached or the cap is."""
    place = service.first if service.style == "cursor" else None if service.style == "token" else 0 if service.style == "offset" else 1
    got, total, seen = 0, None, set()
    while True:
        request = dict(query) | {service.size_parameter: service.page_size} | ({} if place is None else {service.parameter: place})
        body = fetch(send, request, **how).body
        records = _at(body, service.records) or []
        now = _at(body, service.total) if service.total else None
        if service.stable_total and total is not None and now != total:
            raise RuntimeError("the total changed while pages were read")
        total = now
        if service.window is not None and total is not None and total > service.window:
            raise RuntimeError(f"{total} records, of which the service gives {service.window}")
        if service.cap is not None:
            records = records[: service.cap - got]
        if service.key:
            keys = [_at(r, service.key) for r in records]
            if len(set(keys)) < len(keys) or seen & set(keys):
                raise RuntimeError("a record came twice")
            seen |= set(keys)
        got += len(records)
        if records:
            yield records
        following = _at(body, service.next) if service.next else None
        done = not records or (service.cap is not None and got >= service.cap) or (total is not None and got >= total)
        if done or (service.style in ("cursor", "token") and not following):
            return
        place = following if service.style in ("cursor", "token") else got if service.style == "offset" else place + 1


def preflight_counts(service: Service, queries: list[tuple[str, dict]], send: Callable[[dict], Reply], **how) -> dict[str, int]:
    """Records that the service has for each query, by one request of the smallest page."""
    out = {}
    for name, query in queries:
        body = fetch(send, dict(query) | {service.size_parameter: 1} | ({service.parameter: service.first} if service.style == "cursor" else {}), **how).body
        out[name] = int(_at(body, service.total) or 0)
    return out


# Services, with the names that their interfaces use.
SERVICES = {
    s.name: s
    for s in (
        Service("openalex", "cursor", "results", next="meta.next_cursor", total="meta.count", key="id", size_parameter="per-page", page_size=200),
        Service("europepmc", "cursor", "resultList.result", next="nextCursorMark", total="hitCount", parameter="cursorMark", size_parameter="pageSize", page_size=1000),
        Service("crossref", "cursor", "message.items", next="message.next-cursor", total="message.total-results", key="DOI", size_parameter="rows", page_size=1000),
        Service("semantic_scholar", "token", "data", next="token", total="total", key="paperId", parameter="token", size_parameter="limit", page_size=1000),
        Service("core", "offset", "results", total="totalHits", key="id", parameter="offset", size_parameter="limit", page_size=100),
        Service("doaj", "page", "results", total="total", key="id", parameter="page", size_parameter="pageSize", page_size=100),
        Service("pubmed", "offset", "articles", total="count", parameter="retstart", size_parameter="retmax", page_size=500, window=9999),
        Service("scopus", "offset", "search-results.entry", total="search-results.opensearch:totalResults", key="eid", parameter="start", size_parameter="count", page_size=25, stable_total=True, window=5000),
    )
}


def pubmed_query(query: dict, send: Callable[[dict], Reply], **how) -> dict:
    """The query as a place in the service's history: searched once, then fetched by its web environment and key."""
    found = fetch(send, dict(query) | {"db": "pubmed", "retmode": "json", "retmax": 0, "usehistory": "y"}, **how).body.get("esearchresult", {})
    return {"db": "pubmed", "WebEnv": found.get("webenv", ""), "query_key": found.get("querykey", ""), "retmode": "xml", "count": int(found.get("count", 0))}


def pubmed_reply(query: dict, send: Callable[[dict], Reply]) -> Callable[[dict], Reply]:
    """``send`` for pages of a history: articles of the fetched XML as texts, with the count that the search gave."""
    from .tables import xml_fragments_of

    def reply(request: dict) -> Reply:
        got = send(request)
        if got.status != 200:
            return got
        return Reply(got.status, {"articles": xml_fragments_of(got.body, ("PubmedArticle", "PubmedBookArticle")), "count": query["count"]}, got.headers)

    return reply


def collect(spark: SparkSession, service: Service, queries: list[tuple[str, dict]], send: Callable[[dict], Reply], retrieved_at: str, **how) -> DataFrame:
    """Envelopes of all records of the queries; each query is read by a task of its own."""
    asked = spark.createDataFrame([(i, json.dumps(q)) for i, q in queries], "query_id string, query string").repartition(max(1, len(queries)), "query_id")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for query_id, query in zip(pdf["query_id"], pdf["query"]):
                at = 0
                for n, page in enumerate(pages(service, json.loads(query), send, **how)):
                    yield pd.DataFrame({
                        "schema_version": "1", "source": service.name, "query_id": query_id, "record_ordinal": range(at, at + len(page)), "retrieved_at_utc": retrieved_at,
                        "request_id": f"{service.name}-{query_id}-{n:05d}", "raw_format": ["xml" if isinstance(r, str) else "json" for r in page],
                        "raw_record": [json.dumps({"xml": r} if isinstance(r, str) else r, ensure_ascii=False, sort_keys=True) for r in page],
                    })
                    at += len(page)

    return asked.mapInPandas(run, ENVELOPE)
