"""A data source for paged APIs, as batches of landed or fetched pages.

``spark.read.format("paged_api")`` reads records from any service that pages by link, token or
cursor.  What fetches a page is a plain function named by ``fetch`` ("module:function" taking the
page's address and the options, returning (records, next address or None)); ``http_page`` gets them
from a service, ``folder_page`` reads pages landed as JSON files.  ``addresses`` (one for
each repository, project or channel, separated by blanks) are partitions and are read in parallel.

Options of ``http_page``: ``items``, the path of the records in the answer ("" for an answer that is a list);
``paging``, how the next page is known: ``link`` (the Link header), or ``<path in the answer>=<parameter>`` for tokens and
cursors; ``headers``, as JSON, and ``secret``, the name of an environment variable whose value is sent as a bearer's token; ``only``,
as JSON, fields and the values that a record must have; ``children``, as JSON, names and addresses of what hangs on each
record ({field} stands for its fields), fetched page by page and put into the record under the name.
``STORES`` has these for the kinds of services that the engine syncs.
"""

from __future__ import annotations

import importlib
import json
import os
import random
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Retry(Exception):
    """A page that may come later; after: seconds the service asks to wait."""

    def __init__(self, after: float | None = None):
        super().__init__("try again")
        self.after = after


def next_link(header: str | None) -> str | None:
    """The address marked as next in a Link header."""
    m = re.search(r'<([^<>]*)>\s*;\s*rel="?next"?', header or "")
    return m[1] if m else None


def wait_for(attempt: int, after: float | None, most: float = 60.0) -> float:
    """Seconds before another attempt: what the service asks, else doubling with jitter."""
    return min(most, after) if after is not None else min(most, 2.0**attempt) * (0.5 + random.random() / 2)


def folder_page(address: str, options: dict) -> tuple[list[dict], str | None]:
    """A page landed as a JSON file: {"items": [...], "next": "<file>" or null}."""
    page = json.loads(Path(address).read_text())
    following = page.get("next")
    return page.get("items", []), str(Path(address).with_name(following)) if following else None


#: How the services page, and what hangs on their records. Addresses are given by whoever reads.
STORES = {
    "prs": {"items": "", "paging": "link", "since_field": "updated_at", "order": "desc", "children": {"files": "{url}/files?per_page=100", "comments": "{url}/comments?per_page=100"}},
    "issues": {"items": "", "paging": "link", "since_field": "updated_at", "order": "any", "children": {"comments_list": "{comments_url}?per_page=100"}},
    "tickets": {"items": "issues", "paging": "nextPageToken=nextPageToken", "order": "any"},
    "pages": {"items": "notes", "paging": "nextCursor=cursor", "order": "any"},
    "channels": {"items": "channels", "paging": "response_metadata.next_cursor=cursor", "order": "any"},
    "messages": {"items": "messages", "paging": "response_metadata.next_cursor=cursor", "order": "any"},
    "users": {"items": "members", "paging": "response_metadata.next_cursor=cursor", "order": "any"},
}


def options_of(kind: str, **more) -> dict[str, str]:
    """Options of the data source for a kind of STORES; what is no text is put into JSON."""
    given = {"fetch": "fathomline.sources.pages:http_page"} | STORES[kind] | more
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in given.items()}


def _at(answer, path: str):
    for name in filter(None, path.split(".")):
        answer = answer.get(name) if isinstance(answer, dict) else None
    return answer


def _get(address: str, options: dict) -> tuple[object, str | None]:
    """(answer, Link header) of a service; Retry where it is busy or fails."""
    headers = {"Accept": "application/json"} | json.loads(options.get("headers") or "{}")
    if options.get("secret"):
        headers["Authorization"] = f"Bearer {os.environ[options['secret']]}"
    try:
        with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=float(options.get("timeout", 30))) as r:
            return json.loads(r.read() or b"null"), r.headers.get("Link")
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            after = (e.headers.get("Retry-After") or "").strip()
            raise Retry(float(after) if after.replace(".", "", 1).isdigit() else None) from e
        raise
    except urllib.error.URLError as e:
        raise Retry() from e


def http_page(address: str, options: dict) -> tuple[list[dict], str | None]:
    """One page of a service, with the children of its records."""
    answer, link = _get(address, options)
    items = _at(answer, options.get("items", ""))
    wanted = json.loads(options.get("only") or "{}")
    items = [x for x in items or [] if all(x.get(k) in v for k, v in wanted.items())]
    for name, template in json.loads(options.get("children") or "{}").items():
        for x in items:
            x[name] = list(walk(template.format_map(x), http_page, {k: options[k] for k in ("headers", "secret", "timeout", "tries") if k in options} | {"paging": "link"}))
    paging = options.get("paging", "link")
    if paging == "link":
        return items, next_link(link)
    path, _, parameter = paging.partition("=")
    token = _at(answer, path)
    if not token:
        return items, None
    parts = urllib.parse.urlsplit(address)
    query = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query) if k != parameter] + [(parameter, str(token))]
    return items, urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query)))


def walk(first: str, fetch: Callable, options: dict, pause: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Records of all pages from one address on; stops early at the first record before ``since`` of a list that descends."""
    since, field, tries = options.get("since"), options.get("since_field", "updated_at"), int(options.get("tries", 5))
    at: str | None = first
    while at:
        for attempt in range(tries):
            try:
                items, following = fetch(at, options)
                break
            except Retry as e:
                if attempt + 1 == tries:
                    raise
                pause(wait_for(attempt, e.after))
        for item in items:
            if since and str(item.get(field) or "") < since:
                if options.get("order", "desc") == "desc":
                    return
                continue
            yield item
        at = following


class _Address(InputPartition):
    def __init__(self, address: str):
        self.address = address


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)

    def partitions(self):
        return [_Address(a) for a in self.options["addresses"].split()]

    def read(self, partition):
        module, _, name = self.options.get("fetch", "fathomline.sources.pages:folder_page").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        for item in walk(partition.address, fetch, self.options):
            yield partition.address, json.dumps(item, ensure_ascii=False)


class PagedApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "address string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedApi)
