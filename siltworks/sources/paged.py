"""Paginated listings as tables and as streams.

A fetcher is a function (resource, token, filters) -> (rows, next token or None), named as module:function so that executors import it. Token None asks for
the first page. It may raise TryLater, which says after how many seconds to ask again.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, SimpleDataSourceStreamReader

#: What turns the push-down of filters into Python sources on, for sessions that want it.
PUSHDOWN = {"spark.sql.python.filterPushdown.enabled": "true"}

Fetcher = Callable[[str, "str | None", dict], "tuple[Iterable[tuple], str | None]"]


class TryLater(Exception):
    """The listing is busy; after: seconds that it asks to wait, None where it does not say."""

    def __init__(self, after: float | None = None):
        super().__init__(f"try again after {after} s")
        self.after = after


class Listing:
    """Pages of one listing, each asked for until it comes or the retries are used up. The n-th wait is base * backoff**n, or what the
    listing asks for if that is longer."""

    def __init__(self, options: dict, filters: dict | None = None):
        self.retries = int(options.get("retries", "2"))
        self.base, self.backoff = float(options.get("retry_base", "1.0")), float(options.get("retry_backoff", "2.0"))
        if self.retries < 0 or self.base < 0 or self.backoff < 1:
            raise ValueError("retries and their base are not negative, backoff is at least 1")
        self.fetch = self._fetcher(options)
        self.filters = dict(filters or {})

    @staticmethod
    def _fetcher(options: dict) -> Fetcher:
        if "pages" in options:
            pages = json.loads(options["pages"])

            def inline(resource: str, token: str | None, filters: dict) -> tuple[list, str | None]:
                at = int(token or 0)
                return (pages[at] if at < len(pages) else []), (str(at + 1) if at + 1 < len(pages) else None)

            return inline
        if "fetcher" not in options:
            raise ValueError("option fetcher (module:function) or pages is needed")
        module, _, name = options["fetcher"].partition(":")
        return getattr(importlib.import_module(module), name)

    def page(self, resource: str, token: str | None) -> tuple[list[tuple], str | None]:
        for attempt in range(self.retries + 1):
            try:
                rows, after = self.fetch(resource, token, self.filters)
                return [tuple(r) for r in rows], after
            except TryLater as busy:
                if attempt == self.retries:
                    raise
                time.sleep(max(self.base * self.backoff**attempt, busy.after or 0.0))
        raise AssertionError("unreachable")

    def pages(self, resource: str) -> Iterator[list[tuple]]:
        token = None
        while True:
            rows, token = self.page(resource, token)
            yield rows
            if token is None:
                return


class PagedSource(DataSource):
    """Format siltworks_paged. Options: fetcher; resources, a JSON list of listings that are read side by side; filterable, a JSON list of columns whose
    equality the fetcher takes (needs PUSHDOWN); retries, retry_base, retry_backoff; schema. pages (JSON, rows by page) is a listing given in place.

    As a table, each resource is a task that follows its tokens; a task that is lost asks for its own listing again. As a stream, offsets are page
    tokens of the first resource: a batch is a page, and a restart goes on with the page after the last one that was committed.
    """

    @classmethod
    def name(cls) -> str:
        return "siltworks_paged"

    def schema(self) -> str:
        return self.options.get("schema", "id string, title string, content string")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return (_FilteringReader if "filterable" in self.options else _PagedReader)(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _PagedStream(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.filters = options, {}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in json.loads(self.options.get("resources", '[""]'))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rows in Listing(self.options, self.filters).pages(partition.value):
            yield from rows


class _FilteringReader(_PagedReader):
    """Sessions refuse a reader that takes filters unless PUSHDOWN is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equalities on filterable columns go to the fetcher, the rest stay with Spark."""
        takes = json.loads(self.options.get("filterable", "[]"))
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in takes and f.attribute[0] not in self.filters:
                self.filters[f.attribute[0]] = f.value
            else:
                yield f


class _PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.resource = json.loads(options.get("resources", '[""]'))[0]
        self.listing = Listing(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": None, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        rows, token = self.listing.page(self.resource, start["token"])
        return iter(rows), {"token": token, "done": token is None}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        now = start
        while now != end:
            rows, now = self.read(now)
            yield from rows

    def commit(self, end: dict) -> None:
        """Pages need no acknowledgement."""
