"""Live fetching: retry, backoff and throttle as plain functions, and a per-host fetcher for ``mapInPandas``.

Nothing here runs in a batch over stored pages; ``send`` is injected, so all of it is tested without a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.config import SiteConfig
from siltloom.schemas import RESPONSES


class Response(NamedTuple):
    status: int
    headers: dict[str, str]
    body: str | None = None


def next_wait(headers: dict[str, str], backoff_ms: int) -> int:
    """Milliseconds to wait: Retry-After in digits (seconds) overrides the backoff."""
    value = next((v for k, v in headers.items() if k.lower() == "retry-after"), "")
    return int(value) * 1000 if value.isascii() and value.isdigit() else backoff_ms


def backoff_schedule(delay_ms: int, max_retry: int) -> list[int]:
    """Waits between attempts without Retry-After: from ``delay_ms``, doubled; none after the last attempt."""
    return [delay_ms << i for i in range(max(0, max_retry - 1))]


def request(send: Callable[[str], Response], url: str, config: SiteConfig, sleep: Callable[[float], None] = time.sleep) -> Response | None:
    """Up to ``max_retry`` attempts; a success or a status not to be retried ends them; the last response is given, even an error."""
    response, backoff = None, config.delay_ms
    for attempt in range(config.max_retry):
        last = attempt == config.max_retry - 1
        try:
            response = send(url)
        except OSError:
            headers: dict[str, str] = {}
        else:
            if response.status not in config.retry_status_codes:
                return response
            headers = response.headers
        if not last:
            wait = next_wait(headers, backoff)
            if wait > 0:
                sleep(wait / 1000)
            backoff *= 2
    return response


class Throttle:
    """At least ``delay_ms`` between the starts of requests to one host; urls without a host are not held up."""

    def __init__(self, delay_ms: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.delay, self.clock, self.sleep = delay_ms / 1000, clock, sleep
        self.last: dict[str, float] = {}

    def wait(self, url: str) -> None:
        host = urlsplit(url).hostname
        if not host or self.delay <= 0:
            return
        if host in self.last and (rest := self.last[host] + self.delay - self.clock()) > 0:
            self.sleep(rest)
        self.last[host] = self.clock()


def fetch_live(urls: DataFrame, config: SiteConfig, make_send: Callable[[str], Callable[[str], Response]]) -> DataFrame:
    """Responses of ``urls``; one host's urls stay in one task, for its throttle to hold. ``make_send(user_agent)`` runs in the task."""

    def run(batches):
        send, throttle = make_send(config.user_agent), Throttle(config.delay_ms)
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                throttle.wait(url)
                try:
                    r = request(send, url, config)
                    rows.append((url, None, None, None, "no response") if r is None else (url, r.status, r.headers.get("Retry-After"), r.body, None))
                except Exception as e:  # one url must not end the run
                    rows.append((url, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESPONSES.split(", ")]).astype({"status": "Int32"})

    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    return urls.select("url").repartition(host).mapInPandas(run, RESPONSES)


class RobotsTexts:
    """robots.txt by url, loaded once each; a failed load is kept as None, which allows everything."""

    def __init__(self, load: Callable[[str], str]):
        self.load = load
        self.known: dict[str, str | None] = {}

    def get(self, url: str | None) -> str | None:
        if not url:
            return None
        if url not in self.known:
            try:
                self.known[url] = self.load(url).strip()
            except Exception:  # an unreadable robots.txt forbids nothing
                self.known[url] = None
        return self.known[url]
