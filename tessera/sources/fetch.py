"""Fetching by HTTP with throttle and retries; what opens a url can be replaced."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Callable

RETRIED = (429, 500, 502, 503, 504)


class Fetcher:
    """``get(url)`` returns the bytes, gunzipped.

    At least ``pause`` seconds lie between two requests; what fails for a passing
    reason is tried again after min(2**n, 20) + n / 4 seconds.
    """

    def __init__(self, agent: str, pause: float = 0.25, retries: int = 5, timeout: float = 30, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.agent, self.pause, self.retries, self.timeout = agent, pause, retries, timeout
        self.open, self.sleep, self.clock, self.last = opener or urllib.request.urlopen, sleep, clock, float("-inf")

    def get(self, url: str, accept: str = "*/*") -> bytes:
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": accept, "Accept-Encoding": "gzip"})
        for turn in range(self.retries + 1):
            if (wait := self.last + self.pause - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                with self.open(request, timeout=self.timeout) as answer:
                    body = answer.read()
                return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
            except urllib.error.HTTPError as error:
                if error.code not in RETRIED or turn == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if turn == self.retries:
                    raise
            self.sleep(min(2**turn, 20) + 0.25 * turn)
        raise AssertionError("not reached")
