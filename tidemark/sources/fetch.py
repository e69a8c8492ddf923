"""Bodies of web addresses as rows, fetched with retries where the tasks run."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.error import HTTPError

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that another attempt can't change.
FINAL = frozenset([400, 401, 403, 404, 405, 410])


def fetch(url: str, *, timeout: float = 60.0, retries: int = 3, wait: float = 1.5, open_: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of ``url``.  A failed attempt is repeated after a pause that grows with each; a final answer is not."""
    for attempt in range(1, retries + 1):
        try:
            with open_(urllib.request.Request(url, headers={"User-Agent": "tidemark"}), timeout=timeout) as answer:
                return answer.read()
        except Exception as x:
            if attempt == retries or (isinstance(x, HTTPError) and x.code in FINAL):
                raise ConnectionError(f"{url}: {type(x).__name__}: {x}") from x
            sleep(wait * attempt)
    raise ValueError("retries must be positive")


class Web(DataSource):
    """``spark.read.format("web").option("urls", "a b").load()``: rows ``url, body``, one partition for each address.

    Options: ``urls`` (between blanks), ``timeout``, ``retries``, ``wait`` (seconds).
    """

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "url string, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", options.get("path", "")).split()
        self.rule = {"timeout": float(options.get("timeout", 60)), "retries": int(options.get("retries", 3)), "wait": float(options.get("wait", 1.5))}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, fetch(partition.value, **self.rule)


def register(spark) -> None:
    spark.dataSource.register(Web)
