"""Point records from an HTTP service, as a Spark data source."""

from __future__ import annotations

import hashlib
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from wayfold.operators import blocks
from wayfold.sources.points import split_records


class _Still(urllib.request.HTTPRedirectHandler):
    """No redirect is followed."""

    def redirect_request(self, *args, **kwargs) -> None:
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.most, self.timeout = options["path"], int(options.get("most", 16 << 20)), float(options.get("timeout", 30))

    def read(self, partition) -> Iterator[tuple[str, str, int]]:
        request = urllib.request.Request(self.url, data=b"", method="POST", headers={"Accept": "application/json", "User-Agent": "wayfold"})
        try:
            response = urllib.request.build_opener(_Still, urllib.request.ProxyHandler({})).open(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise ValueError(f"the source answers with status {e.code}") from e
        with response:
            if response.status != 200:
                raise ValueError(f"the source answers with status {response.status}")
            kind = response.headers.get("Content-Type", "").lower()
            if not kind.startswith("application/json"):
                raise ValueError(f"the source answers with type {kind or 'none'}")
            if int(response.headers.get("Content-Length") or 0) > self.most:
                raise ValueError(f"the answer is over {self.most} bytes")
            held = bytearray()
            while part := response.read(64 << 10):
                held += part
                if len(held) > self.most:  # whatever length was declared, no more is read
                    raise ValueError(f"the answer is over {self.most} bytes")
        if not held:
            raise ValueError("the answer is empty")
        yield bytes(held).decode(), hashlib.sha256(held).hexdigest(), len(held)


class PostedJson(DataSource):
    """format("posted_json"): the answer of a service at `path` to an empty POST, one row (value, sha256, bytes); options most (bytes)
    and timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "posted_json"

    def schema(self) -> str:
        return "value string, sha256 string, bytes bigint"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def posted_answer(spark: SparkSession, url: str, most: int = 16 << 20, timeout: float = 30.0) -> DataFrame:
    """(value, sha256, bytes): the answer of the service, read whole by one task. Redirects, other statuses than 200, other types than
    JSON, empty answers and those over `most` bytes are errors; reading stops at that size."""
    blocks.ship(spark)
    spark.dataSource.register(PostedJson)
    return spark.read.format("posted_json").option("most", most).option("timeout", timeout).load(url)


def posted_records(spark: SparkSession, url: str, most: int = 16 << 20, timeout: float = 30.0) -> DataFrame:
    """(record_index, json) of the records that a service answers with, as points.read_point_records() gives them of a file."""
    return split_records(posted_answer(spark, url, most, timeout).select("value"))
