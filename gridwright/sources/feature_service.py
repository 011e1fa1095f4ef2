"""A paged feature service as a Python data source.

``register(spark)``, then ``spark.read.format("feature_service").option("url", layer).load()``.
Planning asks the service for all object ids; every page of ids is one input partition, fetched with
retries inside its task, so a failed page repeats alone. A page that lacks ids, brings others, or
says that it was cut fails the read."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers after which a request is tried again (fixed values).
RETRY = {408, 425, 429, 500, 502, 503, 504}
SCHEMA = "object_id long, attributes map<string,string>, geometry string"


class ServiceError(RuntimeError):
    """The service answered with an error, too much, or something else than asked for."""


def encoded(params: dict) -> str:
    """Query string: JSON is the default format, booleans are lower case, absent values are left out."""
    full = {"f": "json"} | params
    return urllib.parse.urlencode({k: str(v).lower() if isinstance(v, bool) else v for k, v in full.items() if v is not None})


@dataclass(frozen=True)
class Client:
    timeout: float = 60.0
    retries: int = 3
    backoff: float = 1.0
    most_bytes: int = 64 << 20
    opener: Callable = urllib.request.urlopen
    sleeper: Callable = time.sleep

    def __post_init__(self) -> None:
        if self.timeout <= 0 or self.retries < 0 or self.backoff < 0 or self.most_bytes <= 0:
            raise ValueError("timeout and byte limit must be positive, retries and backoff not negative")

    def fetch(self, url: str, params: dict) -> dict:
        """The JSON object at the url; waits double after each failure that may pass."""
        for attempt in range(self.retries + 1):
            try:
                with self.opener(f"{url}?{encoded(params)}", timeout=self.timeout) as answer:
                    body = answer.read(self.most_bytes + 1)
                if len(body) > self.most_bytes:
                    raise ServiceError(f"{url}: more than {self.most_bytes} bytes")
                found = json.loads(body)
                if not isinstance(found, dict):
                    raise ServiceError(f"{url}: not a JSON object")
                error = found.get("error")
                if not error:
                    return found
                code = error.get("code") if isinstance(error, dict) else None
                if code not in RETRY or attempt == self.retries:
                    raise ServiceError(f"{url}: {error}")
            except urllib.error.HTTPError as e:
                if e.code not in RETRY or attempt == self.retries:
                    raise ServiceError(f"{url}: {e}") from e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if attempt == self.retries:
                    raise ServiceError(f"{url}: {e}") from e
            self.sleeper(self.backoff * 2**attempt)
        raise AssertionError("unreachable")

    def object_ids(self, layer: str, where: str = "1=1", envelope: tuple[float, ...] | None = None, crs: int = 4326) -> list[int]:
        """All ids, sorted; a null list is an empty one."""
        area = {} if envelope is None else {"geometry": ",".join(map(str, envelope)), "geometryType": "esriGeometryEnvelope", "spatialRel": "esriSpatialRelIntersects", "inSR": crs}
        ids = self.fetch(f"{layer}/query", {"where": where, "returnIdsOnly": True} | area).get("objectIds")
        if ids is None:
            return []
        if not isinstance(ids, list) or not all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
            raise ServiceError(f"{layer}: ids are not a list of whole numbers")
        return sorted(ids)

    def page(self, layer: str, ids: list[int], out_crs: int = 4326) -> list[dict]:
        """The features of just these ids, each once, in the coordinates asked for."""
        found = self.fetch(f"{layer}/query", {"objectIds": ",".join(map(str, ids)), "outFields": "*", "returnGeometry": True, "outSR": out_crs})
        if found.get("exceededTransferLimit"):
            raise ServiceError(f"{layer}: the page was cut")
        crs = found.get("spatialReference") or {}
        if crs.get("latestWkid", crs.get("wkid")) not in (None, out_crs):
            raise ServiceError(f"{layer}: coordinates in {crs}")
        features = found.get("features")
        if not isinstance(features, list):
            raise ServiceError(f"{layer}: no list of features")
        if sorted(filter(None.__ne__, map(object_id, features))) != sorted(ids) or len(features) != len(ids):
            raise ServiceError(f"{layer}: other features than asked for")
        return features


def object_id(feature: dict) -> int | None:
    for name, value in (feature.get("attributes") or {}).items():
        if name.lower() == "objectid" and isinstance(value, int) and not isinstance(value, bool):
            return value
    return None


@dataclass
class Page(InputPartition):
    ids: list[int]


class Reader(DataSourceReader):
    def __init__(self, options: dict, client: Client):
        self.layer, self.client = options["url"].rstrip("/"), client
        self.size, self.where = int(options.get("pagesize", 200)), options.get("where", "1=1")
        self.envelope = tuple(map(float, options["envelope"].split(","))) if "envelope" in options else None
        self.crs = int(options.get("crs", 4326))

    def partitions(self) -> list[InputPartition]:
        ids = self.client.object_ids(self.layer, self.where, self.envelope, self.crs)
        if len(set(ids)) != len(ids):
            raise ServiceError(f"{self.layer}: an id comes twice")
        return [Page(ids[i : i + self.size]) for i in range(0, len(ids), self.size)] or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.ids:
            for f in self.client.page(self.layer, partition.ids, self.crs):
                yield object_id(f), {k: None if v is None else str(v) for k, v in f["attributes"].items()}, json.dumps(f.get("geometry"))


class FeatureService(DataSource):
    """Options: url, where, envelope (west,south,east,north), crs, pagesize."""

    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()}, Client())


_SYSTEM = "struct<wkid:int,latestWkid:int>"
METADATA = f"id int, name string, geometryType string, spatialReference {_SYSTEM}, extent struct<spatialReference:{_SYSTEM}>, layers array<struct<id:int,name:string,geometryType:string>>"


def service_metadata(urls: DataFrame, client: Client | None = None) -> DataFrame:
    """url and METADATA of urls(url): what each service says of itself, asked in a task with the client's retries."""
    ask = client or Client()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "body": [json.dumps(ask.fetch(url.rstrip("/"), {})) for url in frame["url"]]})

    found = urls.select("url").mapInPandas(each, "url string, body string")
    return found.select("url", F.from_json("body", METADATA, {"mode": "FAILFAST"}).alias("m")).select("url", "m.*")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureService)
