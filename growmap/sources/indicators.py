"""A data source for country indicators served as paged JSON, [header, rows].

Batches of country codes are partitions, so fetches run in parallel on the executors. ``base`` is a URL or
a folder with the same pages as files; a failed fetch is repeated with growing pauses.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def chunks(values: list, n: int) -> list[list]:
    return [values[k : k + n] for k in range(0, len(values), n)]


def page_file(base: str, path: str, page: int | str):
    """File system and path of a page in a folder; long paths are named by their digest."""
    from pyarrow import fs

    name = path.replace("/", "_").replace(";", "-")
    name = name if len(name) < 100 else hashlib.sha256(name.encode()).hexdigest()
    base = re.sub(r"^file:/(?!/)", "file:///", base)
    system, root = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
    return system, f"{root}/{name}_p{page}.json"


def write_page(base: str, path: str, page: int, content: list) -> None:
    system, at = page_file(base, path, page)
    system.create_dir(at.rpartition("/")[0])
    with system.open_output_stream(at) as f:
        f.write(json.dumps(content).encode())


def fetch(base: str, path: str, query: dict[str, str], tries: int = 3, pause: float = 1.0):
    for k in range(tries):
        try:
            if base.startswith(("http://", "https://")):
                with urllib.request.urlopen(f"{base}/{path}?{urllib.parse.urlencode(query)}", timeout=60) as r:
                    return json.load(r)
            system, at = page_file(base, path, query["page"])
            with system.open_input_stream(at) as f:
                return json.loads(f.read())
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)


def pages(base: str, path: str, query: dict[str, str] | None = None, **kw) -> Iterator[dict]:
    page, last = 1, 1
    while page <= last:
        got = fetch(base, path, {"format": "json", "per_page": "1000", "page": str(page)} | (query or {}), **kw)
        if len(got) < 2 or not got[1]:
            return
        last = int(got[0].get("pages", 1))
        yield from got[1]
        page += 1


class Part(InputPartition):
    def __init__(self, path: str, indicator: str) -> None:
        self.path, self.indicator = path, indicator


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.base = options["base"]
        self.kind = options.get("kind", "indicator")
        self.codes = [c for c in options.get("codes", "").split(",") if c]
        self.indicators = [c for c in options.get("indicators", "").split(",") if c]
        self.batch, self.tries, self.pause = int(options.get("batch", 20)), int(options.get("tries", 3)), float(options.get("pause", 1.0))

    def partitions(self) -> list[Part]:
        if self.kind == "countries":
            return [Part("country", "")]
        return [Part(f"country/{';'.join(b)}/indicator/{i}", i) for i in self.indicators for b in chunks(self.codes, self.batch)]

    def read(self, part: Part) -> Iterator[tuple]:
        for r in pages(self.base, part.path, tries=self.tries, pause=self.pause):
            if self.kind == "countries":
                region = (r.get("region") or {}).get("value", "")
                if region != "Aggregates":
                    yield r.get("id"), r.get("name"), region
            elif r.get("value") is not None:
                yield part.indicator, r.get("countryiso3code"), (r.get("country") or {}).get("value"), int(r["date"]), float(r["value"])


class IndicatorSource(DataSource):
    """Options: base, kind (countries or indicator), codes, indicators (comma-separated), batch, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "indicators"

    def schema(self) -> str:
        if self.options.get("kind") == "countries":
            return "code string, name string, region string"
        return "indicator string, code string, name string, year int, value double"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_indicators(spark: SparkSession, base: str, codes: list[str], indicators: dict[str, str], **options) -> DataFrame:
    """(code, name, year, a column per indicator): the full outer merge of all series, in one aggregation.
    indicators: code -> column name."""
    from pyspark.sql import functions as F

    spark.dataSource.register(IndicatorSource)
    long = spark.read.format("indicators").options(base=base, codes=",".join(codes), indicators=",".join(indicators), **{k: str(v) for k, v in options.items()}).load()
    values = [F.max(F.when(F.col("indicator") == k, F.col("value"))).alias(v) for k, v in indicators.items()]
    return long.groupBy("code", "name", "year").agg(*values).orderBy("name", "year")


def read_countries(spark: SparkSession, base: str) -> DataFrame:
    spark.dataSource.register(IndicatorSource)
    return spark.read.format("indicators").options(base=base, kind="countries").load()
