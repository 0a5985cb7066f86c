"""Paged catalogues and feature services as a data source.

`format("feature_service")` reads scenes, granules or deposits page by page. Comparisons of days, cloud and box edges go to the
service as its own parameters, and the reader holds the records to them again, so a service that knows none of them (a folder of saved
pages) gives the same rows. Where the first page tells how many records match, there is a partition a page; else `streams`
partitions read every `streams`-th page each until one comes short. The parser goes by the content: JSON, or XML of features.

Options: kind (scenes, granules, deposits), url, pageSize, streams, limitPages, layer and version, fetch (`module:function`, which
takes an address and parameters and returns content type and bytes; it must be importable on the executors), onError (`raise`, or
`empty`: a page that cannot be had is empty).
"""

from __future__ import annotations

import datetime
import importlib
import json
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..operators.shared import ship

_BOX = [("west", pa.float64()), ("south", pa.float64()), ("east", pa.float64()), ("north", pa.float64())]
KINDS = {
    "scenes": pa.schema([("scene_id", pa.string()), ("day", pa.date32()), ("cloud", pa.float64()), *_BOX, ("assets", pa.map_(pa.string(), pa.string()))]),
    "granules": pa.schema([("granule_id", pa.string()), ("day", pa.date32()), ("version", pa.string()), *_BOX, ("links", pa.list_(pa.struct([("href", pa.string()), ("rel", pa.string())])))]),
    "deposits": pa.schema([("name", pa.string()), ("commodity", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("deposit_type", pa.string())]),
}
_BOX_DDL = "west double, south double, east double, north double"
DDL = {
    "scenes": f"scene_id string, day date, cloud double, {_BOX_DDL}, assets map<string, string>",
    "granules": f"granule_id string, day date, version string, {_BOX_DDL}, links array<struct<href: string, rel: string>>",
    "deposits": "name string, commodity string, latitude double, longitude double, deposit_type string",
}
#: Columns whose comparisons go to the service.
PUSHED = {"scenes": ("day", "cloud", "west", "south", "east", "north"), "granules": ("day", "version", "west", "south", "east", "north"), "deposits": ("latitude", "longitude")}
HOLDS: dict[type, Callable] = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, IsNotNull: lambda a, b: True,
}


class Condition(NamedTuple):
    kind: type
    column: str
    value: object

    def holds(self, record: dict) -> bool:
        have = record.get(self.column)
        return have is not None and HOLDS[self.kind](have, self.value)


def fetch_http(url: str, params: dict) -> tuple[str, bytes]:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=120) as answer:  # noqa: S310  the address is the caller's
        return answer.headers.get("Content-Type", ""), answer.read()


def fetch_folder(url: str, params: dict) -> tuple[str, bytes]:
    """Saved pages: page-1.json or page-1.xml and so on in the folder `url`; an empty page where there is none."""
    for kind in ("json", "xml"):
        path = Path(url) / f"page-{params['page']}.{kind}"
        if path.exists():
            return f"application/{kind}", path.read_bytes()
    return "application/json", b"{}"


def _edge(conditions: list[Condition], column: str, upper: bool):
    kinds = (EqualTo, LessThan, LessThanOrEqual) if upper else (EqualTo, GreaterThan, GreaterThanOrEqual)
    values = [c.value for c in conditions if c.column == column and c.kind in kinds]
    return (min(values) if upper else max(values)) if values else None


def parameters(kind: str, conditions: list[Condition], page: int, size: int, layer: str = "", version: str = "") -> dict:
    """The service's own parameters for a page under the conditions."""
    low, high = (lambda c: _edge(conditions, c, False)), (lambda c: _edge(conditions, c, True))
    if kind == "deposits":
        box = (low("longitude"), low("latitude"), high("longitude"), high("latitude"))
    else:
        box = (low("east"), low("north"), high("west"), high("south"))  # what meets the box ends after it begins
    edges = ",".join(f"{v if v is not None else whole:g}" for v, whole in zip(box, (-180, -90, 180, 90), strict=True))
    first, last = (low("day"), high("day")) if kind != "deposits" else (None, None)
    out = {"page": page}
    if kind == "scenes":
        out |= {"collections": layer, "limit": size, "bbox": edges, "sortby": "eo:cloud_cover"}
        if first or last:
            out["datetime"] = f"{first or '..'}/{last or '..'}"
        if (most := high("cloud")) is not None:
            out["query"] = json.dumps({"eo:cloud_cover": {"lte": most}})
    elif kind == "granules":
        wanted = next((c.value for c in conditions if c.column == "version" and c.kind is EqualTo), version)
        out |= {"short_name": layer, "version": wanted, "page_size": size, "page_num": page, "bounding_box": edges, "sort_key": "-start_date"}
        if first or last:
            out["temporal"] = f"{f'{first}T00:00:00Z' if first else ''},{f'{last}T23:59:59Z' if last else ''}"
    else:
        out |= {"service": "WFS", "version": version or "1.1.0", "request": "GetFeature", "typeName": layer, "bbox": edges, "outputFormat": "application/json", "startIndex": (page - 1) * size, "maxFeatures": size}
    return {k: v for k, v in out.items() if v != ""}


def _day(text: str | None) -> datetime.date | None:
    return datetime.date.fromisoformat(text[:10]) if text else None


def _number(text: object) -> float | None:
    try:
        return float(text)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _field(names: dict, part: tuple[str, ...], last: bool) -> str | None:
    """The value of the first (or last) name that has one of the parts in it."""
    hits = [v for k, v in names.items() if any(p in k.lower() for p in part)]
    return (str(hits[-1 if last else 0]) if hits and hits[-1 if last else 0] is not None else None) if hits else None


def _deposit(names: dict, latitude: float | None, longitude: float | None) -> dict:
    return {"name": _field(names, ("name",), False), "commodity": _field(names, ("commod",), True), "deposit_type": _field(names, ("dep_type", "deposit"), True), "latitude": latitude, "longitude": longitude}


def _scene(x: dict) -> dict:
    p, box = x.get("properties") or {}, x.get("bbox") or [None] * 4
    assets = {k: (v or {}).get("href") for k, v in (x.get("assets") or {}).items()}
    return {"scene_id": x.get("id"), "day": _day(p.get("datetime")), "cloud": _number(p.get("eo:cloud_cover")), **dict(zip(("west", "south", "east", "north"), box, strict=False)), "assets": list(assets.items())}


def _granule(x: dict) -> dict:
    corners = [[float(v) for v in b.split()] for b in x.get("boxes") or ()]  # south, west, north, east
    box = {"south": min(c[0] for c in corners), "west": min(c[1] for c in corners), "north": max(c[2] for c in corners), "east": max(c[3] for c in corners)} if corners else {}
    version = x.get("version_id") or x.get("version")
    return {"granule_id": x.get("title") or x.get("id"), "day": _day(x.get("time_start")), "version": version, **box, "links": [{"href": k.get("href"), "rel": k.get("rel")} for k in x.get("links") or ()]}


def parse(kind: str, content: str, body: bytes) -> tuple[int, list[dict], int | None]:
    """(records on the page, the usable ones, how many match in all if the page tells) of a page."""
    if "json" not in content and not body.lstrip().startswith(b"{"):
        records, n = [], 0
        for member in ElementTree.fromstring(body).iter():  # noqa: S314  expat expands no external entities
            if member.tag.rpartition("}")[2] not in ("featureMember", "member"):
                continue
            n += 1
            names = {e.tag.rpartition("}")[2]: (e.text or "").strip() or None for e in member.iter() if not len(e)}
            place = [_number(next((v for k, v in names.items() if k.lower() in keys), None)) for keys in (("latitude", "lat"), ("longitude", "lon", "long"))]
            if None in place and len(at := (names.get("pos") or "").split()) >= 2:
                place = [_number(at[0]), _number(at[1])]
            records.append(_deposit(names, *place))
        return n, [r for r in records if r["latitude"] is not None and r["longitude"] is not None], None
    data = json.loads(body or b"{}")
    if kind == "granules":
        listed = (data.get("feed") or {}).get("entry") or []
        return len(listed), [_granule(x) for x in listed], data.get("hits")
    listed = data.get("features") or []
    total = data.get("numberMatched", (data.get("context") or {}).get("matched"))
    total = total if isinstance(total, int) else None
    if kind == "scenes":
        return len(listed), [_scene(x) for x in listed], total
    records = []
    for x in listed:
        at = (x.get("geometry") or {}).get("coordinates") or [None, None]
        records.append(_deposit(x.get("properties") or {}, _number(at[1]), _number(at[0])))
    return len(listed), [r for r in records if r["latitude"] is not None and r["longitude"] is not None], total


class _Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.url = options["kind"], options["url"]
        self.size, self.streams, self.last = int(options.get("pageSize", 200)), int(options.get("streams", 8)), int(options.get("limitPages", 1 << 31))
        self.layer, self.version, self.lenient = options.get("layer", ""), options.get("version", ""), options.get("onError", "raise") == "empty"
        module, _, name = options.get("fetch", "lodestrata.sources.services:fetch_http").partition(":")
        self.module, self.name = module, name
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in HOLDS and len(f.attribute) == 1 else None
            if column in PUSHED[self.kind]:
                self.conditions.append(Condition(type(f), column, getattr(f, "value", None)))
            else:
                yield f

    def _page(self, page: int) -> tuple[int, list[dict], int | None]:
        fetch = getattr(importlib.import_module(self.module), self.name)
        try:
            return parse(self.kind, *fetch(self.url, parameters(self.kind, self.conditions, page, self.size, self.layer, self.version)))
        except Exception:
            if self.lenient:
                return 0, [], None
            raise

    def partitions(self) -> list[_Pages]:
        total = self._page(1)[2]
        if total is None:
            return [_Pages(k + 1, self.streams) for k in range(min(self.streams, self.last))]
        return [_Pages(k + 1, 0) for k in range(min(self.last, max(1, -(-total // self.size))))]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        page = partition.first
        while page <= self.last:
            n, records, _ = self._page(page)
            kept = [r for r in records if all(c.holds(r) for c in self.conditions)]
            yield pa.RecordBatch.from_pylist(kept, schema=KINDS[self.kind])
            if n < self.size or not partition.step:
                return
            page += partition.step


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_service"

    def schema(self) -> str:
        return DDL[self.options["kind"]]

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(self.options)


def read_service(spark: SparkSession, kind: str, url: str, **options: object) -> DataFrame:
    """Scenes, granules or deposits of a service; filters on what it can search by are pushed to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ServiceSource)
    return spark.read.format("feature_service").options(kind=kind, url=url, **{k: str(v) for k, v in options.items()}).load()


def in_box(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose place (latitude, longitude) lies in the box (west, south, east, north)."""
    w, s, e, n = box
    return rows.where(f"longitude >= {w}d and longitude <= {e}d and latitude >= {s}d and latitude <= {n}d")


def save_pages(features: DataFrame, size: int, folder: str) -> str:
    """Writes features (at, feature as JSON) as pages of `size` to `folder`, which all executors see, for `fetch_folder`; returns it.

    Rows are dealt by ranges of `at`, so a page's rows are neighbours; a range's last page may be short, and pages are numbered
    so that only the last is.
    """
    from pyspark.sql import functions as F

    Path(folder).mkdir(parents=True, exist_ok=True)
    spark = features.sparkSession
    ship(spark)
    from ..operators.shared import cut

    ranged = cut(features.repartitionByRange("at").sortWithinPartitions("at").select("feature", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    before, starts = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # a row a partition
        starts.append((part, before))
        before += n
    at = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    paged = ranged.join(at, "part").select("feature", (F.col("start") + F.col("place")).alias("k")).withColumn("page", F.floor(F.col("k") / size) + 1)

    def write(group: pa.Table) -> pa.Table:
        page = group["page"][0].as_py()
        body = '{"features": [' + ", ".join(group.sort_by("k")["feature"].to_pylist()) + "]}"
        part = Path(folder) / f".page-{page}"
        part.write_text(body)
        part.replace(Path(folder) / f"page-{page}.json")
        return pa.table({"page": pa.array([page], pa.int64())})

    paged.groupBy("page").applyInArrow(write, "page long").count()
    return folder
