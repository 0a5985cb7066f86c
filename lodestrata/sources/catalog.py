"""Scene and granule catalogues, asset keys, links and tile names.

A catalogue is a table; searches are filters that reach its scan. Downloads need a network and are left to a `fetch` function.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_scenes(catalog: DataFrame, box: tuple[float, float, float, float], start: str, end: str, max_cloud: float, limit: int = 100) -> DataFrame:
    """Scenes that meet the box (west, south, east, north) and days, least cloud first; missing cloud counts as 100."""
    w, s, e, n = box
    hit = catalog.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s))
    hit = hit.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.coalesce("cloud", F.lit(100.0)) <= max_cloud))
    return hit.orderBy(F.coalesce("cloud", F.lit(100.0)), "scene_id").limit(limit)


def search_granules(catalog: DataFrame, box: tuple[float, float, float, float], start: str, end: str, version: str, limit: int = 200) -> DataFrame:
    """Granules of a version, the latest first."""
    w, s, e, n = box
    hit = catalog.where((F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s) & (F.col("version") == version))
    return hit.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy(F.desc("day"), "granule_id").limit(limit)


def granule_pages(catalog: DataFrame, box: tuple[float, float, float, float], start: str, end: str, version: str, page: int = 200, pages: int = 10) -> DataFrame:
    """As `search_granules`, with the number of the page on which each granule comes, for up to `pages` pages."""
    found = search_granules(catalog, box, start, end, version, page * pages)
    place = F.row_number().over(Window.orderBy(F.desc("day"), "granule_id"))  # page * pages rows at most
    return found.withColumn("page", (F.floor((place - 1) / page) + 1).cast("int"))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary's rows, or the fallback's where there are none."""
    none = primary.agg((F.count("*") == 0).alias("_none"))
    return primary.unionByName(fallback.crossJoin(F.broadcast(none)).where("_none").drop("_none"))


def asset_key(assets: Column, band: str) -> Column:
    """The key of a band: as it is, in lower case, else the first key that holds it."""
    keys = F.map_keys(assets)
    part = F.try_element_at(F.filter(keys, lambda k: F.lower(k).contains(band.lower())), F.lit(1))
    return F.when(F.array_contains(keys, band), band).when(F.array_contains(keys, band.lower()), band.lower()).otherwise(part)


#: The relations of data links, and endings of files beside the data.
DATA_RELATIONS = ("data#", "enclosure")
SIDE_FILES = r"(?i)\.(xml|jpg|png)$"


def data_links(links: Column) -> Column:
    """The addresses among array<struct<href, rel>> that hold data."""
    good = F.filter(links, lambda k: k["href"].startswith("http") & F.array_join(F.array(*(F.when(k["rel"].endswith(r), "1").otherwise("") for r in DATA_RELATIONS)), "").contains("1") & ~k["href"].rlike(SIDE_FILES))
    return F.transform(good, lambda k: k["href"])


def file_name(url: Column) -> Column:
    """The last part of an address without its query."""
    return F.element_at(F.split(F.split(url, r"\?")[0], "/"), -1)


def download(links: DataFrame, folder: str, fetch: Callable[[str, Path], None] | None = None, tasks: int = 16) -> DataFrame:
    """name, path, state of each different file of `links` (url), fetched once by the tasks.

    `fetch(url, path)` does the transfer into `folder`, which all machines see: to a name of its own first, which then becomes the
    file's, so a file is whole or not there and a task that is run again does no harm. States: "there" before, "fetched", or
    "planned" without `fetch`.
    """
    files = links.select("url", file_name(F.col("url")).alias("name")).groupBy("name").agg(F.min("url").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, url in zip(batch.column("name").to_pylist(), batch.column("url").to_pylist(), strict=True):
                path, state = Path(folder) / name, "planned"
                if path.exists():
                    state = "there"
                elif fetch is not None:
                    part = path.with_name(f".{name}.{uuid.uuid4().hex}")
                    try:
                        fetch(url, part)
                        part.replace(path)
                    finally:
                        part.unlink(missing_ok=True)
                    state = "fetched"
                rows.append((name, str(path), state))
            yield pa.RecordBatch.from_pydict(dict(zip(("name", "path", "state"), zip(*rows, strict=True), strict=True)) if rows else {"name": [], "path": [], "state": []}, schema=pa.schema([(c, pa.string()) for c in ("name", "path", "state")]))

    return files.repartition(tasks, "name").mapInArrow(run, "name string, path string, state string")


def tile_names(boxes: DataFrame) -> DataFrame:
    """A row for each elevation tile that a box (west, south, east, north) meets: lat, lon of its corner and its name."""
    whole = lambda c: F.floor(c).cast("int")
    t = boxes.withColumn("lat", F.explode(F.sequence(whole("south"), whole("north")))).withColumn("lon", F.explode(F.sequence(whole("west"), whole("east"))))
    ns, ew = F.when(F.col("lat") >= 0, "N").otherwise("S"), F.when(F.col("lon") >= 0, "E").otherwise("W")
    return t.withColumn("tile", F.format_string("%s%02d%s%03d", ns, F.abs("lat"), ew, F.abs("lon")))


def band_file(files: DataFrame, band: str, prefix: str) -> DataFrame:
    """The file (path) of a band: its exact name, else the first that matches."""
    name = F.element_at(F.split("path", "/"), -1)
    exact, like = name == f"{prefix}_{band}.tif", name.rlike(f"(?i){prefix}.*{band}")
    return files.where(exact | like).orderBy(F.when(exact, 0).otherwise(1), "path").limit(1)
