"""The public surface: register sources, measure polygons, run batch jobs, build summaries and snapshots."""

from __future__ import annotations

import asyncio
import json
import struct
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Grid, Options, RequestError, fields, require
from gridloom.operators import coverage, cumulative, ordered, spherical, summaries, zonal
from gridloom.operators import geometry as G
from gridloom.plans import policy, profile
from gridloom.plans.batch import Job, Source as JobSource
from gridloom.sources import files, geotiff, netcdf, raster, snapshot

# How many of each kind a session holds.
CAPACITY = {"sources": 128, "plans": 128, "jobs": 8, "indexes": 16}


@dataclass
class Source:
    """A registered raster: its grid, its cells and, if prepared, its summary.

    attributes: nodata, scale, offset, and whether an explicit mask was given. file: what the file was when it was registered.
    """

    session: Session
    name: str
    grid: Grid
    cells: DataFrame
    identity: str
    band_count: int
    raw: DataFrame | None = None
    attributes: dict | None = None
    file: files.Identity | None = None
    summary: DataFrame | None = None
    edge: int = 64
    levels: int = 0
    build_id: str | None = None
    prepared: dict = field(default_factory=dict)

    def info(self) -> dict:
        return {"id": self.name, "grid": self.grid.record(), "source_id": self.identity, "bands": self.band_count, "prepared": self.summary is not None, "index_build_id": self.build_id, "structures": sorted(self.prepared)}

    def metrics(self) -> dict:
        """Facts about the source's plan, without running it."""
        return {"id": self.name, "partitions": self.cells.rdd.getNumPartitions(), "file": None if self.file is None else {"length": self.file.length, "modified": self.file.modified}}

    def _selection(self, zone: dict | str, strategy: str = "scanline") -> tuple[DataFrame, DataFrame]:
        zones = self.session.spark.createDataFrame([("zone", zone if isinstance(zone, str) else json.dumps(zone))], "zone_id string, geometry string")
        return coverage.select_cells(zones, self.grid, strategy), G.zone_facts(zones, self.grid)

    def unscaled(self) -> DataFrame:
        """Cells of the raw samples, for the policy that knows neither scaling nor masks; NoData is compared as a 32-bit number."""
        a = self.attributes or {}
        require(a.get("scale", 1.0) == 1.0 and a.get("offset", 0.0) == 0.0, "the unscaled policy refuses a scaled source")
        require(not a.get("masked", False), "the unscaled policy refuses an explicit mask")
        if self.raw is None:
            return self.cells
        require(self.raw.where("mask <> 255").isEmpty(), "the unscaled policy refuses an explicit mask")
        nodata = a.get("nodata")
        return raster.normalized(self.raw, self.name, None if nodata is None else struct.unpack("f", struct.pack("f", nodata))[0])

    def carve(self, zone: dict | str, *, bands=None, metrics=None, crs: str | None = None, strategy: str = "scanline", use_summaries: bool = True, exact: bool = True, expression: dict | None = None, mask: dict | None = None, backend: str | None = None, **options) -> DataFrame:
        """Statistics of one polygon: a row for each band, in the order of ``bands``.

        backend: a policy's backend, or one of the prepared structures, whose answers are the same. exact: sums do not
        depend on order (else plain sums of doubles).
        """
        self.session.check(self)
        require(crs is None or crs == self.grid.crs, "the zone has another CRS")
        opts = Options.of({k: v for k, v in {"bands": bands, "statistics": metrics, **{k: v for k, v in options.items() if k not in POLICY}}.items() if v is not None})
        physical = backend if backend in policy.STRUCTURES else None
        decision = policy.resolve({k: v for k, v in {"backend": "native" if physical else backend, **{k: options[k] for k in POLICY if k in options}}.items() if v is not None})
        cells = self.cells
        if decision["selected_backend"] != "native":
            require(expression is None and mask is None, "delegated policies take no expression and no mask")
            policy.check_delegated(opts.statistics, 1, 1, len(opts.bands) or self.band_count)
            opts = Options(opts.bands, opts.statistics or policy.FIVE)
            if decision["numerical_policy"] == policy.RASTERIO:
                cells = self.unscaled()
        selection, areas = self._selection(zone, strategy)
        require(all(b < self.band_count for b in opts.bands), "no such band")
        order = list(opts.bands) or list(range(self.band_count if expression is None else 1))
        pairs = self.session.spark.createDataFrame([(self.name, b) for b in order], "slice_id string, band int")
        cells = zonal.derive(cells.withColumn("slice_id", F.lit(self.name)), expression, mask)
        plain = expression is None and mask is None and exact and decision["numerical_policy"] != policy.RASTERIO
        if physical and physical not in ("auto", "direct"):
            require(plain, "a prepared structure answers plain requests alone")
            out = self._by_structure(physical, zone, selection, areas, opts, pairs, cells)
        elif self.summary is not None and use_summaries and physical != "direct" and plain and opts.summary_eligible() and decision["selected_backend"] == "native":
            out = summaries.measure_with(self.summary.withColumn("slice_id", F.lit(self.name)), cells, selection, areas, self.grid, self.edge, self.levels, opts, pairs)
        else:
            out = zonal.measure(cells, selection, areas, opts, pairs, exact)
        place = F.array_position(F.array(*map(F.lit, order)), F.col("band"))
        return out.withColumn("numerical_policy", F.lit(decision["numerical_policy"])).orderBy(place)

    async def carve_async(self, *args, **options) -> list:
        """Rows of ``carve``, awaited while Spark works."""
        return await asyncio.to_thread(lambda: self.carve(*args, **options).collect())

    def prepare(self, kind: str) -> Source:
        """Build and keep an acceleration structure: row_blocks, hierarchy, cumulative_full or cumulative_blocked."""
        self.session.check(self)
        cells = self.cells.withColumn("slice_id", F.lit(self.name))
        if kind == "row_blocks":
            made = summaries.row_blocks(cells).persist()
        elif kind == "hierarchy":
            made = summaries.pyramid(cells, 16, 4).persist()
        else:
            require(kind in ("cumulative_full", "cumulative_blocked"), "unknown structure")
            made = summaries.row_prefixes(cells)
            made[0].persist()
        self.prepared[kind] = made
        return self

    def _by_structure(self, kind: str, zone: dict | str, selection: DataFrame, areas: DataFrame, opts: Options, pairs: DataFrame, cells: DataFrame) -> DataFrame:
        require(opts.summary_eligible(), "these statistics cannot come from a prepared structure")
        if kind.startswith("persistent"):
            require(self.summary is not None, "no index is open")
            table = self.summary.withColumn("slice_id", F.lit(self.name))
            return summaries.measure_with(table, cells, selection, areas, self.grid, self.edge, self.levels if kind == "persistent_hierarchy" else 0, opts, pairs)
        require(kind in self.prepared, f"{kind} has not been prepared")
        if kind == "row_blocks":
            return summaries.measure_with_blocks(self.prepared[kind], cells, selection, areas, 64, opts, pairs)
        if kind == "hierarchy":
            return summaries.measure_with(self.prepared[kind], cells, selection, areas, self.grid, 16, 4, opts, pairs)
        require(set(opts.statistics or ("min",)) <= {"sum", "support", "mean"}, "cumulative fields give sum, support and mean")
        zones = self.session.spark.createDataFrame([("zone", zone if isinstance(zone, str) else json.dumps(zone))], "zone_id string, geometry string")
        return cumulative.measure(self.prepared[kind], cells, G.edges_of(zones, self.grid), selection, areas, self.grid, opts, pairs)

    def ward(self, path: str, *, edge: int = 64, levels: int = 3) -> Source:
        """Write a summary table with the identity of its source, and use it from now on."""
        self.session.check(self)
        summaries.ward(self.cells, path, edge, levels, {"grid_id": self.grid.identity(), "source_id": self.identity})
        return self.open_index(path, levels=levels)

    def open_index(self, path: str, *, levels: int | None = None, expected_build_id: str | None = None) -> Source:
        """Use a summary table; it must be of this grid and source, and hold states that can be."""
        table, facts = summaries.open_index(self.session.spark, path)
        require(facts["grid_id"] == self.grid.identity() and facts["source_id"] == self.identity, "the index belongs to another source")
        require(expected_build_id in (None, facts["build_id"]), "the index is of another build")
        require(summaries.check_states(table, self.grid, facts["edge"]).isEmpty(), "the summary holds states that cannot be")
        self.summary, self.edge, self.levels, self.build_id = table, facts["edge"], facts["levels"] if levels is None else min(levels, facts["levels"]), facts["build_id"]
        return self

    def close_index(self) -> Source:
        self.summary, self.build_id = None, None
        return self

    def compile(self, output: str, **options) -> None:
        """Write a lossless snapshot of the raw samples."""
        self.session.check(self)
        require(self.raw is not None, "only sources with raw samples can be compiled")
        a = self.attributes or {}
        snapshot.compile_snapshot(self.raw, output, self.grid, nodata=a.get("nodata"), scale=a.get("scale", 1.0), offset=a.get("offset", 0.0), **options)

    def read_window(self, window, bands) -> DataFrame:
        """Original samples and masks of a window."""
        self.session.check(self)
        require(self.raw is not None, "the source has no raw samples")
        return raster.raw_window(self.raw, *window, list(bands))

    def sum_selected(self, request: dict, *, numerical_policy: str = "ordered_v1") -> DataFrame:
        """Ordered sums of explicit selections, by polygon and band."""
        self.session.check(self)
        require(numerical_policy == "ordered_v1" and self.raw is not None, "ordered sums are taken of raw samples")
        facts = ordered.admit(request)
        rows = ordered.chosen(self.raw.where(F.col("band").isin(facts["selected_bands"])).withColumnRenamed("sample", "value"), ordered.selection_rows(self.session.spark, request))
        nodata = request.get("nodata") or [None]
        return ordered.ordered_sums(rows, ["polygon_id", "band"], nodata[0])

    def population(self, zone: dict | str) -> DataFrame:
        """Mass by spherical area."""
        self.session.check(self)
        require(self.band_count == 1, "the spherical policy needs one band")
        zones = self.session.spark.createDataFrame([("zone", zone if isinstance(zone, str) else json.dumps(zone))], "zone_id string, geometry string")
        return spherical.spherical_mass(self.cells, zones, self.grid)


@dataclass
class Index:
    """A retained summary of a source; a source that is closed or changed makes it invalid."""

    source: Source
    path: str
    build_id: str

    def info(self) -> dict:
        valid = self.source.session.sources.get(self.source.name) is self.source and self.source.build_id == self.build_id
        return {"source": self.source.name, "path": self.path, "build_id": self.build_id, "edge": self.source.edge, "levels": self.source.levels, "valid": valid}


POLICY = ("numerical_policy", "accepted_policies", "execution_envelope", "backend_options")


class Session:
    """Named sources, plans and jobs of a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Source] = {}
        self.plans: dict[str, tuple[DataFrame, DataFrame, Grid]] = {}
        self.jobs: dict[str, Job] = {}
        self.indexes: dict[str, Index] = {}
        self.brackets: dict = {}  # open verified queries, by source
        self.files: dict[str, dict] = {}
        self.cache_files = False

    def check(self, source: Source) -> None:
        """A source is usable while it is registered and its file is as it was."""
        require(self.sources.get(source.name) is source, "the source is closed")
        if source.file is not None:
            source.file.check()

    def register_index(self, source: Source, path: str, *, id: str, expected_build_id: str | None = None) -> Index:
        require(id not in self.indexes and len(self.indexes) < CAPACITY["indexes"], "the name is taken, or there are too many indexes")
        source.open_index(path, expected_build_id=expected_build_id)
        self.indexes[id] = Index(source, path, source.build_id)
        return self.indexes[id]

    def close_index(self, id: str) -> None:
        self.indexes.pop(id).source.close_index()

    def backends(self) -> dict:
        return {"native": [policy.NATIVE], "exactextract": [policy.FRACTIONAL, policy.RASTERIO], "default": "native"}

    def stats(self) -> dict:
        return {"sources": len(self.sources), "plans": len(self.plans), "jobs": len(self.jobs), "indexes": len(self.indexes)}

    def _add(self, source: Source) -> Source:
        require(source.name not in self.sources and len(self.sources) < CAPACITY["sources"], "the name is taken, or there are too many sources")
        self.sources[source.name] = source
        return source

    def infuse(self, source: dict, *, id: str | None = None) -> Source:
        """Register a source: an inline ``raster``, a GeoTIFF ``location``, a ``snapshot``, or a ``location`` of a NetCDF file with its ``variable``.

        A location is told by its first bytes, not by its name. ``identity`` declares sha256 and length, and a policy.
        """
        fields(source, ("raster", "location", "snapshot", "overview", "crs", "bands", "identity", "variable"))
        kinds = [k for k in ("raster", "location", "snapshot") if k in source]
        require(len(kinds) == 1, "exactly one of raster, location and snapshot")
        require("identity" not in source or kinds == ["location"], "only a location has a declared identity")
        require("overview" not in source or kinds == ["location"], "only a location has overviews")
        name = id or f"source{len(self.sources)}"
        if kinds == ["raster"]:
            bands = source["raster"]["bands"]
            grid, cells = raster.inline(self.spark, source["raster"], name)
            scaled = {"scale": max((float(b.get("scale", 1)) for b in bands), key=lambda v: v != 1, default=1.0), "offset": max((float(b.get("offset", 0)) for b in bands), key=lambda v: v != 0, default=0.0)}
            return self._add(self._mapped(Source(self, name, grid, cells, raster.identity(source["raster"]), len(bands), attributes={**scaled, "masked": any(b.get("valid") for b in bands)}), source.get("bands")))
        if kinds == ["snapshot"]:
            return self._add(self._mapped(self._snapshot(source["snapshot"], name), source.get("bands")))
        path = source["location"]
        if snapshot.is_snapshot(self.spark, path):
            require(not {"overview", "variable", "identity"} & set(source), "a snapshot has no overviews and variables")
            return self._add(self._mapped(self._snapshot(path, name), source.get("bands")))
        identity = files.Identity.of(self.spark, path, source.get("identity"))
        data = files.Ranges(self.spark, path)
        magic = data.read(0, min(8, identity.length))
        if magic[:3] == b"CDF":
            require("variable" in source and "overview" not in source, "a NetCDF file needs its variable, and has no overviews")
            grid, raw, attributes, bands = netcdf.load(self.spark, path, source["variable"], source.get("crs"))
        else:
            require(magic[:2] in (b"II", b"MM"), "neither a TIFF nor a NetCDF file")
            require("variable" not in source, "a TIFF file has no variables")
            found = geotiff.images(data)
            image, full = geotiff.pick(found, source.get("overview"))[0], geotiff.pick(found, None)[0]
            grid = full.grid(source.get("crs"))
            if image is not full:
                t = grid.transform
                grid = Grid(image.width, image.height, (t[0], t[1] * grid.width / image.width, 0.0, t[3], 0.0, t[5] * grid.height / image.height), grid.crs)
            raw, attributes, bands = geotiff.load(self.spark, path, source.get("overview")), {"nodata": image.nodata()}, image.bands
        cells = raster.normalized(raw, name, attributes["nodata"], attributes.get("scale", 1.0), attributes.get("offset", 0.0))
        return self._add(self._mapped(Source(self, name, grid, cells, identity.sha256, bands, raw, attributes, identity), source.get("bands")))

    def _snapshot(self, path: str, name: str) -> Source:
        """A snapshot with its stored summary, if it has one."""
        grid, raw, meta = snapshot.open_snapshot(self.spark, path)
        cells = raster.normalized(raw, name, meta["nodata"], meta["scale"], meta["offset"])
        n = raw.agg(F.max("band")).first()[0] + 1
        made = Source(self, name, grid, cells, meta["content_id"], n, raw, {k: meta[k] for k in ("nodata", "scale", "offset")})
        return made.open_index(f"{path}/summary") if meta["summary"] else made

    def _mapped(self, source: Source, bands: list[int] | None) -> Source:
        """Expose only some bands, renumbered in the order given."""
        if bands is None:
            return source
        require(len(set(bands)) == len(bands) and all(0 <= b < source.band_count for b in bands), "bands must be distinct and there")
        source.close_index()
        number = F.create_map(*(F.lit(x) for p in ((b, i) for i, b in enumerate(bands)) for x in p))
        source.cells = source.cells.where(F.col("band").isin(bands)).withColumn("band", number[F.col("band")])
        if source.raw is not None:
            source.raw = source.raw.where(F.col("band").isin(bands)).withColumn("band", number[F.col("band")])
        source.band_count = len(bands)
        return source

    def close(self, source: Source) -> None:
        require(self.sources.get(source.name) is source, "the source is closed")
        source.cells.unpersist()
        del self.sources[source.name]

    def register_file(self, spec: dict, *, id: str) -> None:
        """Remember a file; it is opened by the first request that needs it."""
        require(id not in self.files and id not in self.sources and len(self.files) < CAPACITY["sources"], "the name is taken, or there are too many files")
        require("location" in spec, "a file has a location")
        self.files[id] = spec

    def file(self, id: str) -> Source:
        """The source of a registered file. Its cells are kept, if the cache is on."""
        if id not in self.sources:
            source = self.infuse(self.files[id], id=id)
            if self.cache_files:
                source.cells = source.cells.persist()
        return self.sources[id]

    def close_file(self, id: str) -> None:
        del self.files[id]
        if id in self.sources:
            self.close(self.sources[id])

    def configure_file_cache(self, on: bool) -> None:
        """Keep decoded cells of files that are opened from now on, in memory and on disk; off drops what is kept."""
        self.cache_files = on
        if not on:
            self.clear_file_cache()

    def clear_file_cache(self) -> None:
        for id in self.files:
            if id in self.sources:
                self.sources[id].cells.unpersist()

    def measure_file(self, spec: dict, zone: dict | str, **options) -> list:
        """Open a file, measure a polygon, and close it again."""
        name = f"file {len(self.sources)} once"
        source = self.infuse(spec, id=name)
        try:
            return source.carve(zone, **options).collect()  # a row for each band
        finally:
            self.close(source)

    def compile_polygon(self, geometry: dict | str, *, source: Source, id: str, strategy: str = "scanline") -> str:
        """Compile a plan once, for use with sources on the same grid."""
        require(id not in self.plans and len(self.plans) < CAPACITY["plans"], "the name is taken, or there are too many plans")
        selection, areas = source._selection(geometry, strategy)
        self.plans[id] = (selection.persist(), areas.persist(), source.grid)
        return id

    def drop_plan(self, id: str) -> None:
        for df in self.plans.pop(id)[:2]:
            df.unpersist()

    def measure(self, *, source: Source, plan: str, options: dict | None = None, exact: bool = True) -> DataFrame:
        self.check(source)
        selection, areas, grid = self.plans[plan]
        require(grid == source.grid, "the plan was compiled for another grid")
        return zonal.measure(source.cells, selection, areas, Options.of(options), None, exact)

    def start_job(self, spec: dict, *, id: str = "batch", checkpoint: dict | None = None) -> Job:
        """A zones by slices job; slices name a registered ``source``."""
        require(id not in self.jobs and len(self.jobs) < CAPACITY["jobs"], "the name is taken, or there are too many jobs")
        spec = {("options" if k == "metrics" else k): ({"statistics": v} if k == "metrics" else v) for k, v in spec.items()}
        decision = policy.resolve({k: spec.pop(k) for k in ("backend", *POLICY) if k in spec})
        unscaled = decision["numerical_policy"] == policy.RASTERIO

        def opened(s: dict) -> JobSource:
            require(s.get("source") in self.sources, "no such source")
            x = self.sources[s["source"]]
            self.check(x)
            cells = x.unscaled() if unscaled else x.cells
            native = decision["selected_backend"] == "native"
            require(native or s.get("index") is None, "delegated jobs take no index")
            return JobSource(x.grid, cells, x.identity, x.band_count, x.summary if native else None, x.edge, x.levels, x.build_id if native else None)

        self.jobs[id] = Job(self.spark, spec, opened, checkpoint, group=id, policy=decision["numerical_policy"])
        return self.jobs[id]

    def cleave(self, job: dict, *, id: str = "batch", max_rows: int = 128, checkpoint: dict | None = None):
        """Run a job; yields its rows."""
        running = self.start_job(job, id=id, checkpoint=checkpoint)
        try:
            for page in running.pages(max_rows):
                yield from page["rows"]
        finally:
            self.jobs.pop(id, None)

    async def cleave_async(self, job: dict, **options):
        """``cleave``, a page at a time, awaited while Spark works."""
        pages = self.batch_pages(job, **options)
        while (page := await asyncio.to_thread(next, pages, None)) is not None:
            for row in page["rows"]:
                yield row

    def batch_pages(self, job: dict, *, id: str = "batch", max_rows: int = 128, checkpoint: dict | None = None):
        running = self.start_job(job, id=id, checkpoint=checkpoint)
        try:
            yield from running.pages(max_rows)
        finally:
            self.jobs.pop(id, None)

    def sum_selected(self, prof: dict, request: dict, *, numerical_policy: str, view_id: str, access_class: str = "unknown") -> DataFrame:
        """Route an ordered request to one of a profile's sources; each side names a registered source."""
        side, _ = profile.route(prof, request, view_id, numerical_policy, access_class)
        return self.sources[prof[side]["source"]].sum_selected(request).withColumn("route", F.lit(side))

    def bulk_reduce(self, values: DataFrame, selection: DataFrame | None = None, *, policy: str = "strict_selected_v1", nodata: float | None = None) -> DataFrame:
        return ordered.bulk_reduce(values, selection, policy, nodata)

    def verify(self, path: str) -> bool:
        """Does a snapshot match its digests?"""
        return snapshot.verify_snapshot(self.spark, path).isEmpty()

    @contextmanager
    def verified(self, *sources: Source):
        """Fail if a source is replaced or closed, or its file changed, while the block runs; yields a receipt that is filled at the end."""
        for s in sources:
            self.check(s)
        receipt: dict = {}
        yield receipt
        for s in sources:
            if self.sources.get(s.name) is not s:
                raise RequestError("a source has changed during the query")
            if s.file is not None:
                s.file.check(content=True)
            receipt[s.name] = s.identity

    def cancel(self, group: str) -> None:
        """Cancel what Spark runs for a job; every job runs in the job group of its id."""
        self.spark.sparkContext.cancelJobGroup(group)
