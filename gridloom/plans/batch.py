"""Batch jobs over zones and slices: fingerprint, whole results by slice, paging, checkpoint and resume."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.expressions import bands_of
from gridloom.model import MAX_PAGE, MAX_SLICES, MAX_ZONES, TILE_EDGES, Grid, Options, fields, require
from gridloom.operators import coverage, summaries, zonal
from gridloom.operators import geometry as G
from gridloom.plans import policy

JOB = ("zones", "slices", "crs", "options", "expression", "mask", "schedule", "geometry_layout", "tile_edge", "window_policy", "output_mode", "budget")
NUMERIC = ("sum", "support", "mean", "min", "max", "count")
HINTS = {"schedule": ("tile", "feature", "mixed"), "geometry_layout": ("auto", "csr", "compact", "compact_shared", "compact_rows"), "window_policy": ("auto", "source", "fixed"), "output_mode": ("full", "numeric")}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(job: dict) -> str:
    """Identity of what is asked for: zones, declared slices, CRS, options, expression and mask, and not how it is run."""
    slices = [{k: s.get(k) for k in ("id", "time", "variable", "bands")} for s in job["slices"]]
    part = {"zones": job["zones"], "slices": slices, **{k: job.get(k) for k in ("crs", "options", "expression", "mask", "output_mode")}}
    return hashlib.sha256(canonical(part).encode()).hexdigest()


@dataclass
class Source:
    """A grid with its cells; summary: a table made by summaries.pyramid with that tile edge and number of levels."""

    grid: Grid
    cells: DataFrame
    identity: str
    band_count: int
    summary: DataFrame | None = None
    edge: int = 64
    levels: int = 0
    build_id: str | None = None


@dataclass
class Job:
    spark: SparkSession
    spec: dict
    open_source: Callable[[dict], Source]
    checkpoint: dict | None = None
    ready: list = field(default_factory=list)
    pins: list = field(default_factory=list)
    group: str | None = None
    policy: str = policy.NATIVE

    def __post_init__(self):
        s = fields(self.spec, JOB, ("zones", "slices", "crs"))
        require(1 <= len(s["zones"]) <= MAX_ZONES and 1 <= len(s["slices"]) <= MAX_SLICES, "1..4096 zones and slices")
        for kind in ("zones", "slices"):
            require(len({x["id"] for x in s[kind]}) == len(s[kind]), f"{kind} must have distinct ids")
        for hint, known in HINTS.items():
            require(s.get(hint, known[0]) in known, f"unknown {hint}")
        require(s.get("tile_edge", 256) in TILE_EDGES, "tile_edge must be 32, 64, 128, 256 or 512")
        self.options = Options.of(s.get("options"))
        require(s.get("expression") is None or self.options.weight_band is None, "weights do not go with an expression")
        if s.get("output_mode") == "numeric":
            require(self.options.statistics is not None and set(self.options.statistics) == set(NUMERIC), "numeric output is exactly the six basic statistics")
        for e in ("expression", "mask"):
            if s.get(e) is not None:
                bands_of(s[e])
        if self.policy != policy.NATIVE:
            require(s.get("expression") is None and s.get("mask") is None and self.checkpoint is None, "delegated jobs take no expression, mask or checkpoint")
            policy.check_delegated(self.options.statistics, len(s["zones"]), len(s["slices"]), 1)
            self.options = Options(self.options.bands, self.options.statistics or policy.FIVE)
        self.fingerprint = fingerprint(s)
        self.next_row, self.pins = 0, [None] * len(s["slices"])
        if self.checkpoint is not None:
            c = fields(self.checkpoint, ("version", "fingerprint", "next_row", "pins"), ("version", "fingerprint", "next_row", "pins"))
            require(c["version"] == 1 and c["fingerprint"] == self.fingerprint, "the checkpoint belongs to another job")
            require(0 <= c["next_row"] <= self.total and len(c["pins"]) == len(s["slices"]), "the checkpoint is not valid")
            self.next_row, self.pins = c["next_row"], list(c["pins"])
        self.staged: DataFrame | None = None
        self._selections: dict[str, tuple[DataFrame, DataFrame]] = {}

    @property
    def total(self) -> int:
        return len(self.spec["zones"]) * len(self.spec["slices"])

    def zones(self) -> DataFrame:
        rows = [(z["id"], z.get("version"), canonical(z["geometry"]), k) for k, z in enumerate(self.spec["zones"])]
        return self.spark.createDataFrame(rows, "zone_id string, zone_version string, geometry string, zone_no int")

    def selection(self, grid: Grid) -> tuple[DataFrame, DataFrame]:
        """Compiled once for each grid, and used by all slices on it."""
        if grid.identity() not in self._selections:
            require(grid.crs == self.spec["crs"], "zones and slices have different CRS")
            zones = self.zones()
            self._selections[grid.identity()] = (coverage.select_cells(zones, grid).persist(), G.zone_facts(zones, grid).persist())
        return self._selections[grid.identity()]

    def _opened(self, k: int) -> Source:
        """The source of a slice, pinned: a resumed job fails if it is another one."""
        s = self.spec["slices"][k]
        source = self.open_source(s)
        require(s.get("expected_build_id") in (None, source.build_id), "the index is of another build")
        pin = {"source_id": source.identity, "grid_id": source.grid.identity(), "index_build_id": source.build_id}
        require(self.pins[k] in (None, pin), "a source has changed since the checkpoint")
        self.pins[k] = pin
        return source

    def _from_summary(self, k: int, source: Source) -> bool:
        plain = self.spec.get("expression") is None and self.spec.get("mask") is None and not self.spec["slices"][k].get("bands")
        return self.spec.get("schedule") == "mixed" and source.summary is not None and plain and self.options.summary_eligible()

    def _cells(self, k: int, source: Source) -> DataFrame:
        """Cells of a slice under its name, with its own numbers of bands."""
        s = self.spec["slices"][k]
        cells = source.cells.withColumn("slice_id", F.lit(s["id"]))
        if s.get("bands"):
            at = {b: i for i, b in enumerate(s["bands"])}
            cells = cells.where(F.col("band").isin(s["bands"])).withColumn("band", F.create_map(*(F.lit(x) for p in at.items() for x in p))[F.col("band")])
        return cells.select("slice_id", "row", "col", "band", "value", "valid")

    def _pairs(self, k: int, source: Source) -> list[tuple[str, int]]:
        s = self.spec["slices"][k]
        bands = [0] if self.spec.get("expression") is not None else list(self.options.bands) or list(range(len(s["bands"]) if s.get("bands") else source.band_count))
        return [(s["id"], b) for b in bands]

    def _measured(self, opened: dict[int, Source]) -> DataFrame:
        """Results of slices on one grid, as one plan: the selection is joined once with the cells of all."""
        first = next(iter(opened.values()))
        selection, areas = self.selection(first.grid)
        pairs = self.spark.createDataFrame([p for k, x in opened.items() for p in self._pairs(k, x)], "slice_id string, band int")
        if len(opened) == 1 and self._from_summary(next(iter(opened)), first):
            k = next(iter(opened))
            out = summaries.measure_with(first.summary.withColumn("slice_id", F.lit(self.spec["slices"][k]["id"])), self._cells(k, first), selection, areas, first.grid, first.edge, first.levels, self.options, pairs)
        else:
            cells = functools.reduce(DataFrame.unionByName, (self._cells(k, x) for k, x in opened.items()))
            cells = zonal.derive(cells, self.spec.get("expression"), self.spec.get("mask"))
            out = zonal.measure(cells, selection, areas, self.options, pairs, edge=self.spec.get("tile_edge", 256))
        facts = [(self.spec["slices"][k]["id"], k, self.spec["slices"][k].get("time"), self.spec["slices"][k].get("variable"), x.identity) for k, x in opened.items()]
        slices = self.spark.createDataFrame(facts, "slice_id string, slice_no int, time string, variable string, source_id string")
        zones = self.zones().select("zone_id", "zone_version", "zone_no")
        named = out.join(F.broadcast(zones), "zone_id").join(F.broadcast(slices), "slice_id")  # at most 4096 zones and slices
        rid = F.sha2(F.concat_ws(":", F.lit(self.fingerprint), "zone_id", "slice_id", "source_id"), 256)
        return named.withColumns({"result_id": rid, "row_no": (F.col("slice_no") * F.lit(len(self.spec["zones"])) + F.col("zone_no")).cast("long")})

    def slice_rows(self, k: int) -> DataFrame:
        """Results of a whole slice."""
        return self._measured({k: self._opened(k)})

    def results(self) -> DataFrame:
        """All slices as one DataFrame, for writing: nothing goes through the driver. Slices of a grid share a plan."""
        groups: dict[str, dict[int, Source]] = {}
        for k in range(len(self.spec["slices"])):
            x = self._opened(k)
            groups.setdefault(f"summary {k}" if self._from_summary(k, x) else x.grid.identity(), {})[k] = x
        return functools.reduce(DataFrame.unionByName, map(self._measured, groups.values()))

    def next(self, max_rows: int = 128) -> dict:
        """The next page: rows in the order of slices, then zones. A slice is run whole before any of its rows is out."""
        require(1 <= max_rows <= MAX_PAGE, "pages have 1..4096 rows")
        n = len(self.spec["zones"])
        if not self.ready and self.next_row < self.total:
            k, skip = divmod(self.next_row, n)
            if self.group is not None:
                self.spark.sparkContext.setJobGroup(self.group, "gridloom job", True)
            try:
                if self.policy != policy.NATIVE:  # staged whole, then paged
                    self.staged = self.staged if self.staged is not None else self.results().persist()
                    rows = self.staged.where(F.col("slice_no") == k).collect()
                else:
                    rows = self.slice_rows(k).collect()  # one slice: zones * bands rows
            finally:
                if self.group is not None:
                    for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                        self.spark.sparkContext.setLocalProperty(name, None)
            place = {b: i for i, b in enumerate(self.options.bands)}
            by_zone: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: (r["zone_no"], place.get(r["band"], r["band"]))):  # bands as requested
                by_zone.setdefault(r["zone_no"], []).append(r.asDict(recursive=True))
            self.ready = [by_zone[z] for z in range(skip, n)]
        page, self.ready = self.ready[:max_rows], self.ready[max_rows:]
        self.next_row += len(page)
        state = {"version": 1, "fingerprint": self.fingerprint, "next_row": self.next_row, "pins": list(self.pins)}
        return {"rows": [r for zone in page for r in zone], "done": self.next_row >= self.total, "checkpoint": state if self.policy == policy.NATIVE else None}

    def pages(self, max_rows: int = 128):
        while True:
            page = self.next(max_rows)
            yield page
            if page["done"]:
                return
