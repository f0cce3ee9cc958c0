"""Requests as JSON records: an op with its fields, answered by a session. Unknown ops and fields are refused."""

from __future__ import annotations

import json

from gridloom.model import RequestError, fields, require
from gridloom.session import Session

ZONE = ("geometry", "crs", "options", "strategy", "expression", "mask", "exact", "use_summaries", "backend", "numerical_policy", "accepted_policies", "execution_envelope", "backend_options")
OPS = {
    "backends": (), "stats": (), "open": ("id", "raster"), "register_source": ("id", "spec"), "close": ("id",), "close_source": ("id",), "source_info": ("id",),
    "register_file": ("id", "spec"), "close_file": ("id",), "configure_file_cache": ("on",), "clear_file_cache": (), "measure_registered_file": ("id", *ZONE), "measure_file": ("spec", *ZONE),
    "measure_source": ("source", *ZONE), "prepare_source": ("source", "path", "tile_edge", "levels"), "prepare": ("source", "kind"), "source_metrics": ("id",), "register_index": ("id", "source", "path", "expected_build_id"), "index_info": ("id",), "close_index": ("id",), "begin_verified_source_query": ("source",), "end_verified_source_query": ("source",),
    "compile": ("id", "source", "geometry", "strategy"), "measure": ("source", "plan", "options", "exact"), "drop_plan": ("id",),
    "compile_source": ("source", "output", "edge"), "verify_snapshot": ("path",), "read_window": ("source", "window", "bands"),
    "measure_ordered_source": ("source", "request"), "measure_ordered_profile": ("profile", "request", "numerical_policy", "view_id", "access_class"), "measure_population": ("source", "geometry"),
    "start_job": ("id", "job", "checkpoint"), "next_job": ("id", "max_rows"), "job_info": ("id",), "close_job": ("id",),
}


def answer(session: Session, request: dict | str) -> dict:
    """The result of a request, as plain values: {"ok": true, "result": ...} or {"ok": false, "error": ...}."""
    try:
        value = json.loads(request) if isinstance(request, str) else request
        require(isinstance(value, dict) and value.get("op") in OPS, "unknown op")
        fields(value, ("op", *OPS[value["op"]]))
        return {"ok": True, "result": _run(session, value["op"], {k: v for k, v in value.items() if k != "op"})}
    except (RequestError, KeyError, json.JSONDecodeError) as e:
        return {"ok": False, "error": str(e)}


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # results of a few zones


def _run(s: Session, op: str, v: dict):
    source = lambda: s.sources[v["source"]]
    if op == "backends":
        return s.backends()
    if op == "stats":
        return s.stats()
    if op in ("open", "register_source"):
        return s.infuse({"raster": v["raster"]} if op == "open" else v["spec"], id=v.get("id")).info()
    if op in ("close", "close_source"):
        return s.close(s.sources[v["id"]])
    if op == "source_info":
        return s.sources[v["id"]].info()
    if op == "register_file":
        return s.register_file(v["spec"], id=v["id"])
    if op == "close_file":
        return s.close_file(v["id"])
    if op == "configure_file_cache":
        return s.configure_file_cache(bool(v["on"]))
    if op == "clear_file_cache":
        return s.clear_file_cache()
    if op in ("measure_source", "measure_registered_file", "measure_file"):
        o = dict(v.get("options") or {})
        rest = {k: x for k, x in v.items() if k not in ("source", "id", "spec", "geometry", "options")}
        asked = {"bands": o.pop("bands", None), "metrics": o.pop("statistics", None), **o, **rest}
        if op == "measure_file":
            return [r.asDict(recursive=True) for r in s.measure_file(v["spec"], v["geometry"], **asked)]
        return _rows((s.file(v["id"]) if op == "measure_registered_file" else source()).carve(v["geometry"], **asked))
    if op == "prepare_source":
        return source().ward(v["path"], edge=v.get("tile_edge", 64), levels=v.get("levels", 3)).info()
    if op == "prepare":
        return source().prepare(v["kind"]).info()
    if op == "source_metrics":
        return s.sources[v["id"]].metrics()
    if op == "register_index":
        return s.register_index(source(), v["path"], id=v["id"], expected_build_id=v.get("expected_build_id")).info()
    if op == "index_info":
        return s.indexes[v["id"]].info()
    if op == "close_index":
        return s.close_index(v["id"])
    if op == "begin_verified_source_query":
        s.check(source())
        s.brackets[v["source"]] = s.verified(source())
        s.brackets[v["source"]].__enter__()
        return {"source_id": source().identity}
    if op == "end_verified_source_query":
        s.brackets.pop(v["source"]).__exit__(None, None, None)
        return {"source_id": source().identity}
    if op == "compile":
        return {"plan": s.compile_polygon(v["geometry"], source=source(), id=v["id"], strategy=v.get("strategy", "scanline"))}
    if op == "measure":
        return _rows(s.measure(source=source(), plan=v["plan"], options=v.get("options"), exact=v.get("exact", True)))
    if op == "drop_plan":
        return s.drop_plan(v["id"])
    if op == "compile_source":
        return source().compile(v["output"], **({"edge": v["edge"]} if "edge" in v else {}))
    if op == "verify_snapshot":
        return {"sound": s.verify(v["path"])}
    if op == "read_window":
        return [{**r, "samples": bytes(r["samples"]).hex(), "mask": bytes(r["mask"]).hex()} for r in _rows(source().read_window(v["window"], v["bands"]))]
    if op == "measure_ordered_source":
        return _rows(source().sum_selected(v["request"]))
    if op == "measure_ordered_profile":
        return _rows(s.sum_selected(v["profile"], v["request"], numerical_policy=v["numerical_policy"], view_id=v["view_id"], access_class=v.get("access_class", "unknown")))
    if op == "measure_population":
        return _rows(source().population(v["geometry"]))
    if op == "start_job":
        j = s.start_job(v["job"], id=v["id"], checkpoint=v.get("checkpoint"))
        return {"fingerprint": j.fingerprint, "total_rows": j.total}
    if op == "next_job":
        return s.jobs[v["id"]].next(v.get("max_rows", 128))
    if op == "job_info":
        j = s.jobs[v["id"]]
        return {"fingerprint": j.fingerprint, "next_row": j.next_row, "total_rows": j.total}
    s.jobs.pop(v["id"])  # close_job
    return None
