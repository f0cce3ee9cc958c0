import json

from gridloom.__main__ import main
from gridloom.requests import answer
from gridloom.session import Session

GRID = {"width": 2, "height": 2, "transform": [0, 1, 0, 2, 0, -1], "crs": "LOCAL"}
RASTER = {"grid": GRID, "bands": [{"values": [1, 2, 3, 4]}]}
WHOLE = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}


def test_requests(spark):
    s = Session(spark)
    assert answer(s, {"op": "open", "id": "a", "raster": RASTER})["result"]["bands"] == 1
    assert answer(s, json.dumps({"op": "measure_source", "source": "a", "geometry": WHOLE, "options": {"statistics": ["sum"]}}))["result"][0]["fractional_sum"] == 10
    assert answer(s, {"op": "compile", "id": "p", "source": "a", "geometry": WHOLE})["ok"]
    assert answer(s, {"op": "measure", "source": "a", "plan": "p"})["result"][0]["coverage_weighted_mean"] == 2.5
    job = {"zones": [{"id": "z", "geometry": WHOLE}], "slices": [{"id": "s", "source": "a"}], "crs": "LOCAL"}
    assert answer(s, {"op": "start_job", "id": "j", "job": job})["result"]["total_rows"] == 1
    page = answer(s, {"op": "next_job", "id": "j"})["result"]
    assert page["done"] and page["rows"][0]["fractional_sum"] == 10
    assert answer(s, {"op": "job_info", "id": "j"})["result"]["next_row"] == 1 and answer(s, {"op": "close_job", "id": "j"})["ok"]
    assert answer(s, {"op": "stats"})["result"] == {"sources": 1, "plans": 1, "jobs": 0, "indexes": 0}
    for bad in ({"op": "nope"}, {"op": "stats", "more": 1}, {"op": "source_info", "id": "x"}, "{", {"op": "open", "id": "b", "raster": {**RASTER, "more": 1}}):
        assert not answer(s, bad)["ok"]
    assert answer(s, {"op": "drop_plan", "id": "p"})["ok"] and answer(s, {"op": "close", "id": "a"})["ok"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(RASTER))
    (tmp_path / "z.json").write_text(json.dumps(WHOLE))
    assert main(["carve", str(tmp_path / "r.json"), str(tmp_path / "z.json"), "--metrics", "sum,mean"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["fractional_sum"] == 10
