"""Command line: every command prints JSON lines.

    python -m gridloom inspect SOURCE
    python -m gridloom carve SOURCE ZONE.json [--metrics sum,mean] [--bands 0,1]
    python -m gridloom ward SOURCE INDEX [--edge 64]
    python -m gridloom compile SOURCE OUTPUT
    python -m gridloom verify SNAPSHOT
    python -m gridloom sum-selected SOURCE REQUEST.json
    python -m gridloom cleave JOB.json NAME=SOURCE ...
    python -m gridloom backends | smoke | --version
    python -m gridloom session              (a request on each line of the input; also named serve)
    python -m gridloom run REQUESTS.jsonl   (the same from a file; stops at the first refusal)

SOURCE is a GeoTIFF, a snapshot folder, or a JSON file with an inline raster.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from gridloom.requests import answer
from gridloom.session import Session, Source


VERSION = "0.2"


def opened(session: Session, path: str, name: str = "source") -> Source:
    if path.endswith(".json"):
        with open(path) as f:
            return session.infuse({"raster": json.load(f)}, id=name)
    return session.infuse({"snapshot": path} if os.path.isdir(path) else {"location": path}, id=name)


def say(value) -> None:
    print(json.dumps(value, default=str))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["inspect", "carve", "measure", "ward", "prepare", "compile", "verify", "sum-selected", "cleave", "batch", "backends", "session", "serve", "run", "smoke"])
    p.add_argument("args", nargs="*")
    p.add_argument("--version", action="version", version=f"gridloom {VERSION}")
    p.add_argument("--metrics", type=lambda v: v.split(","))
    p.add_argument("--bands", type=lambda v: [int(x) for x in v.split(",")])
    p.add_argument("--edge", type=int, default=64)
    p.add_argument("--max-rows", type=int, default=128)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    session = Session(SparkSession.builder.appName("gridloom").getOrCreate())
    c, args = a.command, a.args
    if c == "backends":
        say(session.backends())
    elif c in ("session", "serve"):
        for line in sys.stdin:
            say(answer(session, line))
            sys.stdout.flush()
    elif c == "run":
        with open(args[0]) as f:
            for line in filter(str.strip, f):
                got = answer(session, line)
                say(got)
                if not got["ok"]:
                    return 1
    elif c == "smoke":
        tiny = {"grid": {"width": 2, "height": 2, "transform": [0, 1, 0, 2, 0, -1], "crs": "LOCAL"}, "bands": [{"values": [1, 2, 3, 4]}]}
        whole = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
        total = session.infuse({"raster": tiny}).carve(whole).first()["fractional_sum"]
        say({"ok": total == 10, "fractional_sum": total})
        return 0 if total == 10 else 1
    elif c == "verify":
        sound = session.verify(args[0])
        say({"sound": sound})
        return 0 if sound else 1
    elif c in ("cleave", "batch"):
        for pair in args[1:]:
            name, _, path = pair.partition("=")
            opened(session, path, name)
        with open(args[0]) as f:
            for row in session.cleave(json.load(f), max_rows=a.max_rows):
                say(row)
    else:
        source = opened(session, args[0])
        if c == "inspect":
            say(source.info())
        elif c in ("carve", "measure"):
            with open(args[1]) as f:
                for r in source.carve(json.load(f), metrics=a.metrics, bands=a.bands).collect():
                    say(r.asDict(recursive=True))
        elif c in ("ward", "prepare"):
            say(source.ward(args[1], edge=a.edge).info())
        elif c == "compile":
            source.compile(args[1])
            say({"output": args[1]})
        else:
            with open(args[1]) as f:
                for r in source.sum_selected(json.load(f)).collect():
                    say(r.asDict(recursive=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())
