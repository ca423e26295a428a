"""Operations from the command line: ``python -m tidewright.cli MODULE:FUNCTION COMMAND``.

MODULE:FUNCTION names a function that takes a session and returns an Engine with its tables
and views declared.
"""

from __future__ import annotations

import argparse
import importlib
import json
from dataclasses import is_dataclass

from pyspark.sql import SparkSession

from .engine import Engine

COMMANDS = {
    "refresh-all": lambda e, a: e.refresh_all(),
    "refresh-stale": lambda e, a: e.refresh_stale(),
    "enqueue-refreshes": lambda e, a: (e.enqueue_refreshes(), e.scheduler.flush())[0],
    "rebuild": lambda e, a: [e.views[n].rebuild(a.confirm) for n in a.views] if a.views else e.rebuild_all(a.confirm),
    "verify": lambda e, a: e.verify_all_or_raise(a.mode),
    "audit": lambda e, a: [{"view": n, "schema_drift": d} for n, d in e.schema_drift().items()],
    "reconcile": lambda e, a: e.reconcile_all(),
    "enqueue-reconciles": lambda e, a: e.enqueue_reconciles(),
    "warm-up": lambda e, a: e.warm_up_all(),
}


def plain(x):
    if is_dataclass(x):
        return {k: v for k, v in ((k, getattr(x, k)) for k in x.__dataclass_fields__) if k != "drift"}
    return x


def run(engine: Engine, command: str, args: argparse.Namespace) -> list:
    return [plain(x) for x in COMMANDS[command](engine, args)]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewright", description=__doc__)
    p.add_argument("engine", help="MODULE:FUNCTION")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("views", nargs="*")
    p.add_argument("--confirm", action="store_true", help="allow full rebuilds")
    p.add_argument("--mode", default="full")
    args = p.parse_args(argv)
    module, _, function = args.engine.partition(":")
    engine = getattr(importlib.import_module(module), function)(SparkSession.builder.getOrCreate())
    for row in run(engine, args.command, args):
        print(json.dumps(row, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
