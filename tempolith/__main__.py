"""Command line: python -m tempolith --data FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import subprocess
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.control import Controller

COMMANDS = {
    "put": ["key", "value"], "get": ["key"], "delete": ["key"], "scan": ["start", "end", "field?", "op?", "operand?"],
    "put-versioned": ["key", "payload", "source?"], "get-as-of": ["key", "nanos"], "list-versions": ["key"],
    "fingerprint": ["prefix?", "nanos?"], "list-writes": ["prefix?", "from?", "to?", "source?"], "export-writes": ["path", "prefix?"],
    "import-registry": ["file"], "compact": [], "apply": ["spec-file"], "tick": [], "recover": [], "help": [], "shell": [],
}


def run(engine: Engine, command: str, args: list[str]) -> int:
    """Run one command; a scan end of '-' is open."""
    a = args + [""] * 5
    number = lambda x: int(x or 0)
    if command == "put":
        engine.put(a[0], a[1])
    elif command == "get":
        value = engine.get(a[0])
        print(value if value is not None else "(not found)")
        return int(value is None)
    elif command == "delete":
        engine.delete(a[0])
    elif command == "scan":
        bound = lambda x: "" if x == "-" else x
        for r in engine.scan(bound(a[0]), bound(a[1]), a[2], a[3], a[4]).toLocalIterator():
            print(f"{r.key}\t{r.value}")
    elif command == "put-versioned":
        print(engine.put_versioned(a[0], a[1].encode(), a[2]))
    elif command == "get-as-of":
        row = engine.get_as_of(a[0], int(a[1]))
        print(f"{row.seq}\t{bytes(row.payload).decode()}" if row else "(not found)")
        return int(row is None)
    elif command in ("list-versions", "list-writes"):
        rows = engine.list_versions(a[0]) if command == "list-versions" else engine.list_writes(a[0], number(a[1]), number(a[2]), a[3])
        for r in rows.toLocalIterator():
            print(f"{r.logical_key}\t{r.seq}\t{r.write_nanos}\t{r.source}")
    elif command == "fingerprint":
        r = engine.replay_fingerprint(a[0], number(a[1]))
        print(f"{r.fingerprint}\tkeys={r.key_count}\tmismatches={len(r.mismatches)}\tbounded={r.bounded}")
    elif command == "export-writes":
        engine.export_writes(a[0], prefix=a[1])
    elif command == "import-registry":
        from pyspark.sql import functions as F

        from .operators.ledger import append, latest
        from .sources.tables import import_registry, import_summary, numbered_lines

        classified, writes = import_registry(numbered_lines(engine.spark, a[0]), latest(engine.ledger))
        print(import_summary(classified).first().asDict())
        for r in classified.where("outcome = 'error'").orderBy("line").toLocalIterator():
            print(f"line {r.line}: {r.reason}")
        append(writes.withColumns({"schema_ver": F.lit(1), "write_nanos": F.unix_micros(F.current_timestamp()) * 1000}), f"{engine.folder}/ledger")
    elif command == "compact":
        engine.compact()
    elif command == "apply":
        with open(a[0], encoding="utf-8") as f:
            print(engine.apply_spec(json.load(f)))
    elif command in ("tick", "recover"):
        control = Controller(engine, execute)
        for name, what in control.tick().items() if command == "tick" else ((n, "recovered") for n in control.recover()):
            print(f"{name}\t{what}")
    elif command == "help":
        for name, wanted in COMMANDS.items():
            print(" ".join([name, *wanted]))
    elif command == "shell":
        shell(engine)
    return 0


def execute(spec: dict) -> tuple[int, str]:
    """Run a spec's command as a child process: exit code and the end of its error output."""
    env = {**os.environ, **(spec.get("env") or {})}
    done = subprocess.run(spec["command"], cwd=spec.get("dir") or None, env=env, capture_output=True, text=True)
    return done.returncode, done.stderr[-1000:].strip()


def shell(engine: Engine, lines=None) -> None:
    """Commands from lines (standard input by default) until 'exit'; errors are said and the loop goes on."""
    for line in lines if lines is not None else sys.stdin:
        words = shlex.split(line)
        if not words:
            continue
        if words[0] in ("exit", "quit"):
            return
        wanted = COMMANDS.get(words[0])
        if wanted is None or words[0] == "shell" or not sum(not w.endswith("?") for w in wanted) <= len(words) - 1 <= len(wanted):
            print(f"cannot run {line.strip()!r}; try help")
            continue
        try:
            run(engine, words[0], words[1:])
        except Exception as error:  # the session goes on
            print(f"error: {error}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tempolith")
    parser.add_argument("--data", required=True, help="folder of the ledger and the change log")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("args", nargs="*")
    given = parser.parse_args(argv)
    wanted = COMMANDS[given.command]
    least = sum(not w.endswith("?") for w in wanted)
    if not least <= len(given.args) <= len(wanted):
        parser.error(f"{given.command} takes {' '.join(wanted)}")
    return run(Engine(SparkSession.builder.appName("tempolith").getOrCreate(), given.data), given.command, given.args)


if __name__ == "__main__":
    sys.exit(main())
