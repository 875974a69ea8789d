"""Command line: python -m tokenloom.cli COMMAND. Exit codes: 0 well, 1 problems found, 2 wrong usage, 3 an error, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .errors import EngineError


def parse_size(text: str) -> int:
    """A number of bytes, with K, M or G for powers of 1024."""
    unit = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(text[-1:].upper())
    number = text[:-1] if unit else text
    if not number.isdigit():
        raise argparse.ArgumentTypeError(f"{text!r} is no size")
    return int(number) * (unit or 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenloom", description="Build, inspect and move tokenized sources.")
    p.add_argument("--json", action="store_true", help="print the result as JSON")
    p.add_argument("--strict", action="store_true", help="warnings count as problems")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *paths: str, **options: dict) -> None:
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        for o, kw in options.items():
            c.add_argument("--" + o.replace("_", "-"), **kw)

    yes = {"action": "store_true"}
    add("build", "source", input={"required": True}, tokenizer={"required": True}, field={"default": "text"}, split={"default": "train"}, shard_bytes={"type": parse_size, "default": 512 << 20}, no_eos=yes, bos=yes, eos_token={}, bos_token={}, overwrite=yes, max_skip_ratio={"type": float, "default": 0.01})
    for name in ("ls", "info", "status", "verify", "clean"):
        add(name, "path")
    add("rm", "path", yes=yes)
    add("pack", "source", "target", method={"default": "zstd"}, level={"type": int, "default": 3}, tar=yes)
    add("unpack", "packed", "target")
    add("migrate", "path")
    add("doctor")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tokenloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def build(a: argparse.Namespace) -> dict:
    """Write a split from a folder of text or JSON lines; the settings are kept in the source as recipe.json."""
    from . import sinks, sources
    from .sinks import ErrorPolicy, WriterConfig

    spark, home = session(), Path(a.source)
    kind = sources.jsonl if a.input.endswith(".jsonl") or (Path(a.input).is_dir() and any(Path(a.input).rglob("*.jsonl"))) else sources.txt_dir
    docs = kind(spark, a.input, a.field) if kind is sources.jsonl else kind(spark, a.input)
    config = WriterConfig(a.split, a.shard_bytes, not a.no_eos, a.bos, None, a.eos_token, a.bos_token)
    got = sinks.write_split(docs, str(home.parent), home.name, a.tokenizer, config, ErrorPolicy(max_skip_ratio=a.max_skip_ratio), a.overwrite)
    sinks.atomic_json(home / "recipe.json", {k: v for k, v in vars(a).items() if k not in ("json", "strict", "command")})
    return got.to_dict()


def run(a: argparse.Namespace) -> tuple[dict, list, list]:
    """Result, warnings, problems."""
    from .operators import inspect, pack

    if a.command == "build":
        got = build(a)
        return got, [i for i in got["issues"] if i[1] == "warning"], []
    if a.command in ("ls", "info", "status"):
        if (Path(a.path) / "meta.json").is_file() or Path(f"{a.path}.partial").is_dir():
            got = inspect.inspect_source(a.path)
            return got, [i for i in got["issues"] if i[1] == "warning"], got["problems"] or ([got["state"]] if got["state"] != "complete" else [])
        if not Path(a.path).is_dir():
            raise EngineError("C311", f"{a.path} doesn't exist")
        if a.command == "ls":
            return {"sources": inspect.source_names(a.path)}, [], []
        got = inspect.inspect_corpus(a.path)
        return got, [i for s in got["sources"] for i in s["issues"] if i[1] == "warning"], got["problems"] + [s["name"] for s in got["sources"] if s["state"] != "complete"]
    if a.command == "verify":
        got = inspect.verify_report(inspect.verify_source(session(), a.path))
        return got, [], got["bad"]
    if a.command == "clean":
        return {"removed": inspect.clean_source(a.path)}, [], []
    if a.command == "rm":
        inspect.remove_source(a.path)
        return {"removed": a.path}, [], []
    if a.command == "pack":
        return pack.pack_source(session(), a.source, a.target, a.method, a.level, a.tar), [], []
    if a.command == "unpack":
        return pack.unpack_source(session(), a.packed, a.target), [], []
    if a.command == "migrate":
        from .operators.source import read_meta

        return {"schema_version": read_meta(Path(a.path))["schema_version"], "changed": False}, [], []  # there is one schema so far
    return inspect.doctor(), [], []


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if a.command == "rm" and not a.yes:
        print("rm needs --yes", file=sys.stderr)
        return 2
    try:
        result, warnings, problems = run(a)
    except EngineError as e:
        print(json.dumps({"ok": False, "error": {"code": e.code, "what": e.what, "why": e.why, "fix": e.fix}}) if a.json else str(e), file=sys.stdout if a.json else sys.stderr)
        return 3
    except KeyboardInterrupt:
        return 130
    print(json.dumps({"ok": not problems, "command": a.command, "result": result}, default=str) if a.json else "\n".join(f"{k}: {v}" for k, v in result.items()))
    for w in warnings:
        print("warning:", *w, file=sys.stderr)
    return 1 if problems or (a.strict and warnings) else 0


if __name__ == "__main__":
    sys.exit(main())
