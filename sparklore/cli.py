"""Commands: ``python -m sparklore.cli --kb-path PATH COMMAND``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, DedupePolicy
from .functions import blocks
from .kb import KnowledgeBase, TopicError
from .operators import matching
from .sources import PROVIDERS, default_root
from .sources.topics import markdown
from .streaming import runner


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparklore")
    p.add_argument("--kb-path")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("topics").add_argument("--json", action="store_true", help="one JSON list")
    sub.add_parser("init")
    sub.add_parser("inject", help="the block that tells agents of the topics, into the instruction files of this folder")
    for name in ("read", "delete", "search"):
        one = sub.add_parser(name)
        one.add_argument("words", nargs="+")
        if name == "read":
            one.add_argument("--raw", action="store_true", help="with its front matter")
    add = sub.add_parser("add")
    add.add_argument("title")
    add.add_argument("--slug")
    add.add_argument("--tags", nargs="*", default=[])
    add.add_argument("--aliases", nargs="*", default=[])
    update = sub.add_parser("update", help="the body from standard input; an empty one is left as it is")
    update.add_argument("words", nargs="+")
    for name in ("--title", "--slug"):
        update.add_argument(name)
    for name in ("--tags", "--aliases"):
        update.add_argument(name, nargs="*")
    loop = sub.add_parser("loop").add_subparsers(dest="action", required=True)
    for name in ("run", "start"):
        one = loop.add_parser(name)
        one.add_argument("--root", nargs="+", help="log folder (the provider's usual one without it); for SQLite logs database files, the projects manifest, or the folder of OpenCode's settings")
        one.add_argument("--responses", required=True, help="Parquet table (context_id, response) of the model's answers")
        one.add_argument("--directives", help="Parquet table (context_id 0, response) of the model's answer on repeated messages; without it none are mined")
        one.add_argument("--regime")
        one.add_argument("--dry-run", action="store_true")
        one.add_argument("--interval", type=int, help="start: seconds between passes; without it passes run when logs change")
    loop.add_parser("status")
    return p


#: The files that ``inject`` writes, and whose block it is.
INSTRUCTIONS, TARGET = ("CLAUDE.md", "AGENTS.md"), "claude-code"


def source(config: Config, roots: list[str] | None = None):
    roots, reader = roots or [default_root(config.source)], PROVIDERS[config.source]
    if config.source == "crush" and roots[0].endswith(".json"):
        return reader.of_manifest(roots[0])
    if config.source == "opencode" and not roots[0].endswith(".db"):
        return reader.found(*roots)
    return reader(tuple(roots)) if config.source in ("crush", "opencode") else reader(roots[0])


def shown(rows: DataFrame) -> None:
    """Prints every row, a partition at a time."""
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


def inject(spark: SparkSession, folder: str = ".") -> int:
    """Puts the managed block into the instruction files of ``folder``; 1 where none could be written."""
    files = [(str(Path(folder) / n), (Path(folder) / n).read_text() if (Path(folder) / n).exists() else None) for n in INSTRUCTIONS]
    made = blocks.changes(spark.createDataFrame(files, "path string, content string"), TARGET, blocks.render(TARGET, "Known solutions"), "install").collect()
    for r in made:
        if r.action == "error":
            print(f"{r.path}: its block is {r.health}", file=sys.stderr)
        else:
            Path(r.path).write_text(r.content)
            print(f"{r.path}: {r.action}")
    return int(all(r.action == "error" for r in made))


def as_json(rows: DataFrame) -> None:
    """Prints every row as an object of one list, a partition at a time."""
    last = None
    for row in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        print("[" if last is None else f"  {last},")
        last = row.j
    print("[]" if last is None else f"  {last}\n]")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config.load(args.config, kb_path=args.kb_path)
    spark = spark or SparkSession.builder.appName("sparklore").getOrCreate()
    kb = KnowledgeBase(spark, config.kb_path)
    try:
        if args.command not in ("init", "inject", "loop") and not kb.is_initialized():
            raise TopicError(f"no topic store at {config.kb_path}: run init first")
        if args.command == "topics":
            (as_json if args.json else shown)(kb.list())
        elif args.command == "inject":
            return inject(spark)
        elif args.command == "init":
            print("made" if kb.init() else "was there")
        elif args.command == "search":
            shown(kb.search(" ".join(args.words)))
        elif args.command == "read":
            topic = kb.get(" ".join(args.words))
            print(markdown(topic).first()["text"] if args.raw else topic.first()["body"], end="\n" * (not args.raw))
        elif args.command == "delete":
            kb.delete(" ".join(args.words))
        elif args.command == "add":
            print(kb.add(args.title, sys.stdin.read(), args.slug, args.tags, args.aliases))
        elif args.command == "update":
            print(kb.update(" ".join(args.words), sys.stdin.read() or None, args.title, args.slug, args.tags, args.aliases))
        elif args.action == "status":
            print(config.dedupe.summary())
            print(kb.status())
        else:
            return _loop(spark, kb, config, args)
    except TopicError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _loop(spark: SparkSession, kb: KnowledgeBase, config: Config, args) -> int:
    """1 where a session has failed, as its error says; the others' work is kept."""
    from dataclasses import replace

    if args.regime:
        config = replace(config, dedupe=DedupePolicy.preset(args.regime))
    logs, model = source(config, args.root), runner.answers(spark.read.parquet(args.responses))
    synthesize = runner.answers(spark.read.parquet(args.directives)) if args.directives else None

    def once() -> int:
        done = runner.run_pass(spark, logs, kb.store, config, model, synthesize, dry_run=args.dry_run)
        shown(matching.outcome_text(done.outcomes).select("summary_line"))
        totals = done.totals().first().asDict()
        print(", ".join(f"{k} {v}" for k, v in totals.items()))
        for r in done.errors.toLocalIterator():
            print(f"{r.context_id}: {r.error}", file=sys.stderr)
        return 0 if done.errors.isEmpty() else 1

    if args.action == "run":
        return once()
    roots = [p for p in (getattr(logs, "root", None), *getattr(logs, "paths", ())) if p]
    watched = {"watch": roots} if roots and args.interval is None else {}
    runner.start(spark, once, f"{config.kb_path}/stream", args.interval or (1 if watched else config.loop.poll_interval_secs), **watched).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
