"""`python -m marginalia.cli`: papers, paper, status, accept, reject, relate, migrate. Changes are only shown unless --write is given."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.workspace import Change, RefusedError, Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", allow_abbrev=False)
    p.add_argument("--root", default=".")
    p.add_argument("--repository", default="org/papers")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("papers", "paper"):
        s = sub.add_parser(verb, allow_abbrev=False)
        if verb == "paper":
            s.add_argument("directory")
        s.add_argument("--mirror", required=True)
        s.add_argument("--commit", required=True)
        s.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("status")
    s.add_argument("directory", nargs="?")
    for verb in ("accept", "reject", "relate", "migrate"):
        s = sub.add_parser(verb, allow_abbrev=False)
        s.add_argument("--write", action="store_true")
        s.add_argument("--dry-run", action="store_true")
        if verb in ("accept", "reject"):
            s.add_argument("directory")
            s.add_argument("key")
        if verb == "accept":
            s.add_argument("--match")
            s.add_argument("--id")
            s.add_argument("--projects", type=lambda x: x.split(","))
            s.add_argument("--publication", default="draft")
        if verb == "relate":
            s.add_argument("node")
            s.add_argument("--target", required=True)
            s.add_argument("--type", required=True)
        if verb in ("reject", "relate"):
            s.add_argument("--note", default="")
    return p


def show(change: Change) -> None:
    print("WROTE" if change.written else "DRY RUN", change.file)
    print(f"--- before\n{change.before}\n--- after\n{change.after}")


def run(w: Workspace, a: argparse.Namespace) -> None:
    write = getattr(a, "write", False) and not a.dry_run
    if a.verb in ("papers", "paper"):
        done = w.import_papers(a.mirror, a.commit, [a.directory] if a.verb == "paper" else None, a.dry_run)
        print(json.dumps({r.metric: r.value for r in done["report"].collect()}, indent=2))
    elif a.verb == "status":
        for r in w.status(a.directory).orderBy("paper", "source_key").toLocalIterator():
            print(r.paper, r.line)
    elif a.verb == "accept":
        show(w.accept(a.directory, a.key, a.match, a.id, a.projects, a.publication, write))
    elif a.verb == "reject":
        print(json.dumps(w.reject(a.directory, a.key, a.note, write), indent=2))
    elif a.verb == "relate":
        show(w.relate(a.node, a.target, a.type, a.note, write))
    else:
        print("\n".join(w.migrate(write)))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    w = Workspace(spark or SparkSession.builder.getOrCreate(), a.root, a.repository)
    try:
        with w.lock():
            run(w, a)
    except (RefusedError, ValueError, FileExistsError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
