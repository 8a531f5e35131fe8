"""Command line: python -m tolmach FOLDER COMMAND ..."""

from __future__ import annotations

import argparse

from .engine import Engine
from .session import build_session
from .sources.tables import save_file


def parser() -> argparse.ArgumentParser:
    """Commands and their arguments."""
    top = argparse.ArgumentParser(prog="tolmach")
    top.add_argument("folder", help="where the tables are kept")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("projects")
    new = sub.add_parser("new-project")
    for name in ("name", "source", "target"):
        new.add_argument(name)
    new.add_argument("--tolerance", type=float)
    add = sub.add_parser("import")
    add.add_argument("project", type=int)
    add.add_argument("path")
    sub.add_parser("files")
    sub.add_parser("recheck")
    sub.add_parser("issues")
    ask = sub.add_parser("suggest")
    ask.add_argument("project", type=int)
    ask.add_argument("text")
    ask.add_argument("--limit", type=int, default=5)
    ask.add_argument("--least", type=float, default=0.0)
    out = sub.add_parser("export")
    out.add_argument("to")
    out.add_argument("--file", type=int)
    out.add_argument("--approved", action="store_true")
    sub.add_parser("inconsistencies").add_argument("--limit", type=int, default=200)
    words = sub.add_parser("glossary")
    words.add_argument("project", type=int)
    words.add_argument("term", nargs="*", help="source and target of a term to add")
    words.add_argument("--remove", type=int)
    sub.add_parser("remember")
    return top


def run(engine: Engine, args: argparse.Namespace) -> None:
    """Run one command and print what it gives."""
    show = lambda df: df.show(500, truncate=60)
    match args.command:
        case "projects":
            show(engine.projects())
        case "new-project":
            print(engine.add_project(args.name, args.source, args.target, args.tolerance))
        case "import":
            show(engine.import_files(args.path, args.project))
        case "files":
            show(engine.files())
        case "recheck":
            print(engine.recheck())
        case "issues":
            show(engine.issue_totals())
        case "suggest":
            show(engine.search(args.project, [args.text], args.limit, args.least))
        case "export":
            print(save_file(engine.export(args.file, args.approved), args.to))
        case "inconsistencies":
            show(engine.inconsistencies(args.limit))
        case "glossary":
            if args.remove is not None:
                engine.remove_term(args.remove)
            elif len(args.term) == 2:
                engine.add_terms(engine.spark.createDataFrame([(args.project, *args.term, False)], "project_id long, source_term string, target_term string, case_sensitive boolean"))
            show(engine.glossary(args.project))
        case "remember":
            print(engine.remember())


if __name__ == "__main__":
    arguments = parser().parse_args()
    run(Engine(build_session(), arguments.folder), arguments)
