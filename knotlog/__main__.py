"""``python -m knotlog ROOT COMMAND ...``: the engine from a shell.

For ``federate`` the root is the manifest that names the repositories.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from knotlog.api import Engine, federated
from knotlog.plans.requests import manifest
from knotlog.session import session
from knotlog.sources.collections import render
from knotlog.sources.files import toml


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="knotlog")
    p.add_argument("root")
    p.add_argument("--format", choices=["text", "json", "yaml"], default="text")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"scan": ["folder"], "query": ["text"], "explain": ["text"], "recall": ["text"], "graph": ["ref"], "history": ["kind", "id"], "context": ["paths"], "topology": [], "diagnostics": [], "compact": [], "vacuum": [], "federate": ["text"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a, nargs="+" if a == "paths" else None)
        if name == "graph":
            s.add_argument("--depth", type=int, default=5)
            s.add_argument("--direction", default="forward")
            s.add_argument("--edge", default="")
            s.add_argument("--as-of", default="")
        if name == "context":
            s.add_argument("--workflow", default="explore")
            s.add_argument("--budget", type=int, default=0)
        if name == "federate":
            s.add_argument("--limit", type=int, default=0)
            s.add_argument("--at-once", type=int, default=8)
            s.add_argument("--seconds", type=float)
    a = p.parse_args(argv)
    if a.command == "federate":
        rows, errors = federated(session(), manifest(toml(Path(a.root).read_text()))[0], a.text, a.limit, a.at_once, a.seconds)
        if rows is not None:
            print(render(rows, a.format))
        for repo, error in errors.items():
            print(f"{repo}: {error}", file=sys.stderr)
        return
    e = Engine(session(), a.root)
    if a.command == "scan":
        print(f"snapshot {e.scan(a.folder)}")
    elif a.command == "explain":
        print(e.explain(a.text))
    elif a.command == "compact":
        print(f"snapshot {e.store.compact()}")
    elif a.command == "vacuum":
        print(f"{e.store.vacuum()} files")
    elif a.command == "topology":
        for part in e.topology():
            print(render(part, a.format))
    else:
        found = {
            "query": lambda: e.query(a.text), "recall": lambda: e.recall(a.text), "graph": lambda: e.graph(a.ref, a.depth, a.direction, a.edge, a.as_of),
            "history": lambda: e.history(a.kind, a.id), "context": lambda: e.context(a.paths, a.workflow, a.budget), "diagnostics": e.store.diagnostics,
        }[a.command]()
        print(render(found, a.format))


if __name__ == "__main__":
    main()
