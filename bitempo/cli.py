"""Command line: init, remember, recall, about and review over a store folder."""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from bitempo.commands import Session, hit_line, review_line, words
from bitempo.config import TEMPLATE, Config
from bitempo.operators.extract import prompted, stub_completer
from bitempo.operators.recall import Query
from bitempo.sources.storage import Snapshots

render = words


def stub_embedding(text: str, dim: int) -> list[float]:
    """A stand-in for an embedding model: bytes summed by position."""
    out = [0.0] * dim
    for i, b in enumerate(text.encode()):
        out[i % dim] += b
    if not any(out):
        out[0] = 1.0
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bitempo")
    p.add_argument("--store", default="memory")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    r = sub.add_parser("remember")
    r.add_argument("text")
    r.add_argument("--speaker")
    r.add_argument("--session", default="cli")
    q = sub.add_parser("recall")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=5)
    q.add_argument("--entity", type=int)
    q.add_argument("--source")
    q.add_argument("--valid-at", type=int)
    q.add_argument("--as-of", type=int)
    a = sub.add_parser("about")
    a.add_argument("entity", type=int)
    a.add_argument("attribute")
    a.add_argument("--valid-at", type=int)
    a.add_argument("--as-of", type=int)
    v = sub.add_parser("review")
    v.add_argument("action", nargs="?", choices=["list", "confirm", "reject"], default="list")
    v.add_argument("id", nargs="?", type=int)
    sub.add_parser("serve")
    return p


def models(config: Config):
    """(completer, embedder): over HTTP where a provider is configured, stand-ins elsewhere."""
    if config.provider:
        from bitempo.providers import HttpProvider

        p = HttpProvider(**config.provider)
        return prompted(p.complete), p.embed
    dim = config.dim
    return stub_completer, lambda text: stub_embedding(text, dim)


def open_session(spark: SparkSession, folder: str) -> Session:
    with open(os.path.join(folder, "config.toml")) as f:
        config = Config(f.read())
    return Session(spark, Snapshots(spark, os.path.join(folder, "tables")), config, *models(config))


def init(folder: str, force: bool, dim: int | None = None) -> str:
    """Write the configuration; dim is what a provider's model was probed to give."""
    file = os.path.join(folder, "config.toml")
    if os.path.exists(file) and not force:
        raise SystemExit("the store has a configuration; --force overwrites it")
    os.makedirs(folder, exist_ok=True)
    with open(file, "w") as f:
        f.write(TEMPLATE if dim is None else TEMPLATE.replace("dim = 64", f"dim = {dim}"))
    return file


def run(spark: SparkSession, argv: list[str], now: int | None = None) -> list[str]:
    """The lines that a command prints."""
    args = parser().parse_args(argv)
    now = int(time.time() * 1000) if now is None else now
    if args.command == "init":
        return [f"wrote {init(args.store, args.force)}"]
    s = open_session(spark, args.store)
    if args.command == "serve":
        import sys

        from bitempo.server import Server

        Server(s).serve(sys.stdin, sys.stdout, lambda: int(time.time() * 1000))
        return []
    told = lambda x, lines: [json.dumps(x)] if args.json else lines
    if args.command == "remember":
        got = s.remember(args.text, now, args.session, args.speaker)
        return told(got, [f"{m['name']} ({m['kind']}): {'recognised as' if m['outcome'] == 'merged' else 'new,'} {m['entity']}" for m in got["mentions"]] + [f"{got['versions']} versions written"] + [f"dropped: {w}" for w in got["dropped"]])
    if args.command == "recall":
        q = Query(args.k, entity=args.entity, source=args.source)
        if args.valid_at is not None or args.as_of is not None:
            q = q.as_of(now if args.valid_at is None else args.valid_at, now if args.as_of is None else args.as_of)
        hits = s.recall(args.text, q)
        return told(hits, [hit_line(h) for h in hits])
    if args.command == "about":
        a = s.about(args.entity, args.attribute, now if args.valid_at is None else args.valid_at, now if args.as_of is None else args.as_of)
        return told(a, [words(**a)])
    if args.action == "list":
        open_ = s.reviews()
        return told(open_, [review_line(r) for r in open_])
    if args.id is None:
        raise SystemExit("which review?")
    done = s.settle(args.id, args.action == "confirm")
    return told(done, [f"merged into {done['survivor']}" if "survivor" in done else f"settled {args.id} as different"])


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("bitempo").getOrCreate()
    for line in run(spark, sys.argv[1:]):
        print(line)


if __name__ == "__main__":
    main()
