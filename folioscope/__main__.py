"""Command line: ``python -m folioscope COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from folioscope.api import Engine
from folioscope.config import FILE_NAME, EngineConfig, load_config
from folioscope.operators import read, search


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    p.add_argument("--index", default=".folioscope-index", help="folder of the index")
    p.add_argument("--config", help=f"configuration file (else {FILE_NAME} upwards)")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple, **flags) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for flag, kind in flags.items():
            c.add_argument("--" + flag.replace("_", "-"), **({"action": "store_true"} if kind is bool else {"type": kind}))

    command("init")
    command("index", "root", force=bool, prune_outside_root=bool)
    command("reindex", "root", "path")
    command("status")
    command("search", "query", mode=str, limit=int, type=str, ext=str, path=str)
    command("semantic-search", "query", limit=int)
    command("embed")
    command("build-vector-index", lists=int)
    command("find", "name", type=str, limit=int)
    command("list", type=str, ext=str, limit=int, offset=int)
    command("read", "document", page=int, slide=int, sheet=str, section=str, symbol=str, line_start=int, line_end=int)
    command("outline", "document")
    command("related", "target")
    command("references", "symbol")
    command("context", "query", max_tokens=int, mode=str, ext=str)
    command("build-relationships")
    command("watch", "root")
    command("serve")
    command("rest", host=str, port=int)
    return p


def run(args: argparse.Namespace, engine: Engine) -> object:
    given = lambda **x: {k: v for k, v in x.items() if v is not None}
    match args.command:
        case "init":
            engine.init()
            return "created"
        case "index":
            return vars(engine.index(args.root, force=args.force, prune_outside_root=args.prune_outside_root))
        case "reindex":
            return vars(engine.reindex(args.root, args.path))
        case "status":
            return engine.status()
        case "search" | "semantic-search":
            more = vars(args)
            q = search.SearchQuery(args.query, args.limit or engine.config.search.default_limit, more.get("type"), more.get("ext"), more.get("path"))
            return engine.results(q, "semantic" if args.command == "semantic-search" else args.mode or "hybrid")
        case "embed":
            return engine.embed()
        case "build-vector-index":
            return engine.build_vector_index(**given(lists=args.lists))
        case "find":
            return engine.find(args.name, args.type, args.limit or 20)
        case "list":
            return engine.list(**given(document_type=args.type, extension=args.ext, limit=args.limit, offset=args.offset))
        case "read":
            return engine.read(read.ReadRequest(args.document, args.page, args.slide, args.sheet, args.section, args.symbol, args.line_start, args.line_end))
        case "outline":
            return engine.outline(args.document)
        case "related":
            return engine.related(args.target)
        case "references":
            return engine.references(args.symbol)
        case "context":
            return engine.context(args.query, args.max_tokens or 4000, args.mode or "hybrid", args.ext)["text"]
        case "build-relationships":
            return engine.build_relationships()
        case "watch":
            from folioscope.streaming.watch import watch

            watch(engine.store, args.root, args.index.rstrip("/") + "-watch", engine.config, embedder=engine.embedder, on_batch=lambda r: print(vars(r), flush=True)).awaitTermination()
        case "rest":
            from folioscope import rest

            http = rest.server(engine, args.host or rest.HOST, rest.PORT if args.port is None else args.port)
            print("http://{}:{}".format(*http.server_address[:2]), flush=True)
            http.serve_forever()
        case "serve":
            from folioscope.tools import Server

            Server(engine).serve()


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    config: EngineConfig = load_config(args.config)
    spark = SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    result = run(args, Engine(spark, args.index, config))
    if result is not None:
        print(result if isinstance(result, str) else json.dumps(result, indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
