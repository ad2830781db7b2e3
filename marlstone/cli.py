"""Commands: build, build-llm, ingestors, info, extract."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "build-llm"):
        b = commands.add_parser(name)
        b.add_argument("source")
        b.add_argument("--output", default="out.docpack")
        b.add_argument("--ingestor")
        b.add_argument("--embedder", default="hash-384")
        b.add_argument("--score-threshold", type=float)
        b.add_argument("--max-documented", type=int)
    commands.add_parser("ingestors")
    commands.add_parser("info").add_argument("pack")
    x = commands.add_parser("extract")
    x.add_argument("pack")
    x.add_argument("folder")
    args = parser.parse_args(argv)
    from .plans.ingestors import default_registry
    from .sources import pack

    if args.command == "ingestors":
        print("\n".join(default_registry().names()))
    elif args.command == "info":
        print(json.dumps(pack.pack_info(args.pack), indent=2, ensure_ascii=False))
    elif args.command == "extract":
        print("\n".join(pack.extract_pack(args.pack, args.folder)))
    else:
        from pyspark.sql import SparkSession

        from .plans.build import Config, build, write
        from .plans.documents import EchoGenerator
        from .session import ship

        spark = SparkSession.builder.appName("marlstone").getOrCreate()
        ship(spark)
        config = Config(args.source, ingestor=args.ingestor, embedder=args.embedder, score_threshold=args.score_threshold, max_documented=args.max_documented)
        print(write(build(spark, config, generator=EchoGenerator() if args.command == "build-llm" else None), config, args.output))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
