"""Command line: guide, suggest, run, rewrite, review and write over a folder of documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api, config
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliospark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("guide", "risk and protected spans of every document"), ("suggest", "facts that paragraphs could name"), ("run", "rewrite, review and write"), ("rewrite", "rewrite paragraph by paragraph, in the preset's passes"), ("review", "review revised files against originals"), ("write", "review revised files and write those that may be")):
        s = sub.add_parser(name, help=text)
        s.add_argument("path")
        if name in ("run", "rewrite", "review", "write"):
            s.add_argument("--out")
        if name in ("run", "rewrite"):
            s.add_argument("--preset", choices=list(config.PRESETS), default="academic_natural")
        if name in ("review", "write"):
            s.add_argument("revised")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    docs = api.load(spark, args.path)
    if args.command == "guide":
        api.guide_documents(docs).drop("protected").show(50, False)
        return 0
    if args.command == "suggest":
        api.suggestions(docs).show(50, False)
        return 0
    if args.command == "write" and not args.out:
        raise SystemExit("write needs --out")
    if args.command == "run":
        out = api.revise(docs, args.preset)
    elif args.command == "rewrite":
        out = api.rewrite_documents(docs, args.preset)
    else:
        name = F.regexp_extract("doc_id", r"([^/]+)$", 1)
        a = docs.select(name.alias("name"), F.col("text").alias("original"))
        b = api.load(spark, args.revised).select(name.alias("name"), F.col("text").alias("revised"))
        out = api.review_candidates(a.join(b, "name").select(F.col("name").alias("doc_id"), F.lit(1).alias("ordinal"), "original", "revised"))
    if args.out:
        api.write(out, args.out)
        files.write_reports(out.select("doc_id", "decision", "problems", "warnings", "changed", "gate"), f"{args.out}.report")
    shown = out.select("doc_id", "decision", "problems", "gate.write_allowed")
    shown.show(50, False)
    return 0 if shown.where("not write_allowed").isEmpty() else 1


if __name__ == "__main__":
    raise SystemExit(main())
