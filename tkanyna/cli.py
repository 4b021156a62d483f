"""Commands: generate, info, convert, stats, evaluate, predict."""

from __future__ import annotations

import argparse
import os
from functools import partial

from pyspark.sql import functions as F

from tkanyna.operators import generate, metrics
from tkanyna.operators.generate import create_client
from tkanyna.plans import corpus
from tkanyna.session import session
from tkanyna.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tkanyna", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    g = commands.add_parser("generate", help="generate dialect renderings of sentences")
    for name in ("input", "output", "rules"):
        g.add_argument(f"--{name}", required=True)
    g.add_argument("--dictionary")
    g.add_argument("--text-column", default="text")
    g.add_argument("--limit", type=int)
    g.add_argument("--batch-size", type=int, default=10)
    g.add_argument("--temperature", type=float, default=0.7)
    g.add_argument("--model", default="stub")
    g.add_argument("--provider", default="stub")
    g.add_argument("--url", default=generate.URL)
    g.add_argument("--referer", default="")
    g.add_argument("--title", default="")
    g.add_argument("--max-tokens", type=int, default=generate.MAX_TOKENS)
    g.add_argument("--run", help="module:name of what makes the function of a local model, of its name and quantisation")
    g.add_argument("--quantisation", default="fp16")
    g.add_argument("--top-p", type=float, default=0.9)
    g.add_argument("--repetition-penalty", type=float, default=1.1)
    g.add_argument("--no-resume", action="store_true")
    g.add_argument("--no-jsonl", action="store_true")
    i = commands.add_parser("info", help="show a rules file")
    i.add_argument("rules_file")
    for name in ("convert", "stats"):
        c = commands.add_parser(name)
        c.add_argument("input")
        if name == "convert":
            c.add_argument("output")
            c.add_argument("-v", "--verbose", action="store_true", help="show the rejected records")
        c.add_argument("-s", "--source-field", default="source_standard")
        c.add_argument("-t", "--target-field", default="generated_dialect")
    e = commands.add_parser("evaluate", help="score a file of predictions")
    for name in ("predictions", "references"):
        e.add_argument(name)
    e.add_argument("--output")
    r = commands.add_parser("predict", help="run a model over inputs, write predictions and references, and score them")
    for name in ("inputs", "references", "output"):
        r.add_argument(name)
    r.add_argument("--run", required=True, help="module:name of what makes the function from a list of texts to their predictions")
    r.add_argument("--batch-size", type=int, default=8)
    r.add_argument("--no-config", action="store_true", help="write the metrics alone")
    return p


def read_environment(path: str = ".env") -> None:
    """Sets what a file of NAME=value lines names and the environment lacks."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, mark, value = line.strip().removeprefix("export ").partition("=")
                if mark and name and not name.startswith("#"):
                    os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def client_options(args: argparse.Namespace) -> dict:
    options = {"temperature": args.temperature, "max_tokens": args.max_tokens}
    if args.provider == "openrouter":
        return options | {"url": args.url, "api_key": os.environ.get("OPENROUTER_API_KEY", ""), "referer": args.referer, "title": args.title}
    if args.provider == "local":
        if not args.run:
            raise SystemExit("a local model needs --run module:name")
        return options | {"run": args.run, "quantisation": args.quantisation, "sampling": {"temperature": args.temperature, "max_tokens": args.max_tokens, "top_p": args.top_p, "repetition_penalty": args.repetition_penalty}}
    return options


def loaded(run: str):
    """The function that predicts, made on a worker."""
    return generate.loaded(run)()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    read_environment()
    spark = session()
    if args.command == "generate":
        sentences = files.read_sentences(spark, args.input, args.text_column, limit=args.limit)
        make = partial(create_client, args.provider, args.model, **client_options(args))
        rows = corpus.generate_corpus(spark, sentences, args.rules, args.output, make, files.read_dictionary(spark, args.dictionary), args.batch_size, not args.no_resume, not args.no_jsonl)
        rows.groupBy("status").count().show()
    elif args.command == "info":
        name = spark.range(1).select(corpus.dialect_name(corpus.F.lit(args.rules_file))).first()[0]
        print(f"{args.rules_file}: dialect {name}, {len(files.read_rules(spark, args.rules_file))} characters")
    elif args.command in ("convert", "stats"):
        fields = (args.source_field, args.target_field)
        summary, reasons = corpus.convert(spark, args.input, args.output, *fields) if args.command == "convert" else corpus.stats(spark, args.input, *fields)
        summary.show(truncate=False)
        reasons.show(100, truncate=False)
        if args.command == "convert" and args.verbose:
            corpus.rejected(spark, args.input, *fields).show(1_000, truncate=False)
    elif args.command == "predict":
        inputs = files.read_inputs(spark, args.inputs)
        references = files.numbered(files.read_csv(spark, args.references, ["target"]).select(F.col("target").alias("reference")) if args.references.endswith(".csv") else files.read_lines(spark, args.references).withColumnRenamed("text", "reference"), "idx")
        config = {"inputs": args.inputs, "references": args.references, "run": args.run, "batch_size": args.batch_size}
        print(corpus.evaluation(inputs, references, partial(loaded, args.run), args.output, args.batch_size, None if args.no_config else config))
    else:
        said, meant = (files.numbered(files.read_lines(spark, p), "idx").withColumnRenamed("text", n) for p, n in ((args.predictions, "prediction"), (args.references, "reference")))
        found = metrics.compute_metrics(metrics.paired(said, meant))
        print(found)
        if args.output:
            files.write_metrics(found, args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
