"""Command lines: ``python -m lodestrata.cli evaluate | compare | questions``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from lodestrata.operators import models, prepare
from lodestrata.operators.calls import Record
from lodestrata.plans import config, experiments, grid
from lodestrata.session import build
from lodestrata.sources import sinks
from lodestrata.sources.readers import Dataset, jsonl_entries
from lodestrata.sources.tables import materialise


def clients(e: config.Experiment, offline: bool) -> tuple:
    """The language and the embedding model of an experiment, or the offline stand-ins."""
    return (None, None) if offline else (models.llm(asdict(e.llm)), models.embedder(asdict(e.embedding)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata")
    todo = top.add_subparsers(dest="command", required=True)
    one = todo.add_parser("evaluate", help="run one experiment")
    one.add_argument("--config", "-c", required=True)
    many = todo.add_parser("compare", help="run several experiments and compare them")
    many.add_argument("--configs", nargs="+", required=True)
    for p in (one, many):
        p.add_argument("--dataset", "-d", required=True, help="documents, JSON Lines")
        p.add_argument("--pairs", help="question pairs, JSON Lines; template questions without")
        p.add_argument("--num-qa", "-n", type=int)
        p.add_argument("--out", "-o", default="results")
        p.add_argument("--offline", action="store_true", help="no model calls: hashed words and extracted answers")
    many.add_argument("--grid", action="store_true", help="one retrieval for all experiments that share an index")
    one.add_argument("--no-save", action="store_true")
    one.add_argument("--verbose", "-v", action="store_true", help="print a few evaluated rows")
    ask = todo.add_parser("questions", help="write question pairs on documents with a language model")
    ask.add_argument("--dataset", "-d", required=True)
    ask.add_argument("--out", "-o", required=True)
    ask.add_argument("--limit", type=int)
    ask.add_argument("--model", default="gpt-4o")
    ask.add_argument("--check", action="store_true", help="let the model check its pairs")
    ask.add_argument("--env", default=".env")
    for p in (one, many, ask):
        p.add_argument("--record", help="a folder that keeps answers and vectors: a run that was stopped goes on from it, and nothing is asked twice")
    return top


def records(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The records of answers and of vectors under the folder of --record."""
    return {"record": Record(spark, f"{args.record}/answers"), "vectors": Record(spark, f"{args.record}/vectors", "array<double>")} if args.record else {}


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    e = config.load(args.config)
    e = e.with_(subset=args.num_qa) if args.num_qa else e
    data = Dataset(spark, args.dataset, args.pairs, e.grouping)
    llm, embedder = clients(e, args.offline)
    row = experiments.run(data.get_documents(), data.get_qa_pairs(), e, llm=llm, embedder=embedder, folder=None if args.no_save else args.out, **records(spark, args)).first().asDict()
    if args.verbose:
        print(json.dumps(sinks.preview(data.get_qa_pairs()), ensure_ascii=False, default=str))
    print(json.dumps(row, ensure_ascii=False, default=str))
    return row


def compare(spark: SparkSession, args: argparse.Namespace) -> str:
    own = [config.load(p) for p in args.configs]
    own = [e.with_(subset=args.num_qa) if args.num_qa else e for e in own]
    data = Dataset(spark, args.dataset, args.pairs)
    if args.grid:
        make, embedder = (None, None) if args.offline else (lambda e: lambda: clients(e, False)[0], lambda e: clients(e, False)[1])
        found = grid.run_grid(data.get_documents(), data.get_qa_pairs(), own, make, embedder=embedder, **records(spark, args))
    else:
        given = {} if args.offline else {"clients": lambda e: clients(e, False)}
        found = experiments.compare(data.get_documents(), data.get_qa_pairs(), own, **given, **records(spark, args))
    text = sinks.write_comparison(found, args.out)
    print(text)
    return text


def questions(spark: SparkSession, args: argparse.Namespace, model=None) -> dict:
    """Without a key there is nothing to call, which is an error; ``model`` replaces the service."""
    key = models.environment(args.env).get("OPENAI_API_KEY")
    if model is None and not key:
        raise SystemExit("OPENAI_API_KEY is set neither in the environment nor in the file of --env")
    writer = model or models.ChatService(args.model, api_key=key, schema=prepare.QUESTION_SCHEMA)
    qa = prepare.model_questions(jsonl_entries(spark, args.dataset), lambda: writer, limit=args.limit, record=records(spark, args).get("record"))
    if args.check:
        judge = model or models.ChatService(args.model, max_tokens=200, api_key=key)
        qa = prepare.checked_questions(qa, lambda: judge, record=records(spark, args).get("record"))
    summary = sinks.write_dataset(materialise(spark, qa, "pairs"), args.out)
    print(json.dumps(summary, ensure_ascii=False, default=str))
    return summary


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(sys.argv[1:] if argv is None else argv)
    {"evaluate": evaluate, "compare": compare, "questions": questions}[args.command](build(), args)


if __name__ == "__main__":
    main()
