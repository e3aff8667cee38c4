"""Run a whole job (``python -m vectext --config job.json``) or one table job (``python -m vectext shuffle --input a --output b``)."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from vectext import fixed_values as fx
from vectext.plans import table_jobs as tj
from vectext.plans.jobs import STEPS, run_job


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON config from any path Spark can read; YAML where PyYAML is there."""
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def add_table_jobs(commands) -> None:
    """A command for each job from stored tables to stored tables."""

    def command(name: str, run, many: bool = False) -> argparse.ArgumentParser:
        parser = commands.add_parser(name, help=(run.__doc__ or "").splitlines()[0])
        parser.add_argument("--inputs" if many else "--input", required=True, nargs="+" if many else None)
        parser.add_argument("--output", required=True)
        parser.set_defaults(run=run)
        return parser

    clean = command("filter", tj.filter_corpus, many=True)
    clean.add_argument("--length", type=int, help="first clean rows to keep; default all")
    clean.add_argument("--text", default="content")
    clean.add_argument("--score", default="score")
    clean.add_argument("--chars", type=int, default=fx.PREFIX_CHARS, help="opening compared by dedup; 0 for the whole text")
    command("merge", tj.merge_tables, many=True)
    reuse = command("reuse", tj.reuse_table)
    reuse.add_argument("--prior", required=True)
    reuse.add_argument("--min-share", type=float, default=fx.MIN_MATCH_SHARE)
    reuse.add_argument("--template", default=fx.CRITIC_TEMPLATE)
    command("recover", tj.recover_tables, many=True).add_argument("--template", default=fx.CRITIC_TEMPLATE)
    for name, run in (("shuffle", tj.shuffle_table), ("permute", tj.permute_table)):
        command(name, run).add_argument("--seed", type=int, default=42)
    command("check", tj.check_vectors).add_argument("--vector", default="activation_vector")


def parse(words: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="vectext", description=__doc__)
    commands = parser.add_subparsers(required=True)
    job = commands.add_parser("job", help="run the steps of a config")
    job.add_argument("--config", required=True)
    job.add_argument("--steps", help=f"comma-separated, from {','.join(STEPS)}; default all the config enables")
    job.add_argument("--override", nargs="*", default=[], help="settings such as corpus.start=100")
    job.set_defaults(run=run_job)
    add_table_jobs(commands)
    words = list(sys.argv[1:] if words is None else words)
    # A call without a command is a job.
    return parser.parse_args(["job", *words] if words and words[0].startswith("--") and words[0] != "--help" else words)


def main(words: Sequence[str] | None = None) -> None:
    options = vars(parse(words))
    run = options.pop("run")
    spark = SparkSession.builder.appName("vectext").getOrCreate()
    if run is run_job:
        steps = options["steps"].split(",") if options["steps"] else None
        for name, path in run_job(spark, read_config(spark, options["config"]), steps, options["override"]).items():
            print(f"{name}: {path}")
        return
    source = options.pop("inputs", None) or options.pop("input")
    if options.get("chars") == 0:
        options["chars"] = None
    if run is tj.reuse_table:
        run(spark, source, options.pop("prior"), **options)
    else:
        run(spark, source, **options)
    print(options["output"])


if __name__ == "__main__":
    main()
