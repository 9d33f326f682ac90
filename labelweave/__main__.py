"""Command line: ``python -m labelweave STAGE --train train.csv --test test.csv --root out [options]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from labelweave.plans.workspace import FEATURES, MODES, Workspace
from labelweave.sources import packs


def number_list(option: str) -> list[float]:
    """Option type: numbers between commas, at least one; anything else is a usage error."""
    found = []
    for part in filter(None, map(str.strip, option.split(","))):
        try:
            found.append(float(part))
        except ValueError:
            raise argparse.ArgumentTypeError(f"not a number: {part!r}") from None
    if not found:
        raise argparse.ArgumentTypeError("at least one number is needed")
    return found


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--train", default="train.csv")
    common.add_argument("--test", default="test.csv")
    common.add_argument("--root", default="outputs")
    common.add_argument("--mode", choices=[*MODES, "submit"], default="chronological")
    common.add_argument("--max-labels", type=int, help="first labels only, for a smoke run")
    common.add_argument("--max-rows", type=int, help="first rows of either table only, for a smoke run")
    common.add_argument("--config", help="JSON file with option values by stage; options on the command line win")
    top = argparse.ArgumentParser(prog="labelweave")
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(stage_name: str, /, **options: dict) -> None:
        sub = stages.add_parser(stage_name, parents=[common])
        for option, settings in options.items():
            sub.add_argument(f"--{option.replace('_', '-')}", dest=option, **settings)

    model = lambda default=None: {"default": default, "required": default is None}
    stage("audit")
    stage("split", val_size={"type": float, "default": 0.2}, seed={"type": int, "default": 42})
    stage("train-linear", features={"choices": list(FEATURES), "default": "v1"})
    stage("sweep", features={"choices": list(FEATURES), "default": "v1"})
    stage("forest")
    stage("embedding-mlp", embeddings=model())
    stage("embedding-knn", embeddings=model(), k={"type": int, "default": 20}, power={"type": float, "default": 2.0})
    stage("kmer-knn", k={"type": int, "default": 20}, power={"type": float, "default": 2.0}, name=model("v5_knn"))
    stage("blend-two", a=model(), b=model(), name=model(), step={"type": float, "default": 0.05})
    stage("blend-three", a=model(), b=model(), c=model(), name=model("v11_blend"), step={"type": float, "default": 0.05})
    numbers = {"type": number_list}
    stage("tune", base=model("v1_sgd"), name=model("v7_tuned"), ks=numbers, powers=numbers, step={"type": float, "default": 0.05})
    stage("fit-thresholds", model=model())
    stage("adaptive", base=model("v1_sgd"), other=model("v5_knn"))
    stage("label-specific", base=model("v1_sgd"), ks=numbers, powers=numbers, weights=numbers)
    stage("propagate", model=model("v7_tuned"), topk={"type": int, "default": 20}, min_cooc={"type": int, "default": 30}, betas=numbers)
    stage("stack", models={"nargs": "+", "required": True})
    stage("select", models={"nargs": "+", "required": True})
    stage("submit", limits_of=model("v7_tuned"))
    stage("variants", limits_of=model("v7_tuned"), scales={"type": number_list, "default": [1.00, 1.03, 1.06]})
    stage("submit-adaptive")
    stage("submit-label-specific")
    return top


def options_of(argv: list[str] | None = None) -> dict:
    """Options of a call: the parser's defaults, then the config file's part for the stage, then the command line."""
    top = parser()
    first = top.parse_args(argv)
    if first.config is None:
        return vars(first)
    given = packs.read_config(first.config).get(first.stage, {})
    unknown = sorted(set(given) - set(vars(first)) | {"config", "stage"} & set(given))
    if unknown:
        top.error(f"{first.config}: no such options of {first.stage}: {', '.join(unknown)}")
    stages = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction))
    stages.choices[first.stage].set_defaults(**given)
    return vars(top.parse_args(argv))


def main(argv: list[str] | None = None) -> None:
    options = options_of(argv)
    stage = options.pop("stage")
    mode = "submit" if stage.startswith("submit") else options.pop("mode", "chronological")
    for name in ("mode", "config"):
        options.pop(name, None)
    spark = SparkSession.builder.appName(f"labelweave {stage}").getOrCreate()
    where = [options.pop(name) for name in ("train", "test", "root")]
    space = Workspace(spark, *where, mode, options.pop("max_labels"), options.pop("max_rows"))
    getattr(space, stage.replace("-", "_"))(**options)


if __name__ == "__main__":
    main()
