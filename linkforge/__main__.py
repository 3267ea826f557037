"""python -m linkforge STEP...: runs steps of a linkage over the folders of the configuration."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import LinkConfig
from .plans.linkage import Linkage

STEPS = {
    "prep": lambda x: [x.prep(s) for s in ("train", "test")], "mine": lambda x: x.mine(), "candidates-train": lambda x: x.candidates("train"),
    "candidates-test": lambda x: x.candidates("test"), "train": lambda x: x.train(), "evaluate": lambda x: x.evaluate(), "predict": lambda x: x.predict(),
    "train2": lambda x: x.train2(), "predict2": lambda x: x.predict2(), "selftrain": lambda x: x.selftrain(), "train3": lambda x: x.train3(),
    "predict3": lambda x: x.predict3(), "shift": lambda x: x.shift(), "all": lambda x: x.run(),
}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="linkforge", description=__doc__)
    p.add_argument("steps", nargs="+", choices=STEPS)
    for name in ("data", "work", "out"):
        p.add_argument(f"--{name}")
    a = p.parse_args(args)
    config = LinkConfig.from_env(**{k: v for k in ("data", "work", "out") if (v := getattr(a, k))})
    job = Linkage(SparkSession.builder.appName("linkforge").getOrCreate(), config)
    for step in a.steps:
        print(step, STEPS[step](job), flush=True)


if __name__ == "__main__":
    main()
