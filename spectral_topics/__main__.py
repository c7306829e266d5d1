"""``python -m spectral_topics``: fit a bag-of-words text corpus and write the model as text.

Memory, cores and the master are Spark settings, not arguments.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spectral_topics.functions.storage import Scratch
from spectral_topics.plans.model import SEED, VARIANTS, fit
from spectral_topics.sources.text import read_bow_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spectral_topics")
    p.add_argument("--input", required=True, help="bag-of-words text: docId nUnique id:count ...")
    p.add_argument("--output", required=True, help="prefix of the .alpha and .beta folders")
    p.add_argument("--partitions", type=int, help="corpus partitions (default: spark.sql.shuffle.partitions)")
    p.add_argument("--d", type=int, help="vocabulary size (default: largest word id + 1)")
    p.add_argument("--k", type=int, required=True, help="topics")
    p.add_argument("--kprime", type=int, required=True, help="sketch width, k <= kprime <= d")
    p.add_argument("--alpha0", type=float, required=True, help="Dirichlet concentration")
    p.add_argument("--rho", type=float, default=0.0, help="ridge weight")
    p.add_argument("--tolerance", type=float, default=1e-4)
    p.add_argument("--max_iterations", type=int, default=0, help="0: until converged")
    p.add_argument("--hard_cap", type=int, help="bound on iterations until convergence; reaching it is an error")
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--variant", choices=VARIANTS, default="reference")
    p.add_argument("--run", help="name of the run: started again under it, a fit that broke off goes on from its last finished table")
    p.add_argument("--mode", choices=("failfast", "permissive"), default="failfast")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spectral_topics").getOrCreate()
    with Scratch(spark, args.run):
        docs, tokens = read_bow_text(spark, args.input, args.mode)
        model = fit(
            docs,
            tokens,
            k=args.k,
            k_prime=args.kprime,
            alpha0=args.alpha0,
            vocab_size=args.d,
            rho=args.rho,
            tol=args.tolerance,
            max_iter=args.max_iterations,
            partitions=args.partitions,
            seed=args.seed,
            variant=args.variant,
            hard_cap=args.hard_cap,
        )
        model.write_text(args.output)
    if not model.converged and args.max_iterations <= 0:
        raise SystemExit(f"no convergence after {model.n_iter} iterations; the model written is that of the last one")


if __name__ == "__main__":
    main()
