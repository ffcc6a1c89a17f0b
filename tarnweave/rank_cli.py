"""Command line: PageRank of edge lists.

python -m tarnweave.rank_cli EDGES [EDGES ...] --output ranks [--beta 0.8] [--epsilon 0.1] [--max-iter 100] [--multi-edges distinct] [--strict]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.graph import pagerank, top_ranks
from .sources.text import read_edges, write_key_values


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("edges", nargs="+")
    out.add_argument("--output", required=True)
    out.add_argument("--beta", type=float, default=0.8)
    out.add_argument("--epsilon", type=float, default=0.1)
    out.add_argument("--max-iter", type=int, default=100)
    out.add_argument("--multi-edges", choices=("distinct", "weight"), default="distinct")
    out.add_argument("--strict", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Writes node and rank, tab-separated, and returns the report."""
    a = parser().parse_args(argv)
    if not 0 <= a.beta <= 1:
        raise ValueError("beta is between 0 and 1")
    spark = spark or SparkSession.builder.getOrCreate()
    began = time.perf_counter()
    ranked = pagerank(read_edges(spark, a.edges, strict=a.strict), a.beta, a.epsilon, a.max_iter, a.multi_edges)
    write_key_values(ranked.ranks, a.output)
    return {"nodes": ranked.peeled.n_nodes, "passes": ranked.peeled.passes, "steps": ranked.steps, "trace": ranked.trace, "top": top_ranks(ranked.ranks), "seconds": time.perf_counter() - began}


if __name__ == "__main__":
    for name, value in main().items():
        print(name)
        value.show(truncate=False) if hasattr(value, "show") else print(value)
