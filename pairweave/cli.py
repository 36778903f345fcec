"""Command line: ``python -m pairweave.cli [options] <distances> <assignments>``."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from pairweave import __version__
from pairweave.plans.cluster import METHODS, ClusterOptions, build_graph, cluster
from pairweave.sources.pairs import header_of, read_objects, read_pairs, write_single_file

log = logging.getLogger("pairweave")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairweave", description="Cluster the objects of a sparse pair table.")
    p.add_argument("distances")
    p.add_argument("assignments")
    p.add_argument("--algo", choices=METHODS, default="single")
    p.add_argument("--objects-file")
    p.add_argument("--id-cols", nargs=2, metavar=("A", "B"))
    p.add_argument("--numeric-ids", action="store_true")
    p.add_argument("--distance-col")
    p.add_argument("--similarity", action="store_true")
    p.add_argument("--percent-similarity", action="store_true")
    p.add_argument("--min", nargs=2, action="append", default=[], metavar=("COLUMN", "VALUE"))
    p.add_argument("--max", nargs=2, action="append", default=[], metavar=("COLUMN", "VALUE"))
    p.add_argument("--out-representatives", action="store_true")
    p.add_argument("--out-csv", action="store_true")
    p.add_argument("--leiden-resolution", type=float, default=0.7)
    p.add_argument("--leiden-beta", type=float, default=0.01)
    p.add_argument("--leiden-iterations", type=int, default=2)
    p.add_argument("-t", type=int, default=4, help="accepted for compatibility; the session decides")
    p.add_argument("-v", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.v else logging.WARNING, format="%(message)s")
    spark = SparkSession.builder.appName("pairweave").getOrCreate()
    low, high = [(c, float(v)) for c, v in args.min], [(c, float(v)) for c, v in args.max]
    options = ClusterOptions(
        algo=args.algo,
        id_cols=tuple(args.id_cols) if args.id_cols else None,
        distance_col=args.distance_col,
        kind="percent" if args.percent_similarity else "similarity" if args.similarity else "distance",
        minimum=low,
        maximum=high,
        numeric_ids=args.numeric_ids,
        representatives=args.out_representatives,
        leiden={"resolution": args.leiden_resolution, "beta": args.leiden_beta, "iterations": args.leiden_iterations},
    )
    try:
        options = options.resolve(header_of(spark, args.distances))
        began = time.time()
        pairs, order = read_pairs(spark, args.distances, id_cols=options.id_cols, distance_col=options.distance_col, filters=[c for c, _ in low + high], numeric_ids=args.numeric_ids)
        objects = read_objects(spark, args.objects_file) if args.objects_file else None
        if args.v:
            from pairweave.operators.edges import distance_histogram

            graph = build_graph(pairs, ClusterOptions(**{**vars(options), "algo": "complete"}), order=order)
            log.info("vertices: %d, edges: %d", graph.vertices.count(), graph.edges.count())
            for row in distance_histogram(graph.edges).orderBy("bin").collect():
                log.info("distance < %s: %d", row["upper"], row["n"])
        assigned = cluster(pairs, objects=objects, order=order, options=options)
        write_single_file(assigned, args.assignments, csv=args.out_csv)
        log.info("seconds: %.1f", time.time() - began)
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    except (PySparkException, Py4JJavaError) as error:
        # a row that can't be read ends a task; what it says is the first line that names it
        lines = [line.strip() for line in str(error).splitlines() if line.strip()]
        said = next((line for line in lines if "ill-formatted" in line), lines[0] if lines else type(error).__name__)
        print(f"error: {said}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
