"""Stages from the command line.

    python -m loomgraph discover ROOT [--company NAME]
    python -m loomgraph pipeline SETTINGS --parser MODULE:NAME [--extractor MODULE:NAME] [--company NAME] [--force]
                                               filings -> graph, what is new; SETTINGS is a JSON file of folders
    python -m loomgraph build PARSED OUT [--extractor MODULE:NAME]
                                               parsed documents (JSON) -> graph; without one, the offline extractor
    python -m loomgraph ingest EXTRACTED OUT   extraction results (JSON file or folder) -> graph
    python -m loomgraph summary GRAPH
    python -m loomgraph search GRAPH TEXT [--type TYPE]
    python -m loomgraph neighbors GRAPH ID [--depth N]
"""

from __future__ import annotations

import argparse
import importlib
from typing import Any

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F


def _named(place: str | None) -> Any:
    """What stands at module:name."""
    if place is None:
        return None
    module, name = place.split(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("stage", choices=("discover", "pipeline", "build", "ingest", "summary", "search", "neighbors"))
    parser.add_argument("path")
    parser.add_argument("more", nargs="?")
    parser.add_argument("--company")
    parser.add_argument("--parser")
    parser.add_argument("--extractor")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--type")
    parser.add_argument("--depth", type=int, default=1)
    args = parser.parse_args(argv)

    from .operators import extraction, loading
    from .plans import build, pipeline
    from .plans.session import GraphSession, Settings
    from .sources import documents, filings

    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if args.stage == "discover":
        filings.discover(spark, args.path, args.company).orderBy("filing_ord").show(1000, truncate=False)
    elif args.stage == "pipeline":
        if not args.parser:
            parser.error("pipeline needs --parser")
        states = pipeline.run(spark, Settings.read(args.path), _named(args.parser), _named(args.extractor) or extraction.NameExtractor(), args.company, args.force)
        states.orderBy("document_id", "stage").show(1000, truncate=False)
    elif args.stage == "build":
        built = build.build(documents.blocks_of_tree(documents.read_parsed(spark, args.path)), _named(args.extractor) or extraction.NameExtractor())
        loading.write_snapshot(built.nodes, built.edges, args.more)
        built.summary.orderBy("doc_ord").show(1000, truncate=False)
        built.errors.show(1000, truncate=False)
    elif args.stage == "ingest":
        found = documents.read_extractions(spark, args.path)
        # Files are taken in the order of their names; there are few of them beside their records.
        ordered = found.select("file_path").distinct().withColumn("doc_ord", F.row_number().over(Window.orderBy("file_path")).cast("long"))
        built = build.graph_of(*documents.records(found.join(ordered, "file_path")), errors=found.select("document_id", F.explode("errors").alias("e")).select("document_id", "e.*"))
        loading.write_snapshot(built.nodes, built.edges, args.more)
        built.summary.orderBy("doc_ord").show(1000, truncate=False)
    else:
        graph = GraphSession(spark, *loading.read_snapshot(spark, args.path))
        if args.stage == "summary":
            print(graph.schema_summary())
        elif args.stage == "search":
            graph.search(args.more, args.type).select("entity_id", "entity_type", "name").show(truncate=False)
        else:
            graph.neighbors(args.more, args.depth).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
