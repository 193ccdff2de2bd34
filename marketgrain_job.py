"""Entry point for spark-submit: the nine CSV tables in, all published tables out."""

from __future__ import annotations

import argparse

from marketgrain.job import JobOptions, run
from marketgrain.plans.marketplace import Marketplace
from marketgrain.session import marketplace_session
from marketgrain.sources.readers import read_sources, store_sources


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source")
    parser.add_argument("output")
    parser.add_argument("--jdbc-url")
    arguments = parser.parse_args()
    spark = marketplace_session()
    tables = store_sources(read_sources(spark, arguments.source), f"{arguments.output}/source")
    run(spark, Marketplace.from_raw(tables), arguments.output, JobOptions(jdbc_url=arguments.jdbc_url))


if __name__ == "__main__":
    main()
