"""Start a node: ``python -m hashloom --dir file:///data``."""

from __future__ import annotations

import argparse
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from hashloom.catalog import Catalog
from hashloom.index import IndexOptions
from hashloom.replica import Replica
from hashloom.server import FeedServer, IndexServer
from hashloom.session import LineServer
from hashloom.sources.feed import Feed
from hashloom.sources.remote import HttpPeer, RemoteFeed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hashloom", description=__doc__)
    p.add_argument("--dir", default="data", help="folder of the indexes or of the feed, a URL of any store Spark writes")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8080)
    p.add_argument("--checkpoint-threshold", type=int, default=100_000, help="logged items that make a checkpoint due")
    p.add_argument("--checkpoint-age-ms", type=int, default=60_000, help="age of the oldest logged change that makes one due; 0: never by age")
    p.add_argument("--legacy-port", type=int, default=0, help="port of the line protocol; 0: off")
    p.add_argument("--load-concurrency", type=int, default=0, help="indexes loaded or kept up at the same time; 0: 8")
    p.add_argument("--coordinator", action="store_true", help="serve the feeds instead of indexes")
    p.add_argument("--coordinator-url", default="", help="follow the feeds at this address")
    p.add_argument("--peers", default="", help="comma-separated addresses of nodes that may donate snapshots")
    p.add_argument("--bootstrap-timeout-ms", type=int, default=1_800_000, help="deadline of a bootstrap transfer; 0: none")
    return p


def main(args: list[str]) -> None:
    options, unknown = parser().parse_known_args(args)
    for flag in unknown:
        print(f"ignoring unknown option {flag}", file=sys.stderr)
    spark = SparkSession.builder.appName("hashloom").getOrCreate()
    address = (options.host, options.port)
    if options.coordinator:
        FeedServer(Feed(spark, options.dir), address).serve_forever()
        return
    catalog = Catalog(spark, options.dir, IndexOptions(checkpoint_threshold=options.checkpoint_threshold, checkpoint_age_ms=options.checkpoint_age_ms), options.load_concurrency or 8)
    replica = None
    if options.coordinator_url:
        deadline = options.bootstrap_timeout_ms / 1000 or None
        replica = Replica(spark, catalog, RemoteFeed(spark, options.coordinator_url), [HttpPeer(u, transfer_timeout_s=deadline) for u in options.peers.split(",") if u])
        replica.catch_up_meta()
    if options.legacy_port:
        threading.Thread(target=LineServer(catalog, (options.host, options.legacy_port), replica is not None).serve_forever, daemon=True).start()

    def keep(name: str) -> None:
        """One index: follow its feed, fold its log, delete what nothing needs. Another turn follows whatever happens."""
        try:
            if replica:
                replica.sync(name)
            index = catalog.get(name)
            index.maintain()
            index.vacuum()
        except Exception as e:  # noqa: BLE001: a failed job must not end upkeep
            print(f"upkeep of {name}: {type(e).__name__} {str(e)[:500]}", file=sys.stderr)

    def upkeep() -> None:
        with ThreadPoolExecutor(max_workers=options.load_concurrency or 8) as pool:
            while True:
                time.sleep(1)
                try:
                    if replica:
                        replica.follow_meta()
                    list(pool.map(keep, catalog.names()))
                except Exception as e:  # noqa: BLE001
                    print(f"upkeep: {type(e).__name__} {str(e)[:500]}", file=sys.stderr)

    threading.Thread(target=upkeep, daemon=True).start()
    IndexServer(catalog, address, replica).serve_forever()


if __name__ == "__main__":
    main(sys.argv[1:])
