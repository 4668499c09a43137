"""Seconds per headline query; prints one JSON line.

`queries` has every key run from the source tables to its last row; nothing is
kept between keys. `stored` has the reports run over a clean Parquet table that
is written once (`build` seconds), the way a batch run serves them. One untimed
round warms each key, then it counts with the median of BENCH_REPEAT (default 3).

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default: all)
BENCH_KEYS    space-separated keys instead of the headline list, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from catalens.bindings.queries import CatalogReport, queries
from catalens.bindings.tables import catalog
from catalens.session import session
from catalens.sources.files import materialise, remove, shared_folder

HEADLINE = (
    "clean_full clean_diagnostics dq_enforce sink_parquet "
    "summary_kpis eda_genre_stats eda_yearly_trend eda_runtime_buckets eda_language_stats "
    "q01_top_rated q01_top10_per_decade q02_top_roi q02_yearly_money q03_genre_stats q03_genre_revenue "
    "q04_language_rating q05_runtime_range q06_most_popular_per_year q07_title_search q07_overview_search "
    "q08_above_average q08_language_top q08_revenue_percentile q09_rank_dense_rank q09_genre_rank "
    "q09_decade_dense_top3 q09_lead_revenue q09_lag_growth q09_language_windows "
    "l_tracked_genre_rating l_roi_inline slice_kpis slice_top_genres slice_rating_histogram"
)


def timed(run: Callable[[], DataFrame], repeat: int) -> float:
    rounds = []
    for _ in range(repeat + 1):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        rounds.append(time.perf_counter() - start)
    return round(statistics.median(rounds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    available = queries()
    chosen = os.environ.get("BENCH_KEYS", HEADLINE)
    keys = list(available) if chosen == "all" else chosen.split()
    spark = session(cpus=int(os.environ.get("BENCH_CPUS", "0")) or None)

    direct: dict[str, float] = {}
    for key in keys:
        direct[key] = timed(lambda: available[key](spark, sf_dir), repeat)
        print(f"{key:28s} {direct[key]:7.3f}", file=sys.stderr, flush=True)

    start = time.perf_counter()
    folder = shared_folder(spark)
    table = materialise(catalog(spark, sf_dir), folder)
    build = round(time.perf_counter() - start, 3)
    stored: dict[str, float] = {}
    for key in keys:
        if isinstance(available[key], CatalogReport):
            stored[key] = timed(lambda: available[key].over(table), repeat)
            print(f"{key:28s} {stored[key]:7.3f} stored", file=sys.stderr, flush=True)

    remove(spark, folder)

    print(json.dumps({
        "metric": "headline queries from source tables, total of medians",
        "value": round(sum(direct.values()), 3),
        "unit": "sec",
        "queries": direct,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "build": build,
        "stored": stored,
        "stored_total": round(sum(stored.values()), 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
