"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is written to the no-op sink, so all of its rows and columns are
computed and none reach the driver. Every timing includes reading the files.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from periodica import catalog  # noqa: E402
from periodica.catalog import registry  # noqa: E402
from periodica.session import build_session  # noqa: E402

HEADLINE = (
    "j04_calendar_yoy", "j04_calendar_yoy_sparse", "t01_last_complete_month", "a01_complete_sum", "a04_clipped_bucket_sums",
    "a10_year_median", "a11_distinct_per_month", "a13_first_appearance", "w02_trailing_sum", "w04_ordered_tracks", "w07_positive_streak",
    "w17_gap_fill", "f08_replacement_rules", "j06_nearest_prior", "j08_backward_asof", "j16_first_days_count", "j17_dense_grid",
    "q01_null_safe_upsert", "q05_history_guard", "q08_latest_vintage", "t04_indicator_summary", "t05_seasonal_band", "t13_borrowing_alignment",
    "t18_full_preparation", "t23_diffusion", "t27_rolling_activity", "s12_normalise_messages", "r05_area_entries",
    "n02_kl_divergence", "n03_lead_lag_scan", "n06_autocorrelation", "n09_rolling_backtest", "n11_factor_loadings", "n13_news_impacts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "16")), memory=os.environ.get("BENCH_MEMORY", "12g"))
    catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    base = os.path.basename(folder.rstrip("/"))
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(base[2:]) if base.startswith("sf") else base, "cpus": int(cpus), "spark": spark.version,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
