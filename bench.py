"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query runs to the end
and its rows are consumed by a no-op sink, so nothing is pruned away.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "index_records",
    "events_shared_start",
    "event_sensor_rows",
    "record_samples",
    "asof_reference_index",
    "zeroed_waveforms",
    "bandpassed_waveforms",
    "aligned_samples",
    "waveform_features",
    "point_anomalies",
    "spectral_density",
    "modal_peaks",
    "packaging_gate",
    "acceleration_spectra",
    "status_bands",
    "metric_correlations",
    "set_comparison",
    "baseline_scores",
    "reference_scaling",
    "event_split",
)


def main() -> None:
    from spanwave.plans import catalog
    from spanwave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    spent: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
    total = round(sum(spent.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
