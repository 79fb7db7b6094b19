"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rillflow.plans.catalog import CATALOG  # noqa: E402
from rillflow.session import build_session  # noqa: E402

HEADLINES = [
    "win_tumble_label", "win_tumble_batch", "src_envelope_decode", "src_replay", "decode_json_default",
    "decode_json_extend", "decode_nested", "decode_quarantine", "json_get", "json_path_flatten", "q_view_watermark",
    "q_microbatch_sql", "sink_fanout", "sink_accumulate", "sink_foreach", "mutate_upsert", "mutate_update",
    "join_inner", "join_inner_spread", "join_theta", "join_range", "join_interval", "join_asof", "join_stream_static",
    "stream_interval_join", "agg_basic_having", "agg_count_distinct", "agg_array_distinct", "agg_cube", "win_rank",
    "win_lag_lead", "win_rows_frame", "win_range_frame", "win_session", "win_hop", "stream_watermark",
    "stream_session", "stream_dedup", "stream_keyed_state", "stream_late_rows", "sort_multi", "topk_per_group",
    "set_intersect", "udf_scalar", "udaf_custom", "udtf_custom",
]


def timed(run, spark, folder: str) -> float:
    begin = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run = CATALOG[name].run
        timed(run, spark, folder)
        seconds[name] = round(statistics.median(timed(run, spark, folder) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
