"""Time the headline queries. Prints one JSON line.

The derived messages are written to Parquet once, as a store would hold them;
every query then reads that table, after one warm-up run, with the result
forced by a no-op write. A query slower than five seconds is timed once, any
other three times, of which the median counts.

BENCH_SF_DIR   folder of the tables       (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                (default 8)
BENCH_COPIES   copies of the messages     (default 1; shifted ids and users keep their share)
BENCH_QUERIES  comma-separated names      (default the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from parley import session  # noqa: E402
from parley.plans.registry import REGISTRY, Inputs  # noqa: E402

HEADLINE = """
overview_totals top_chatters chatter_quantiles active_chatters roles_seen staff_list subscriber_list hourly weekday_hour
per_day peaks_5m trend weekly_seasonality first_message_hours new_returning session_summary concentration_of_users lorenz
anomalies_5m length_trend cohort_retention bot_scores top_emotes emote_pairs emote_centrality emote_entropy
emote_diversity top_words vocabulary zipf_slope top_commands top_phrases top_urls top_domains platform_links top_mentions
mention_graph mutual_mentions quote_reply_pairs top_repeated self_repetition copy_paste_chains non_ascii message_classes
data_checks language_breakdown channel_totals top_movers channel_logs filter_window
""".split()


def prepare(spark, folder: str, copies: int) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="parley-bench-"), "messages")
    rows = Inputs(spark, folder).with_lang
    if copies > 1:
        copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
        rows = rows.withColumn("copy", copy).withColumn("id", F.concat("id", F.lit("-"), "copy"))
        rows = rows.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("copy") * F.lit(0.37))).drop("copy")
    rows.write.parquet(path)
    return path


def seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    inputs = Inputs(spark, folder, prepare(spark, folder, copies))
    prepared = time.perf_counter() - start
    times = {}
    for name in names:
        first = seconds(lambda: REGISTRY[name](inputs))
        runs = [seconds(lambda: REGISTRY[name](inputs)) for _ in range(1 if first > 5 else 3)]
        times[name] = round(statistics.median(runs), 3)
    rows = inputs.messages.count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": cpus,
                "prepare_sec": round(prepared, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
