"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query writes its whole result to Spark's noop sink; the best of two runs counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeline.functions import jsonx
from lodeline.operators import levels, profile, query, rows, search
from lodeline.plans import catalog
from lodeline.sources import generate

HEADLINE = ["flagship_filter_levels", "fl_and", "fl_json_lines", "fl_json_native", "se_lines", "se_totals", "lv_lines", "lv_field", "an_numeric", "an_numeric_big", "an_enum", "mg_order", "mg_masked", "mg_trace", "sc_lines", "sf_flatten", "sk_csv_json", "sk_pretty", "rs_display"]
ROWS = 2_000_000


def generated(spark: SparkSession, folder: str):
    """Queries over a larger log, ingested once."""
    path = f"{folder}/plain"
    generate.plain_lines(spark, ROWS).write.mode("overwrite").parquet(path)
    lines = spark.read.parquet(path)
    generate.json_lines(spark, ROWS).write.mode("overwrite").parquet(f"{folder}/json")
    records = spark.read.parquet(f"{folder}/json")
    columns = ["ts", "level", "logger", "msg", "req_id", "user", "duration_ms", "bytes", "status"]
    duration = records.select("line_no", F.lit("Num").alias("kind"), jsonx.native_field(F.col("value"), ["duration_ms"]).alias("raw"))
    return {
        "gen_filter_field": lambda: query.run_filter(records, "level=error", columns, exact=False).select("line_no"),
        "gen_filter_bare": lambda: query.run_filter(lines, "user_4242").select("line_no"),
        "gen_numeric": lambda: profile.numeric_stats(duration),
        "gen_sparse_lines": lambda: rows.subset(lines, spark.range(0, ROWS, 177).select(F.col("id").alias("line_no"))),
        "gen_search_error": lambda: search.totals(lines, search.check_pattern(spark, "ERROR")),
        "gen_search_digits": lambda: search.totals(lines, search.check_pattern(spark, r"user_42\d{2}")),
        "gen_levels": lambda: levels.count_levels(lines, levels.line_level(F.col("value"))),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    import tempfile

    times = {}
    with tempfile.TemporaryDirectory() as folder:
        work = {n: (lambda n=n: catalog.QUERIES[n](spark, sf)) for n in HEADLINE} | generated(spark, folder)
        for name, make in work.items():
            best = float("inf")
            for _ in range(2):
                began = time.perf_counter()
                make().write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - began)
            times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "generated_rows": ROWS}))
    spark.stop()


if __name__ == "__main__":
    main()
