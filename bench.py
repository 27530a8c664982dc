"""Times the registered reference queries; prints one JSON line."""
import json
import os
import time

from pyspark.sql import SparkSession

from weft.plans.registry import QUERIES

d, n = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{n}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", n).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
out = {}
for k, (f, _) in QUERIES.items():
    b = time.time()
    f(spark, d).write.format("noop").mode("overwrite").save()
    out[k] = round(time.time() - b, 3)
print(json.dumps({"metric": "total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": d}))
