"""Run catalogue queries and print rows / seconds (dev helper)."""
import sys
import time

sys.path.insert(0, ".")
from logsift.plans.catalog import QUERIES  # noqa: E402
from logsift.session import checkpoint_root, get_spark  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:] or None
spark = get_spark("local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
checkpoint_root(spark)
for name, fn in QUERIES.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        rows = fn(spark, sf).collect()
        print(f"{name:24s} rows={len(rows):6d} {time.time()-t:6.2f}s", rows[:1] if only else "")
    except Exception as e:
        print(f"{name:24s} ERROR {type(e).__name__}: {str(e)[:300]}")
