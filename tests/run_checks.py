"""Print the outcome of every registered query: python tests/run_checks.py [name part]"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from compare import connect, difference
from pyspark.sql import SparkSession

from clauselight.catalog import load


def main():
    part = sys.argv[1] if len(sys.argv) > 1 else ""
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, q in load().items():
        if part and not any(p in name for p in part.split(",")):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.check is None:
                outcome = f"no check, {df.count()} rows"
            else:
                outcome = difference(df, con, q.check) or "ok"
        except Exception as e:  # noqa: BLE001
            outcome = f"FAILED {type(e).__name__}: {str(e)[:700]}"
        print(f"{name:45s} {time.time() - start:6.2f}s {outcome}", flush=True)


if __name__ == "__main__":
    main()
