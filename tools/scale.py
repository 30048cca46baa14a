"""Scale and skew check: respondents repeated k times, one city holding most of them.

    python tools/scale.py [copies …]

Prints seconds and rows per second for the heavier operators; the cost per row should fall or stay flat.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from canvass.functions.ranking import number_rows  # noqa: E402
from canvass.operators import numeric, tabulate  # noqa: E402
from canvass.plans import views as v  # noqa: E402
from canvass.session import build_session, materialize  # noqa: E402


def main():
    copies = [int(a) for a in sys.argv[1:]] or [1, 10]
    spark = build_session("scale", "local[8]", spark__sql__shuffle__partitions="16", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    base = materialize(v.census(spark, "/root/testdata/sf0.1").select(
        "id", "city", "rating", *v.SPEND, *v.MULTI, *v.BATTERY), "census")
    for k in copies:
        # Two of three copies are moved to one city: it then holds about three quarters of the rows.
        df = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
            (F.col("id") * k + F.col("copy")).alias("id"),
            F.when(F.col("copy") % 3 > 0, "ASIA").otherwise(F.col("city")).alias("city"), "rating",
            *[(F.col(c) + F.col("copy") / 8).alias(c) for c in v.SPEND], *v.MULTI, *v.BATTERY)
        df = materialize(df.repartition(16), "scaled")
        rows = df.count()
        questions = {"rating": ["rating"], "Q12": v.MULTI, "Q17": v.BATTERY}
        totals = df.select("id", "city", F.greatest(*[F.col(c) for c in v.SPEND]).alias("total"))
        jobs = {
            "tally": lambda: tabulate.tally(df, ["city"], questions, "All"),
            "exact median": lambda: numeric.spend_summary(totals, "city", "total", "All"),
            "built-in median": lambda: totals.na.drop().groupBy("city").agg(F.median("total")),
            "histogram": lambda: numeric.histogram(totals, ["city"], "total"),
            "density": lambda: numeric.density(totals, ["city"], "total", points=128),
            "number rows": lambda: number_rows(totals.select("id", "city"), ["city"], ["id"]),
        }
        for name, job in jobs.items():
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            print(f"{rows:>10,d} rows  {name:16s} {took:7.2f} s  {rows / took:12,.0f} rows/s", flush=True)


if __name__ == "__main__":
    main()
