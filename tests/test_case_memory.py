"""What a worker holds while it searches cases."""

import os
import threading
import time

from pyspark.sql import functions as F

from scriptorium.operators import cases


def _workers():
    """MB of each Python worker's own memory."""
    sizes = []
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/cmdline") as told, open(f"/proc/{pid}/statm") as held:
                if "pyspark.daemon" in told.read():
                    sizes.append(int(held.read().split()[1]) * 4096 >> 20)
        except OSError:
            pass
    return sizes


def test_a_task_holds_few_cases_as_objects(spark):
    rows = spark.range(0, 30_000, 1, 1).select(F.col("id").alias("case_id"), *[F.lit("").alias(c) for c in ("summary", "conflict", "actor", "kind", "pattern")], *[F.array().cast("array<string>").alias(c) for c in ("tags", "roles", "views")], F.lit(0.5).alias("priority"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), (F.col("id") * 300 + i).cast("string"))), " ").alias("title"))
    index = cases.indexed(rows)
    questions = cases.asked(spark.createDataFrame([(1, "what of w4711")], "query_id long, text string"))
    most, running = [0], [True]

    def watch():
        while running[0]:
            most[0] = max([most[0], *_workers()])
            time.sleep(0.02)

    seen = threading.Thread(target=watch)
    seen.start()
    try:
        found = cases.dense_text_hits(questions, index, 4).collect()
    finally:
        running[0] = False
        seen.join()
    assert found[0]["case_id"] == 15 and most[0] < 220
