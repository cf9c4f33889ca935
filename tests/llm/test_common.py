from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from flowloom.llm import common
from flowloom.llm.common import Scratch, driver_gives_back, gives_back, with_keys


def resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_workers_give_back_what_is_free():
    kept = []

    def work(batches):
        for x in batches:
            arrays = [np.ones(8000) for _ in range(2000)]
            kept.append(arrays[-1])  # lies above the others, so they don't go by themselves
            yield x

    before = resident()
    assert len(list(gives_back(work)(iter([pd.DataFrame({"a": [1]})])))) == 1
    assert resident() < before + 40


def test_join_with_keys(spark, monkeypatch):
    scratch = Scratch(spark)
    rows = spark.range(1000).select((F.col("id") % 100).alias("key"), "id")
    keys = scratch.save(spark.range(7, 300, 10).select(F.col("id").alias("key"), (-F.col("id")).alias("low")))
    wanted = [(k, i, -k) for i in range(1000) if (k := i % 100) % 10 == 7]
    for most in (common.HASHED_ROWS, 0):
        monkeypatch.setattr(common, "HASHED_ROWS", most)
        assert sorted(map(tuple, with_keys(rows, keys, "key").select("key", "id", "low").collect())) == sorted(wanted)


def test_driver_gives_back_what_is_free(spark, monkeypatch):
    assert driver_gives_back(spark.sparkContext).startswith("Trim native heap")
    calls, scratch = [], Scratch(spark)
    monkeypatch.setattr(common, "driver_gives_back", calls.append)
    scratch.drop(scratch.save(spark.range(3)))
    assert calls == [spark.sparkContext]
