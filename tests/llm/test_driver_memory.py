"""What finished steps leave behind in the driver."""

import re
from pathlib import Path

from loomfill.llm import common, quality

LABELLED = "/root/testdata/sf0.1"


def held(pid="self"):
    """MB of a process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_training_leaves_the_driver_only_the_model(spark):
    common.release_memory()
    before = held()
    model = quality.train(common.table(spark, LABELLED, "documents"), common.table(spark, LABELLED, "labels"))
    assert held() - before < 50
    assert len(model.odds) == quality.Settings().buckets


def test_written_steps_leave_the_jvm_no_freed_native_memory(spark):
    assert common.trim_driver(spark)
    common.written(spark.range(10), "few")
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    before = held(pid)
    assert common.trim_driver(spark)
    assert before - held(pid) < 40
