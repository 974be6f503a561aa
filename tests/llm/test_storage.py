"""Intermediate tables go with the session."""

import os
import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{folder}").config(
    "spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from codetally.llm import simhash
rows = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
kept = simhash.drop_near_duplicates(rows)
assert kept.count() == 2
import os
assert len([f for f in os.listdir("{folder}") if f.startswith("llm-")]) == 1
spark.stop()
"""


def test_nothing_is_left_after_the_session(tmp_path):
    folder, code = tmp_path / "shared", tmp_path / "run.py"
    folder.mkdir()
    code.write_text(SCRIPT.format(folder=folder))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, str(code)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert [f for f in os.listdir(folder) if f.startswith("llm-")] == []


def test_release_gives_freed_memory_back():
    code = """
import pyarrow as pa
from codetally.llm.storage import release

def used():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) // 1024

kept = []
for _ in range(200):
    blocks = [bytearray(4000) for _ in range(100)]
    kept.append(blocks.pop())
    kept.append(pa.array(["x" * 1000] * 100).slice(0, 1).to_pylist())
held = [bytearray(4000) for _ in range(20000)]
kept += held[::400]
del held, blocks
before = used()
release()
print(before - used())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run(
        [sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True
    )
    assert int(found.stdout) > 40
