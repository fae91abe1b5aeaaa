"""Shards stay in slot order when sorts spill: a session of its own, as the threshold is fixed at its start."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

RUN = """
import sys
from lexmere.session import local_session
from lexmere.llm import training_order

spark = local_session("2", 4, **{"spark.shuffle.spill.numElementsForceSpillThreshold": "40", "spark.checkpoint.dir": sys.argv[1] + "/shared", "spark.driver.memory": "2g", "spark.ui.showConsoleProgress": "false"})
spark.sparkContext.setLogLevel("ERROR")
training_order.MOST_TASKS = int(sys.argv[2])
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
n = training_order.materialise(docs, sys.argv[1] + "/shards", length=64, per_shard=128)
got = training_order.records(spark, sys.argv[1] + "/shards", length=64, per_shard=128).select("slot", "byte", "shard").collect()
size = training_order.stride(64)
wrong = sum(r.byte != (r.slot % 128) * size or r.shard != r.slot // 128 for r in got)
print("RESULT", n, len(got), len({r.slot for r in got}), wrong)
"""


def test_slot_order_survives_spills(tmp_path):
    for tasks in ("1", "3"):  # many shards a task
        out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path / tasks), tasks], cwd=ROOT, capture_output=True, text=True, timeout=300, env={**__import__("os").environ, "PYTHONPATH": str(ROOT)})
        found = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
        assert found, out.stderr[-2000:]
        n, rows, slots, wrong = map(int, found[0].split()[1:])
        assert n == rows == slots > 2000 and wrong == 0
