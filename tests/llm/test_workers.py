"""Python workers need no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone
from pyspark.sql import SparkSession
from tidemark.llm import catalog

spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
has = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib").util.find_spec("tidemark") is not None).collect()
assert has == [False], "the workers see the package"
for name in {names!r}:
    print(name, catalog.queries()[name](spark, {sf!r}).count(), flush=True)
"""
NAMES = ["op1_decontamination", "op2_toxicity", "op4_token_ids", "op5_language_id", "op7_sentencepiece", "op11_rank_bpe", "op12_centroids", "op13_alignment"]


def test_workers_without_the_package(tmp_path, sf_small):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT.format(root=str(ROOT), folder=str(tmp_path / "shared"), names=NAMES, sf=sf_small))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    found = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(found) == set(NAMES) and all(int(n) > 0 for n in found.values())
