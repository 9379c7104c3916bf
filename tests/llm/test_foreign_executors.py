"""The operators in a process whose workers cannot import this package, and the entry without a library."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MAPS = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from postlens.session import local_session
spark = local_session("2", shuffle_partitions=2)
from pyspark.sql import functions as F
seen = spark.range(1).select(F.udf(lambda _: __import__("importlib.util").util.find_spec("postlens") is None, "boolean")("id")).first()[0]
assert seen, "the workers can import the package"
for name in {names!r}:
    assert entry.queries()[name](spark, {sf!r}).count() == 200, name
print("all there")
"""
LACKING = """
import sys
sys.path.insert(0, {root!r})
sys.modules["ahocorasick"] = None
import __spark_entry__ as entry
assert "dedup_exact" in entry.queries() and not any(n.startswith("op") for n in entry.queries()) and "pipeline" not in entry.queries()
print("all there")
"""


def run(script, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "all there" in done.stdout, done.stderr[-3000:]


def test_workers_without_the_package(tmp_path, sf):
    names = ["op1_sentencepiece", "op3_language_id", "op6_toxicity", "op9_token_counts", "op13_cross_tokenizer_alignment"]
    run(MAPS.format(root=ROOT, names=names, sf=sf), tmp_path)


def test_entry_without_a_library(tmp_path):
    run(LACKING.format(root=ROOT), tmp_path)
