"""The entry points without the training-data operators, and stored tables."""

import os
import subprocess
import sys
from pathlib import Path

from memspan.plans.tables import forget_stored, stored

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_operators():
    """Neither a missing subpackage nor a missing module it needs takes the other queries away."""
    for blocked in ("memspan.llm", "corpus_pipeline", "numpy", "public_tokenizers"):
        code = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r} or name.startswith({blocked!r} + "."):
            raise ModuleNotFoundError(name)
if {blocked!r} != "numpy":
    import pyspark.sql
sys.meta_path.insert(0, Block())
try:
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "mem_text" in names and "kmer_count" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names), names
    assert "pipeline" not in names and set(entry.oracle_sql()) <= names
except ModuleNotFoundError as problem:
    assert {blocked!r} == "numpy" and "numpy" in str(problem)  # Spark's own need
"""
        done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


def test_stored_tables_are_forgotten(spark):
    kept = stored(spark.range(5).toDF("k"), "probe")
    path = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 5 and os.path.isdir(path)
    assert forget_stored(spark) >= 1
    assert not os.path.exists(path) and forget_stored(spark) == 0
