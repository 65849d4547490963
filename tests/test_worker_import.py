"""The driver contract works from any working directory: Python workers get the
package shipped with the session (they cannot rely on the caller's cwd)."""
import subprocess
import sys
import tempfile
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = m.queries()["rate_limit_summary"](spark, "/root/testdata/sf0.001").collect()
print("RESULT", sorted((r.tenant_id, r.allowed, r.refused) for r in rows))
"""


def test_queries_run_from_a_foreign_directory():
    with tempfile.TemporaryDirectory() as d:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=d, capture_output=True, text=True, timeout=600)
    line = [x for x in out.stdout.splitlines() if x.startswith("RESULT")]
    assert line, out.stderr[-2000:]
    assert line[0] == "RESULT [('0', 193, 0), ('1', 179, 0), ('2', 216, 0), ('3', 186, 0), ('4', 218, 8)]"
