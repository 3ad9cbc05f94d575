"""The Python part of the library (the HTML scan) must run in workers that
do not have the package on their path: run it from another directory in a
fresh process, with only the driver able to import the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from gridwright.sources.html import html_rows
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
df = spark.createDataFrame([(1, "<table><tr><th>a</th></tr><tr><td>x</td></tr></table>")], "page_id long, html string")
print("ROWS", html_rows(df).count())
"""


def test_html_scan_runs_without_package_on_worker_path():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as d:
        out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=d, env=env,
                             capture_output=True, text=True, timeout=300)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]
