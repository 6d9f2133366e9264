import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, os, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", {repo!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
# the driver finds the package by path; workers start elsewhere and have only what is sent
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {folder!r}).config("spark.driver.memory", "2g").getOrCreate())
print("ROWS", entry.queries()["dynamic_features"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_functions_run_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in done.stdout and int(done.stdout.split("ROWS ")[1].split()[0]) > 0, done.stderr[-2000:]
