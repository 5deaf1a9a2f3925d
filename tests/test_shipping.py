import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_file", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("ROWS", entry.queries()["spectrum_amplitude"](spark, "/root/testdata/sf0.01").limit(5).collect().__len__())
"""


def test_workers_get_the_package_wherever_the_driver_starts(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]
