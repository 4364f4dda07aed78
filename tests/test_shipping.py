"""Workers without the package on their path get it, and keep modules between tasks."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
import pandas as pd
from pyspark.sql import functions as F
from duochron.operators.stats import fisher_greater
from duochron.session import local_session, shipped
spark = local_session(2, 2)
spark.sparkContext.setLogLevel("OFF")

def look(frames):
    import os
    import duochron.operators.stats as module
    for f in frames:
        module.seen = getattr(module, "seen", 0) + 1
        yield pd.DataFrame([[os.getpid(), module.seen, module.__file__]], columns=["pid", "seen", "file"])

rows = shipped(spark.range(0, 8, 1, 8)).mapInPandas(look, "pid long, seen long, file string").collect()
assert all(".zip" in r.file for r in rows), rows
assert max(r.seen for r in rows) > 1 and len({{r.pid for r in rows}}) < 8, rows
one = shipped(spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")).select(fisher_greater("a", "b", "c", "d").alias("p"))
assert abs(one.first().p - 17 / 70) < 1e-12
print("fine")
"""


def test_workers_get_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert out.stdout.strip().endswith("fine"), out.stderr[-3000:]
