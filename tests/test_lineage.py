"""The shared folder where the setting is absent: in a session of its own, since a session's setting can't change."""

import subprocess
import sys

CODE = """
import sys
from siltstone.functions.lineage import cut, remove, shared_dir
from siltstone.session import local_session

spark = local_session(1, 1, "1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut(spark.range(5)).count() == 5
at = shared_dir(spark)
assert at == shared_dir(spark) and spark.sparkContext.getCheckpointDir() is not None
spark.range(3).write.parquet(at + "/x")
assert spark.read.parquet(at + "/x").count() == 3
remove(spark, at + "/x")
try:
    spark.read.parquet(at + "/x")
    sys.exit("still there")
except Exception as error:
    assert "PATH_NOT_FOUND" in str(error)


class Context:
    master = "spark://a:7077"
    _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()


class Cluster:
    conf, sparkContext = type("C", (), {"get": lambda self, k, d: d})(), Context()


try:
    shared_dir(Cluster())
    sys.exit("no error")
except RuntimeError as error:
    assert "spark.checkpoint.dir" in str(error)
print("fine")
"""


CLEAN = """
import gc, os, sys, time
from siltstone.plans import catalog
from siltstone.session import local_session

spark = local_session(2, 2, "1g")
at = sys.argv[1]
spark.sparkContext.setCheckpointDir(at)
left = lambda: [f for _, _, files in os.walk(at) for f in files if not f.startswith(("_", "."))]
for name in ("page_issue_counts", "stored_page_upserts"):
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and left()
    del rows
for _ in range(60):
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if not left():
        print("fine")
        break
    time.sleep(0.5)
else:
    print(left()[:5])
"""


def run(code, tmp_path, *args):
    import os

    (tmp_path / "spark-defaults.conf").write_text("")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, *args], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=180, cwd=root)
    assert done.returncode == 0 and "fine" in done.stdout, done.stdout[-500:] + done.stderr[-2000:]


def test_without_setting(tmp_path):
    run(CODE, tmp_path)


def test_nothing_stays_in_the_shared_folder(tmp_path):
    """What queries keep while they run is gone when nobody holds their rows any more."""
    (tmp_path / "shared").mkdir()
    run(CLEAN, tmp_path, str(tmp_path / "shared"))
