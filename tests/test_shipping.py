import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from strandmill.operators import denoise
from strandmill.session import session, ship
spark = session("elsewhere", "local[1]", **{"spark__sql__shuffle__partitions": "1", "spark__ui__enabled": "false"})
ship(spark)  # a second time changes nothing
rows = spark.createDataFrame([(1, "ACGTACGTAC", 9), (2, "ACGTACGTAG", 1)], "id long, seq string, n long")
print("rows", len(denoise.noise_probabilities(denoise.max_neighbour_counts(rows)).collect()))
"""


def test_python_tasks_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 2" in out.stdout, out.stderr[-2000:]
