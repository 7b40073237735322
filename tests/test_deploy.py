import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from shotstream.operators.robust import anomaly
from shotstream.session import build_session
spark = build_session("elsewhere", "local[1]", spark__ui__enabled="false")
rows = [("s", "ip", i, float(i % 5)) for i in range(20)]
df = spark.createDataFrame(rows, "shot_id string, channel_name string, ts_unix_ns bigint, value double")
print("rows", anomaly(df).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Python workers start in a folder from which the package cannot be imported."""
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 20" in done.stdout, done.stderr[-2000:]
