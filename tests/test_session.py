"""What a program leaves in the shared folder."""

import subprocess
import sys

PROGRAM = """
import sys
from rostrum.session import discard, durable, session
spark = session("t", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir="file://" + sys.argv[1])
kept, gone = durable(spark.range(10), "kept"), durable(spark.range(10), "gone")
discard(gone)
print(kept.count(), len([f for f in __import__("os").listdir(sys.argv[1] + "/rostrum") if f.startswith("gone")]))
if sys.argv[2] == "stop":
    spark.stop()
if sys.argv[2] == "fail":
    raise SystemExit(3)
"""


def test_tables_go_when_the_program_ends(tmp_path):
    import time
    for how in ("stop", "leave", "fail"):
        folder = tmp_path / how
        folder.mkdir()
        done = subprocess.run([sys.executable, "-c", PROGRAM, str(folder), how], capture_output=True, text=True, timeout=200)
        assert done.stdout.split() == ["10", "0"], done.stderr
        for _ in range(50):  # the JVM ends a little after the program
            left = [p for p in folder.rglob("*") if p.is_file()]
            if not left:
                break
            time.sleep(0.2)
        assert left == []
