"""Python workers have no copy of the package: what they run travels with the plan."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys; sys.path.insert(0, {repo!r})
from shelfwise import session
from shelfwise.llm.queries import QUERIES
spark = session(master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false")
spark.sparkContext.setLogLevel("ERROR")
for name in sorted(QUERIES):
    print(name, QUERIES[name](spark, {data!r}).count() > 0)
"""


def test_all_queries_run_where_the_package_is_not_installed(tmp_path, sf_dir):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=repo, data=sf_dir)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
    rows = [line for line in done.stdout.splitlines() if line.endswith(("True", "False"))]
    assert len(rows) == 14 and all(line.endswith("True") for line in rows), (rows, done.stderr[-2000:])
