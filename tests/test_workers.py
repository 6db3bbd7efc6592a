"""Scoring works on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from ticketweave.session import local_session
spark = local_session(2, "2g")
for name in ("similar_topk", "nb_classify"):
    assert entry.queries()[name](spark, {small!r}).count() > 0
print("done")
"""


def test_from_another_folder(small, tmp_path):
    script = SCRIPT.format(root=str(ROOT), small=small)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("done"), run.stderr[-3000:]
