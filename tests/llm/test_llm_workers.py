"""The operators' Python runs on workers that cannot import the package."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from ticketweave.session import local_session
spark = local_session(4, "4g")
for name in {names!r}:
    assert entry.queries()[name](spark, {small!r}).count() > 0, name
print("done")
"""

WITH_PYTHON = ["op1_substring_dedup", "op3_license_scan", "op4_minhash_neardup", "op6_quality", "op8_learned_partitions",
               "op10_warc", "op11_prefix_trie", "op12_line_dedup", "op13_importance_resampling"]


@pytest.mark.parametrize("names", [WITH_PYTHON[:5], WITH_PYTHON[5:]])
def test_from_another_folder(small, tmp_path, names):
    script = SCRIPT.format(root=str(ROOT), small=small, names=names)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=500)
    assert run.stdout.strip().endswith("done"), run.stderr[-3000:]


def test_other_queries_load_without_optional_modules(tmp_path):
    """A module that only some operators need may be missing: everything still registers."""
    script = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
sys.modules["zstandard"] = sys.modules["tokenizers"] = None
import __spark_entry__ as entry
assert "op10_warc" in entry.queries() and "similar_topk" in entry.queries()
print("done")
"""
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert run.stdout.strip().endswith("done"), run.stderr[-3000:]
