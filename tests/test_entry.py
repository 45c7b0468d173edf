"""The entry module without the corpus operators or what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
from ticklane.plans.registry import QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(QUERIES)
"""


@pytest.mark.parametrize("name", ["ticklane.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_driving_queries_remain_when_an_import_fails(name):
    subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, check=True)
