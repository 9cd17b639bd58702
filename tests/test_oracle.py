"""Every registered query against its SQL, over the whole tables."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, duck

HEAVY = {"leaderboard", "user_propensity"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir).startswith("ok")


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    without = {n for n in set(queries()) - set(oracle_sql()) if not re.match(r"op\d+_|pipeline$", n)}
    assert without == HEAVY


def test_other_queries_do_not_need_the_optional_subpackage():
    hidden = """
import sys
for name in ("corpus_pipeline", "streamscore.llm", "streamscore.llm.queries"):
    sys.modules[name] = None
from __spark_entry__ import oracle_sql, queries
names = set(queries())
assert len(names) > 60 and set(oracle_sql()) <= names
assert not any(n.startswith("op1") or n == "pipeline" for n in names)
"""
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", hidden], cwd=root, check=True, timeout=60)


def test_entry_is_the_top_users(spark):
    rows = entry(spark).collect()
    scores = [r["propensity_score"] for r in rows]
    assert rows and scores == sorted(scores, reverse=True)
