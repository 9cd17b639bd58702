import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from streamscore.plans import fixtures as fx
from streamscore.schemas import UNIFIED
from streamscore.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": str(shared)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def moment(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def unified_rows(spark):
    """(event_id, user_id, event_type, campaign_id, event_ts, value) rows as a table."""

    def make(rows):
        data = [(e, u, t, c, moment(ts), v) for e, u, t, c, ts, v in rows]
        return spark.createDataFrame(data, UNIFIED)

    return make


@pytest.fixture(scope="session")
def events(spark, unified_rows):
    """Enriched events out of plain rows."""
    from streamscore.operators.silver import enrich

    def make(rows):
        return enrich(unified_rows(rows), fx.campaigns(spark))

    return make
