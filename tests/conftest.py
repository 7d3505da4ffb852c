import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from factloom.session import local_session  # noqa: E402

FACT = (
    "ord long, id string, kind string, status string, confidence double, content string, source string, source_file string, source_date string, session string, machine string, "
    "created_at timestamp, last_seen_at timestamp, valid_at string, invalid_at string, superseded_by string, superseded_at string, supersession_reason string, deprecated boolean, trust string, "
    "pr_numbers array<int>, evidence array<struct<event_id:string,path:string,line:int>>, extra string"
)


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "factloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def make_facts(spark):
    """Facts from dicts; missing fields are null, ord counts up."""
    names = [c.split()[0] for c in FACT.replace("struct<event_id:string,path:string,line:int>", "s").split(", ")]

    def make(*rows):
        return spark.createDataFrame([tuple({"ord": i, "status": "current", "confidence": 0.9, **r}.get(n) for n in names) for i, r in enumerate(rows)], FACT)

    return make


@pytest.fixture
def now():
    from pyspark.sql import functions as F

    return F.to_timestamp(F.lit("2026-06-13 00:00:00"))
