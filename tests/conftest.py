import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from claimloom.session import build_session

    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    def f(rows, schema):
        return spark.createDataFrame(rows, schema)

    return f


CONVENTIONS = "source_id string, tz_name string, date_order string, decimal_mark string, bare_size_unit string"
VICTIM = (
    "id string, group_id string, group_name string, source_id string, source_ids array<string>, source_host string, organization string, post_title string, post_type string, record_id string, reported_date string, country string, "
    "country_basis string, sector string, first_seen_at string, last_seen_at string, listing_state string, watchguard_profile_url string, claim_details map<string,string>, "
    "historical_import struct<source:string,earliest_discovered:string,latest_discovered:string,archive_observations:int,archive_post_title:string,imported_at:string,matched_source_ids:array<string>>"
)
VICTIM_COLUMNS = [c.strip().split(" ")[0] for c in "id,group_id,group_name,source_id,source_ids,source_host,organization,post_title,post_type,record_id,reported_date,country,country_basis,sector,first_seen_at,last_seen_at,listing_state,watchguard_profile_url,claim_details,historical_import".split(",")]


@pytest.fixture(scope="session")
def victims(spark):
    def f(*rows):
        return spark.createDataFrame([tuple(r.get(c) for c in VICTIM_COLUMNS) for r in rows], VICTIM)

    return f


@pytest.fixture(scope="session")
def conventions(spark):
    def f(*rows):
        return spark.createDataFrame(list(rows), CONVENTIONS)

    return f
