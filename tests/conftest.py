from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from flowtide.schema import FLOW_SCHEMA
from flowtide.session import local_session
from flowtide.sources.derived import load_flows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def flows(spark):
    return load_flows(spark, SF_DIR).cache()


T0 = datetime(2024, 3, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def make_flows(spark, rows: list[dict]):
    """A flows table from partial records; what a record leaves out is NULL."""
    full = []
    for i, r in enumerate(rows):
        r = {"flow_id": i, "first_ts": T0, "last_ts": T0, "is_v6": False, "packets": 1, "bytes": 100, "prot": 6,
             "tcp_flags": 0, **r}
        full.append(tuple(r.get(f.name) for f in FLOW_SCHEMA.fields))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in FLOW_SCHEMA.fields])
    return spark.createDataFrame(full, schema)
