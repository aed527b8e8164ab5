import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from geoledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("geoledger-tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rect(x0, y0, x1, y1):
    return [[[[float(x0), float(y0)], [float(x1), float(y0)], [float(x1), float(y1)], [float(x0), float(y1)], [float(x0), float(y0)]]]]


FEATURES = ("ctx string, idx bigint, id string, status string, confidence double, evidence_ids array<string>,"
            " source_ids array<string>, moderation struct<decision:string,reviewer:string,reviewed_at:string,rationale:string>,"
            " geometry array<array<array<array<double>>>>")


def feature(idx, status, geometry, confidence=0.95, evidence=("ev-1",), sources=("source-1",), ctx="2026-01-02"):
    return (ctx, idx, f"f{idx}", status, confidence, list(evidence), list(sources),
            ("approved", f"reviewer-{idx}", "2026-01-01T00:00:00Z", "seen"), geometry)


@pytest.fixture(scope="session")
def features(spark):
    return lambda rows: spark.createDataFrame(rows, FEATURES)
