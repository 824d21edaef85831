import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from edgelens import schemas as S  # noqa: E402
from edgelens.session import build_session  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8,4]",  # tasks are retried, as on a cluster
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return TESTDATA


def rows_of(df, *columns):
    """Rows as sorted tuples, NULL last."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is None, str(v)) for v in t])


@pytest.fixture
def hourly(spark):
    """Hourly rows from short tuples: bucket, country, requests, and options."""

    def make(*rows, collected_at="2024-01-01T00:00:00Z"):
        full = []
        for i, row in enumerate(rows):
            bucket, country, requests, *rest = row
            extra = rest[0] if rest else {}
            full.append(
                (
                    extra.get("collected_at", collected_at),
                    bucket,
                    country,
                    extra.get("http_method", ""),
                    extra.get("status_code", 0),
                    extra.get("content_type", ""),
                    requests,
                    extra.get("bytes_total", 0),
                    extra.get("threats", 0),
                    extra.get("unique_visitors", 0),
                    extra.get("ingest_seq", i),
                    extra.get("arrival"),
                )
            )
        return spark.createDataFrame(full, S.HOURLY_TRAFFIC)

    return make


@pytest.fixture
def events(spark):
    """Firewall rows from (datetime, action, ray_name)."""

    def make(*rows, collected_at="2024-01-01T00:00:00Z"):
        full = [
            (collected_at, at, action, "", "US", "", "GET", "/", "ua", "", "waf", ray, i, None)
            for i, (at, action, ray) in enumerate(rows)
        ]
        return spark.createDataFrame(full, S.FIREWALL_EVENTS)

    return make


@pytest.fixture
def details(spark):
    def make(*rows, collected_at="2024-01-01T00:00:00Z"):
        full = [
            (collected_at, bucket, country, "GET", status, path, count, i, None)
            for i, (bucket, country, status, path, count) in enumerate(rows)
        ]
        return spark.createDataFrame(full, S.REQUEST_DETAILS)

    return make
