import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from tillstream.session import build_session  # noqa: E402

EVENT_DDL = """
    event_id string, ingest_ord bigint, event_type string, timestamp string, session_id string, customer_id bigint,
    source string, device string, referrer string, utm_source string, utm_medium string, utm_campaign string,
    product_id bigint, product_name string, product_price_vnd string, product_price_usd string, quantity string,
    line_total_vnd string, line_total_usd string
"""


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Raw events from dicts; ids, order and keys have defaults."""
    names = [part.split()[0] for part in EVENT_DDL.split(",")]

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "event_id": f"e{i}",
                "ingest_ord": i,
                "event_type": "view_item",
                "timestamp": f"2025-01-01T10:00:{i % 60:02d}",
                "session_id": "s",
                "customer_id": 1,
                "source": "website",
                "device": "desktop",
                "product_id": 1,
                "product_name": "P",
                "product_price_vnd": "10",
                "quantity": "1",
            }
            full.append(tuple({**base, **row}.get(n) for n in names))
        return spark.createDataFrame(full, EVENT_DDL)

    return make
