import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from faultline.config import RunConfig  # noqa: E402
from faultline.session import build_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


def observation(effect: str, config: str, measures: str) -> str:
    return "\n".join(["1 EFFECT", "=====", effect, "2 TROUBLE DESCRIPTION", "=====", "2.2 Configuration Data", "---", config,
                      "2.3 Logs", "3 MEASURES", "=====", measures, "4 CSR", "=====", "None"])


TEXT_A = observation("Cell disabled alarm and traffic stopped.", "BB6630 21.Q3", "Restart node.")
TEXT_B = observation("Core dump crash after upgrade.", "AIR6449 22.Q1", "Collect pmd.")

TINY_SCHEMA = ("ingest_pos long, report_id string, team string, heading string, observation string, answer string, priority string, superior_unit string, "
               "fault_type string, registered string, routing_time double, routing_waiting_time double, total_routing_time double, routed boolean, "
               "is_duplicate_report boolean, duplicate_reports string, product_rstate string, product_no string, node_product_no string")


def tiny_rows() -> list:
    out = []
    for i in range(16):
        a = i < 8
        out.append((i, f"H{i:04d}", "TeamA" if a else "TeamB", f"Heading {'TeamA' if a else 'TeamB'} {i}", TEXT_A if a else TEXT_B,
                    "CAUSE OF FAULT\n----------\nsoftware issue\n----------", "B", "LTE-MS-RBS" if a else "ERS-RADIO", "Alarm" if a else "Crash",
                    "2023-01-01 01:00:00", 1.0, 1.0, 2.0, True, False, "", "KDU137848 R24A", "KDU137848", "KDU137848"))
    return out


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.createDataFrame(tiny_rows(), TINY_SCHEMA)


@pytest.fixture(scope="session")
def tiny_config():
    return RunConfig(mode="fast", min_samples=1)


@pytest.fixture(scope="session")
def trained(tiny, tiny_config):
    from faultline.plans.training import train
    return train(tiny, tiny_config)
