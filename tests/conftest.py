import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gaugeflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "gaugeflow-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lab_messages(spark):
    """The five lab messages and the odd payloads of the fixture list."""

    def lab(topic, equipment, kind, value, unit, status):
        return (
            topic,
            json.dumps(
                {
                    "equipment_id": equipment,
                    "timestamp": "2024-01-01T10:00:00Z",
                    "type": kind,
                    "value": value,
                    "unit": unit,
                    "status": status,
                    "workflow_step": status,
                }
            ),
        )

    rows = [
        lab("lab/furnace/temperature", "furnace_01", "temperature", 850.5, "celsius", "heating"),
        lab("lab/melter/temperature", "melter_01", "temperature", 1200.0, "celsius", "melting"),
        lab("lab/anvil/force", "anvil_01", "force", 2500.0, "newtons", "positioning"),
        lab("lab/conveyor/speed", "conveyor_01", "speed", 1.5, "m/s", "transporting"),
        lab("lab/conveyor/position", "conveyor_01", "position", 45.0, "degrees", "transporting"),
        (
            "cell/1/glucose_mM",
            '{"timestamp":"2024-01-01T10:00:00Z","value":9.98,"unit":"mM","sensor_type":"metabolic","cell_id":1,'
            '"field":"glucose_mM","min_val":0,"max_val":25}',
        ),
        (
            "smr/reactor_core/heater_current",
            '{"timestamp":"2024-01-01T10:00:00Z","value":"25.40","unit":"A","status":"normal","subsystem":"reactor_core",'
            '"sensor_name":"heater_current","description":"Heater current","min_val":0,"max_val":50,"raw_value":25.4,"target_value":26.0}',
        ),
        (
            "sensors/building1/temperature",
            '{"device_id":"temp_sensor_7","reading":"55.2","timestamp":"2024-01-01T10:00:00.123456Z","location":"building_3",'
            '"battery_level":"88","signal_strength":"-60"}',
        ),
        ("simple/data", "55.2"),
        ("simple/data", "{}"),
        (
            "factory/line1/machine5/status",
            '{"machine_name":"machine_5","operational_status":"running","production_rate":"75.2","error_count":"2",'
            '"maintenance_due":"True","last_service":"2024-01-01","operator_id":"op_101"}',
        ),
        ("pump7", '{"device_id":"7","value":3}'),
        ("a/b/on", '{"on":true}'),
    ]
    data = [(i + 1, t, p) for i, (t, p) in enumerate(rows)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, "msg_id long, topic string, payload string").withColumn(
        "ingest_ts", F.expr("timestamp_ntz'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,0,msg_id)")
    )
