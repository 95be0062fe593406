"""Small literal messages the tests share."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

READING = {
    "sensorId": "S-1",
    "transformerId": "TR-1",
    "timestamp": "2027-02-03T04:00:00Z",
    "region": "R1",
    "voltage": 230.0,
    "current": 10.0,
    "temperature": 40.0,
    "load": 50,
    "failureRiskScore": 0.5,
    "status": "NORMAL",
}

ALERT_SOURCE = {
    "sensorId": "probe-907",
    "transformerId": "unit-b17",
    "timestamp": "2027-02-03T04:05:06Z",
    "region": "Hillside West",
    "voltage": 219.6,
    "current": 12.75,
    "temperature": 95.5,
    "load": 64.25,
    "failureRiskScore": 0.97,
    "status": "DEGRADED",
}

BASE = datetime(2027, 2, 3, 4)


def reading(**changes) -> str:
    return json.dumps({**READING, **changes})


def alert(alert_id="n-1", severity="CRITICAL", reason="score too high", **source) -> str:
    return json.dumps(
        {
            "alertId": alert_id,
            "severity": severity,
            "reason": reason,
            "detectedAt": 1801627506000,
            "source": {**ALERT_SOURCE, **source},
        }
    )


def at(seconds: float) -> datetime:
    return BASE + timedelta(seconds=seconds)


def topic(spark, values, partition=0, start=0):
    """Raw topic records, one second apart, in the order given."""
    from telemetry_lake.schemas import BRONZE

    rows = [
        (value, "ST", partition, start + n, at(start + n)) for n, value in enumerate(values)
    ]
    return spark.createDataFrame(rows, BRONZE)
