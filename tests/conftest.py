import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from surgeline.policy import PolicySet  # noqa: E402
from surgeline.schemas import INTERVALS, ITEM_STATE, SNAPSHOTS  # noqa: E402
from surgeline.session import local_session  # noqa: E402

T0 = dt.datetime(2029, 8, 15, 9, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", app="surgeline-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make(spark):
    return Maker(spark)


class Maker:
    """Small frames; what a case does not name is the same everywhere."""

    PLACE = {"item_name": "Ledger of Accounts", "item_kind": "Model", "workspace_id": "w3", "workspace_name": "Finance"}

    def __init__(self, spark):
        self.spark = spark

    def _frame(self, schema, rows):
        return self.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)

    def snapshots(self, *readings, capacity="north"):
        """(item, ts, reading) triples."""
        same = self.PLACE | {"capacity_key": capacity, "capacity_id": "c17"}
        return self._frame(SNAPSHOTS, [same | {"item_id": i, "ts": ts, "cu_seconds_today": float(cu)} for i, ts, cu in readings])

    def intervals(self, *rows):
        """Dicts with cu, start, minutes and optional identity."""
        made = []
        for r in rows:
            start, used = r.get("start", T0), {"item_name": r["name"]} if "name" in r else {}
            used |= {k: r[v] for k, v in (("item_kind", "kind"), ("workspace_id", "workspace")) if v in r}
            ends = start + dt.timedelta(minutes=r.get("minutes", 15))
            made.append(self.PLACE | used | {"capacity_key": r.get("capacity", "north"), "item_id": r.get("item", "a1"), "window_start": start, "window_end": ends, "cu_seconds": float(r.get("cu", 1000.0))})
        return self._frame(INTERVALS, made)

    def capacities(self, sku=None, **overrides):
        """One enforcing capacity whose guards let everything through but what a case sets."""
        settings = {"mode": "enforce", "interval_minutes": 15, "baseline": {"min_days": 1}}
        settings["guards"] = {"min_cu_seconds": 100.0, "consecutive_breaches": 1, "cooldown_minutes": 0}
        for block, value in overrides.items():
            settings[block] = {**settings.get(block, {}), **value} if isinstance(value, dict) else value
        return PolicySet([{"key": "north", "id": "c17", "sku": sku, "overrides": settings}]).frame(self.spark)

    def state(self, *rows):
        """(item, streak, last_action_ts) triples."""
        same = {"capacity_key": "north", "last_tier": "alert"}
        return self._frame(ITEM_STATE, [same | {"item_id": i, "streak": n, "last_action_ts": at} for i, n, at in rows])
