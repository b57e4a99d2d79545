"""Policies: defaults, per-capacity overrides, validation, and their one-row-per-capacity frame."""

from __future__ import annotations

import copy
import re
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .schemas import CAPACITIES

# Policy defaults.
DEFAULT_POLICY: dict[str, Any] = {
    "mode": "observe",
    "interval_minutes": 15,
    "baseline": {
        "lookback_days": 7,
        "bucket": "hour_of_day",
        "min_days": 4,
        "method": "median",
        "trim_top_percent": 10.0,
    },
    "thresholds": {"alert": 1.2, "throttle": 1.5, "kill": 1.8},
    "guards": {
        "min_cu_seconds": 300.0,
        "consecutive_breaches": 2,
        "cooldown_minutes": 60,
        "max_actions_per_run": 5,
        "max_interval_stretch": 3.0,
        "min_capacity_utilization_percent": None,
    },
    "actions": {
        "alert": ["notify"],
        "throttle": ["notify", "cancel_refresh", "cancel_fabric_jobs"],
        "kill": ["notify", "cancel_refresh", "cancel_fabric_jobs", "kill_xmla_sessions"],
    },
    "protect": {"item_ids": [], "workspace_ids": [], "item_kinds": [], "name_patterns": []},
    "freeze_windows": [],
    "notify": [],
}
FREEZE_DEFAULTS = {"days": [0, 1, 2, 3, 4, 5, 6], "start_hour": 0, "end_hour": 24, "days_of_month": []}
CHANNEL_DEFAULTS = {"url": None, "min_tier": "alert", "timeout_seconds": 10}

# Accepted names.
MODES = ("observe", "enforce")
BUCKETS = ("hour_of_day", "hour_of_week")
METHODS = ("mean", "median", "p75", "p90")
ACTIONS = ("notify", "cancel_refresh", "cancel_fabric_jobs", "kill_xmla_sessions")
CHANNELS = ("teams", "slack", "webhook", "console", "none")
URL_CHANNELS = ("teams", "slack", "webhook")

# Closed bounds of the numeric settings, (lowest, highest); None is open.
BOUNDS = {
    "interval_minutes": (1, 1440),
    "baseline.lookback_days": (1, 90),
    "baseline.min_days": (1, None),
    "baseline.trim_top_percent": (0, 50),
    "guards.min_cu_seconds": (0, None),
    "guards.consecutive_breaches": (1, 10),
    "guards.cooldown_minutes": (0, None),
    "guards.max_actions_per_run": (1, None),
    "guards.min_capacity_utilization_percent": (0, 100),
}

# Capacity units per second of each SKU.
SKU_CU_PER_SECOND = {
    "F2": 2, "F4": 4, "F8": 8, "F16": 16, "F32": 32, "F64": 64, "F128": 128, "F256": 256,
    "F512": 512, "F1024": 1024, "F2048": 2048,
    "A1": 1, "A2": 2, "A3": 4, "A4": 8, "A5": 16, "A6": 32, "A7": 64, "A8": 128,
    "P1": 8, "P2": 16, "P3": 32, "P4": 64, "P5": 128,
    "EM1": 1, "EM2": 2, "EM3": 4,
}

MAY_BE_NULL = ("guards.min_capacity_utilization_percent",)

MAX_BROADCAST_BYTES = 8 << 20


class PolicyError(ValueError):
    """A policy that must not be used."""


def resolve_policy(defaults: dict[str, Any] | None, overrides: dict[str, Any] | None) -> dict[str, Any]:
    """Lay settings over the built-in defaults, then overrides over those.

    `defaults` replaces what it names; `overrides` merges blocks field by field, one level deep,
    and replaces lists and scalars.
    """
    policy = copy.deepcopy(DEFAULT_POLICY)
    for layer in (defaults or {}, overrides or {}):
        for name, value in layer.items():
            if name not in policy:
                raise PolicyError(f"unknown policy field '{name}', expected one of {sorted(policy)}")
            if isinstance(policy[name], dict):
                unknown = set(value) - set(DEFAULT_POLICY[name])
                if unknown:
                    raise PolicyError(f"unknown fields in '{name}': {sorted(unknown)}")
                policy[name] = policy[name] | value
            else:
                policy[name] = value
    policy["freeze_windows"] = [FREEZE_DEFAULTS | w for w in policy["freeze_windows"]]
    policy["notify"] = [CHANNEL_DEFAULTS | c for c in policy["notify"]]
    return policy


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and value == value


def compiles(pattern: Any) -> bool:
    """Whether the pattern can be used in a name test. Java decides where a session runs, as it is
    Java that will match; constructs Java lacks are refused there."""
    if not isinstance(pattern, str):
        return False
    session = SparkSession.getActiveSession()
    if session is None:
        try:
            re.compile(pattern)
        except re.error:
            return False
        return True
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile("(?iu)" + pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def policy_violations(policy: dict[str, Any]) -> list[str]:
    """Every rule the policy breaks, in words."""
    found = []

    def setting(path: str) -> Any:
        value = policy
        for part in path.split("."):
            value = value[part]
        return value

    for path, (low, high) in BOUNDS.items():
        value = setting(path)
        if value is None and path in MAY_BE_NULL:
            continue
        if not _is_number(value):
            found.append(f"{path} must be a number, not {value!r}")
        elif value < low or (high is not None and value > high):
            found.append(f"{path}={value} is outside {low}..{'' if high is None else high}")
    for path, allowed in {
        "mode": MODES,
        "baseline.bucket": BUCKETS,
        "baseline.method": METHODS,
    }.items():
        if setting(path) not in allowed:
            found.append(f"{path} must be one of {allowed}")
    found += [f"protect.name_patterns: {p!r} is no pattern" for p in policy["protect"]["name_patterns"] or () if not compiles(p)]
    steps = policy["thresholds"]
    if not all(_is_number(v) for v in steps.values()):
        return [*found, "thresholds must be numbers"]
    if min(steps.values()) <= 1.0:
        found.append("thresholds must each exceed 1")
    if not steps["alert"] <= steps["throttle"] <= steps["kill"]:
        found.append("thresholds must rise: alert <= throttle <= kill")
    stretch = policy["guards"]["max_interval_stretch"]
    if not _is_number(stretch) or stretch <= 1.0:
        found.append("guards.max_interval_stretch must exceed 1")
    for tier, names in policy["actions"].items():
        found += [f"actions.{tier}: unknown action '{n}'" for n in names or () if n not in ACTIONS]
    for window in policy["freeze_windows"]:
        if "name" not in window:
            found.append("freeze window without a name")
        if not isinstance(window["days"], (list, tuple)) or not all(_is_number(d) and 0 <= d <= 6 for d in window["days"]):
            found.append("freeze window days must be 0..6, Monday first")
        hours = window["start_hour"], window["end_hour"]
        if not all(map(_is_number, hours)) or not 0 <= hours[0] <= 23 or not 1 <= hours[1] <= 24:
            found.append("freeze window hours must be 0..23 and 1..24")
    for channel in policy["notify"]:
        if channel.get("kind") not in CHANNELS:
            found.append(f"unknown notification channel '{channel.get('kind')}'")
        elif channel["kind"] in URL_CHANNELS and not channel["url"]:
            found.append(f"channel '{channel['kind']}' needs a url")
        if channel["min_tier"] not in ("alert", "throttle", "kill"):
            found.append(f"channel min_tier '{channel['min_tier']}' is not a tier")
    return found


def cu_per_second(sku: str | None) -> float | None:
    rate = SKU_CU_PER_SECOND.get((sku or "").upper())
    return None if rate is None else float(rate)


class PolicySet:
    """The monitored capacities with their effective policies.

    `capacities` are dicts with `key`, `id` and optionally `enabled`, `sku`, `overrides`. The set
    is configuration: it is as large as what someone wrote down, and never grows with the data.
    """

    def __init__(self, capacities: list[dict[str, Any]], defaults: dict[str, Any] | None = None):
        if not capacities:
            raise PolicyError("no capacities")
        keys = [c["key"] for c in capacities]
        twice = sorted({k for k in keys if keys.count(k) > 1})
        if twice:
            raise PolicyError(f"duplicate capacity keys: {twice}")
        self.rows = []
        for capacity in capacities:
            policy = resolve_policy(defaults, capacity.get("overrides"))
            broken = policy_violations(policy)
            if broken:
                raise PolicyError(f"{capacity['key']}: " + "; ".join(broken))
            self.rows.append(
                {
                    "capacity_key": capacity["key"],
                    "capacity_id": capacity["id"],
                    "enabled": capacity.get("enabled", True),
                    "sku": capacity.get("sku"),
                    "cu_per_second": cu_per_second(capacity.get("sku")),
                    "policy": policy,
                }
            )

    @property
    def max_lookback(self) -> int:
        return max(r["policy"]["baseline"]["lookback_days"] for r in self.rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per capacity. An Arrow table becomes a local relation of known size; it is
        hinted for broadcast only up to a fixed number of bytes."""
        table = pa.Table.from_pylist(self.rows, schema=to_arrow_schema(CAPACITIES))
        return checked_broadcast(spark.createDataFrame(table, schema=CAPACITIES), table.nbytes)


def checked_broadcast(df: DataFrame, nbytes: int) -> DataFrame:
    """Hint a broadcast only for a measured small size, else leave the join to the optimizer."""
    return F.broadcast(df) if nbytes <= MAX_BROADCAST_BYTES else df


def enabled_capacities(capacities: DataFrame, keys: list[str] | None = None) -> DataFrame:
    enabled = capacities.filter("enabled")
    return enabled.filter(F.col("capacity_key").isin(keys)) if keys is not None else enabled


def sku_dimension(spark: SparkSession) -> DataFrame:
    table = pa.table(
        {
            "sku": list(SKU_CU_PER_SECOND),
            "cu_per_second": [float(v) for v in SKU_CU_PER_SECOND.values()],
        }
    )
    return checked_broadcast(spark.createDataFrame(table), table.nbytes)


def sku_capacity(capacities: DataFrame) -> DataFrame:
    """Set `cu_per_second` of any frame with a `sku`; NULL for a missing or unknown one."""
    skus = sku_dimension(capacities.sparkSession).withColumnRenamed("sku", "_sku")
    return capacities.drop("cu_per_second").join(skus, F.upper("sku") == F.col("_sku"), "left").drop("_sku")


def policy_join(df: DataFrame, capacities: DataFrame) -> DataFrame:
    """Attach the effective policy of each row's capacity; rows of unknown capacities go."""
    wanted = [c for c in capacities.columns if c not in ("capacity_id", "enabled")]
    return df.join(capacities.filter("enabled").select(*wanted), "capacity_key")


def validate_policies(capacities: DataFrame) -> DataFrame:
    """Table form of the checks: one row per capacity and broken rule."""
    p = F.col("policy")

    def setting(path: str) -> Column:
        column = p
        for part in path.split("."):
            column = column[part]
        return column

    rules = {}
    for path, (low, high) in BOUNDS.items():
        outside = setting(path) < low
        outside = outside if high is None else outside | (setting(path) > high)
        rules[path] = outside if path in MAY_BE_NULL else F.coalesce(outside, F.lit(True))
    for path, allowed in {"mode": MODES, "baseline.bucket": BUCKETS, "baseline.method": METHODS}.items():
        rules[path] = ~F.coalesce(setting(path).isin(*allowed), F.lit(False))
    steps = p["thresholds"]
    rules["thresholds"] = steps["alert"].isNull() | steps["throttle"].isNull() | steps["kill"].isNull() | (
        (F.least(steps["alert"], steps["throttle"], steps["kill"]) <= 1.0)
        | (steps["alert"] > steps["throttle"])
        | (steps["throttle"] > steps["kill"])
    )
    rules["guards.max_interval_stretch"] = F.coalesce(setting("guards.max_interval_stretch") <= 1.0, F.lit(True))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return capacities.select("capacity_key", F.explode(broken).alias("rule"))
