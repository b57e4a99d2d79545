import pytest

from surgeline.policy import PolicyError, PolicySet, resolve_policy, sku_capacity, validate_policies


def test_blocks_merge_by_field_and_lists_replace():
    policy = resolve_policy(
        {"thresholds": {"kill": 3.0}, "protect": {"item_ids": ["x"]}},
        {"thresholds": {"alert": 1.05}, "freeze_windows": [{"name": "f"}]},
    )
    assert policy["thresholds"] == {"alert": 1.05, "throttle": 1.5, "kill": 3.0}
    assert policy["protect"]["item_ids"] == ["x"]
    assert policy["freeze_windows"][0]["days"] == list(range(7))


def test_defaults_are_not_shared():
    resolve_policy(None, None)["actions"]["alert"].append("changed")
    assert resolve_policy(None, None)["actions"]["alert"] == ["notify"]


@pytest.mark.parametrize(
    "overrides",
    [
        {"treshold": 1},
        {"thresholds": {"alart": 2}},
        {"thresholds": {"alert": 1.9}},
        {"thresholds": {"alert": 1.0}},
        {"baseline": {"lookback_days": 91}},
        {"baseline": {"lookback_days": 0}},
        {"baseline": {"trim_top_percent": 51}},
        {"baseline": {"method": "max"}},
        {"baseline": {"bucket": "minute"}},
        {"mode": "off"},
        {"interval_minutes": 0},
        {"guards": {"consecutive_breaches": 11}},
        {"guards": {"max_interval_stretch": 1.0}},
        {"guards": {"max_actions_per_run": 0}},
        {"freeze_windows": [{"name": "x", "days": [7]}]},
        {"freeze_windows": [{"name": "x", "end_hour": 25}]},
        {"notify": [{"kind": "teams"}]},
        {"notify": [{"kind": "pigeon"}]},
        {"actions": {"kill": ["explode"]}},
    ],
)
def test_bad_policies_are_refused(overrides):
    with pytest.raises(PolicyError):
        PolicySet([{"key": "a", "id": "1", "overrides": overrides}])


def test_keys_must_be_unique_and_present():
    with pytest.raises(PolicyError):
        PolicySet([])
    with pytest.raises(PolicyError):
        PolicySet([{"key": "a", "id": "1"}, {"key": "a", "id": "2"}])


def test_frame_and_sku(spark):
    policies = PolicySet([{"key": "a", "id": "1", "sku": "f64"}, {"key": "b", "id": "2", "sku": "Z9"}, {"key": "c", "id": "3"}])
    frame = policies.frame(spark)
    rows = {r.capacity_key: r for r in frame.collect()}
    joined = {r.capacity_key: r.cu_per_second for r in sku_capacity(frame).collect()}
    assert joined == {k: r.cu_per_second for k, r in rows.items()}
    assert {k: r.cu_per_second for k, r in rows.items()} == {"a": 64.0, "b": None, "c": None}
    assert rows["a"].policy.baseline.method == "median"
    assert policies.max_lookback == 7
    assert validate_policies(policies.frame(spark)).count() == 0


@pytest.mark.parametrize(
    "block, field, value",
    [("guards", f, None) for f in ("max_actions_per_run", "cooldown_minutes", "min_cu_seconds", "consecutive_breaches", "max_interval_stretch")]
    + [("baseline", "min_days", None), ("guards", "cooldown_minutes", "15"), ("thresholds", "kill", None), ("protect", "name_patterns", ["("])],
)
def test_null_wrong_type_or_pattern_is_refused(spark, block, field, value):
    with pytest.raises(PolicyError):
        PolicySet([{"key": "north", "id": "n-1", "overrides": {block: {field: value}}}])
