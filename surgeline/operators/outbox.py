"""What a verdict leads to, as tables: planned actions with their targets, alerts, audit events.

Nothing here talks to a service. A delivery job reads these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiers import ALERT, KILL, NONE, THROTTLE, tier_label, tier_rank
from ..schemas import ITEM

# Item kinds that are datasets, action names, and states of running work.
DATASET_KINDS = ["Dataset", "SemanticModel", "Model"]
NOTIFY = "notify"
CANCEL_REFRESH = "cancel_refresh"
CANCEL_JOBS = "cancel_fabric_jobs"
KILL_SESSIONS = "kill_xmla_sessions"
RUNNING_REFRESH = ["Unknown"]
RUNNING_JOB = ["InProgress", "NotStarted"]

# Result texts.
SKIPPED_KIND = "ignorado: kind="
NO_WORKSPACE_REFRESH = "workspace_id ausente no Metrics App"
NO_WORKSPACE_JOBS = "workspace_id ausente"
NO_WORKSPACE_NAME = "workspace_name não resolvido"
NOTHING_RUNNING = {
    CANCEL_REFRESH: "nenhum refresh em andamento",
    CANCEL_JOBS: "nenhum job em execução",
    KILL_SESSIONS: "nenhuma sessão ativa",
}
DRY_RUN = {
    CANCEL_REFRESH: "[dry-run] cancelaria ",
    CANCEL_JOBS: "[dry-run] cancelaria ",
    KILL_SESSIONS: "[dry-run] mataria ",
}
TIER_ICONS = {ALERT: "⚠️", THROTTLE: "🛑", KILL: "🔴"}
OTHER_ICON = "•"

EVENT_KEY = [*ITEM, "window_end"]


def running_refreshes(work: DataFrame) -> DataFrame:
    return work.filter(F.col("status").isin(RUNNING_REFRESH))


def running_jobs(work: DataFrame) -> DataFrame:
    return work.filter(F.col("status").isin(RUNNING_JOB))


def running_targets(work: DataFrame) -> DataFrame:
    """Work each action could stop. `work` holds what was listed in a cycle: the item,
    `window_end`, `work_kind` (refresh, job or session), `target` and `status`."""
    kind = F.col("work_kind")
    refresh = (kind == "refresh") & F.col("status").isin(RUNNING_REFRESH)
    job = (kind == "job") & F.col("status").isin(RUNNING_JOB)
    action = (
        F.when(refresh, CANCEL_REFRESH).when(job, CANCEL_JOBS).when(kind == "session", KILL_SESSIONS)
    )
    return work.select(*EVENT_KEY, action.alias("action"), "target").filter("action IS NOT NULL")


def planned_actions(gated: DataFrame) -> DataFrame:
    """One row per anomaly and action of its effective tier, with the refusal if it cannot run.

    `ok` and `detail` are already final where the item's kind or workspace rules the action out.
    """
    lists = F.col("policy")["actions"]
    names = (
        F.when(F.col("effective_tier") == KILL, lists["kill"])
        .when(F.col("effective_tier") == THROTTLE, lists["throttle"])
        .when(F.col("effective_tier") == ALERT, lists["alert"])
    )
    steps = F.filter(names, lambda name: name != NOTIFY)
    rows = gated.filter(F.col("effective_tier") > NONE).select(
        *EVENT_KEY, "item_kind", "workspace_id", "workspace_name", F.posexplode(steps).alias("step", "action")
    )
    action = F.col("action")
    other_kind = action.isin(CANCEL_REFRESH, KILL_SESSIONS) & ~F.col("item_kind").isin(DATASET_KINDS)
    blank_id, blank_name = _blank("workspace_id"), _blank("workspace_name")
    refused = (
        F.when(other_kind, F.concat(F.lit(SKIPPED_KIND), "item_kind"))
        .when((action == CANCEL_REFRESH) & blank_id, NO_WORKSPACE_REFRESH)
        .when((action == CANCEL_JOBS) & blank_id, NO_WORKSPACE_JOBS)
        .when((action == KILL_SESSIONS) & blank_name, NO_WORKSPACE_NAME)
    )
    return rows.select(
        *EVENT_KEY, "step", "action", (other_kind | refused.isNull()).alias("ok"), refused.alias("refused")
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def action_targets(plan: DataFrame, work: DataFrame) -> DataFrame:
    """What each planned action would stop, a row per target. Long form, since one item may have
    any number of jobs running."""
    able = plan.filter("refused IS NULL").select(*EVENT_KEY, "step", "action")
    return able.join(running_targets(work), [*EVENT_KEY, "action"])


def action_results(plan: DataFrame, work: DataFrame) -> DataFrame:
    """Result of each planned action if it were run dry. Targets are counted before the join, so
    an item with very many jobs reaches it as one row."""
    key = [*EVENT_KEY, "action"]
    counts = running_targets(work).groupBy(*key).agg(F.count("*").alias("_targets"))
    joined = plan.join(counts, key, "left").withColumn(
        "targets", F.when(F.col("refused").isNull(), F.coalesce("_targets", F.lit(0))).otherwise(0)
    )
    idle, dry = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in NOTHING_RUNNING:
        idle = F.when(F.col("action") == name, NOTHING_RUNNING[name]).otherwise(idle)
        dry = F.when(F.col("action") == name, DRY_RUN[name]).otherwise(dry)
    detail = F.coalesce(
        "refused",
        F.when(F.col("targets") == 0, idle),
        F.concat(dry, F.col("targets").cast("string")),
    )
    return joined.select(*EVENT_KEY, "step", "action", "ok", detail.alias("detail"), "targets")


def action_taken(results: DataFrame) -> DataFrame:
    """Whether an anomaly led to any successful action that had a target."""
    hit = F.col("ok") & (F.col("targets") > 0) & (F.col("action") != NOTIFY)
    return results.groupBy(*EVENT_KEY).agg(F.bool_or(hit).alias("action_taken"))


def with_results(gated: DataFrame, results: DataFrame) -> DataFrame:
    """Anomalies with their results in order, as an array of at most one per action name."""
    entry = F.struct("step", "action", "ok", "detail", "targets")
    collected = results.groupBy(*EVENT_KEY).agg(F.sort_array(F.collect_list(entry)).alias("_results"))
    empty = F.array().cast("array<struct<step:int,action:string,ok:boolean,detail:string,targets:bigint>>")
    return (
        gated.filter(F.col("tier") > NONE)
        .join(collected, EVENT_KEY, "left")
        .withColumn("results", F.coalesce("_results", empty))
        .drop("_results")
    )


def event_projection(with_results_: DataFrame, run_id: Column) -> DataFrame:
    """The 18 audit columns of every anomaly."""
    outcome = F.transform(
        "results", lambda r: F.concat(r["action"], F.when(r["ok"], F.lit(":ok")).otherwise(":fail"))
    )
    spoken = F.filter(F.transform("results", lambda r: r["detail"]), lambda d: d.isNotNull() & (d != ""))
    return with_results_.select(
        F.col("window_end").alias("ts"),
        run_id.alias("run_id"),
        "capacity_key",
        F.col("policy")["mode"].alias("mode"),
        "item_id",
        "item_name",
        "item_kind",
        "workspace_id",
        tier_label(F.col("tier")).alias("tier"),
        tier_label(F.col("effective_tier")).alias("effective_tier"),
        "ratio",
        "cu_seconds",
        F.col("baseline")["value"].alias("baseline_cu_seconds"),
        F.coalesce(F.col("baseline")["days"], F.lit(0)).alias("baseline_days"),
        "streak",
        F.array_join("suppressions", ",").alias("suppressions"),
        F.array_join(outcome, ",").alias("actions"),
        F.array_join(spoken, "; ").alias("detail"),
    )


def alert_text(row_results: str = "results") -> Column:
    """The message of an anomaly. Numbers round half to even, with thousands separators; what is
    unknown stays blank instead of taking its line along."""

    def line(*parts) -> Column:
        return F.concat(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])

    icon = F.lit(OTHER_ICON)
    for tier, symbol in TIER_ICONS.items():
        icon = F.when(F.col("tier") == tier, symbol).otherwise(icon)
    times = F.concat(F.replace(F.format_number("ratio", 2), F.lit(","), F.lit("")), F.lit("x"))
    ratio = F.when(F.col("ratio") != 0, times).otherwise("n/d")
    normal = F.coalesce(F.col("baseline")["value"], F.lit(0.0))
    place = F.when(_blank("workspace_name"), F.col("workspace_id")).otherwise(F.col("workspace_name"))
    minutes = F.replace(F.format_number("minutes", 0), F.lit(","), F.lit(""))
    done = F.transform(
        F.filter(row_results, lambda r: r["action"] != NOTIFY),
        lambda r: F.concat(
            r["action"], F.when(r["ok"], F.lit("=ok (")).otherwise("=FALHOU ("), r["detail"], F.lit(")")
        ),
    )
    # The wording of the message.
    lines = F.array(
        line(
            icon, F.lit(" **["), "capacity_key", F.lit("]** `"), "item_name", F.lit("` ("), "item_kind",
            F.lit(") a **"), ratio, F.lit("** da baseline"),
        ),
        line(
            F.lit("Consumo: "), F.format_number("cu_seconds", 0), F.lit(" CU·s em "), minutes,
            F.lit(" min | baseline: "), F.format_number(normal, 0), F.lit(" CU·s | workspace: "), place,
        ),
        line(
            F.lit("Detectado: `"), tier_label(F.col("tier")), F.lit("` → aplicado: `"),
            tier_label(F.col("effective_tier")), F.lit("` (modo `"), F.col("policy")["mode"], F.lit("`)"),
        ),
        F.when(F.size("suppressions") > 0, F.concat(F.lit("Contido por: "), F.array_join("suppressions", ", "))),
        F.when(F.size(done) > 0, F.concat(F.lit("Ações: "), F.array_join(done, " | "))),
        line(F.lit("Item ID: `"), "item_id", F.lit("`")),
    )
    return F.array_join(F.array_compact(lines), "\n")


def min_tier_filter(anomalies: DataFrame) -> DataFrame:
    """A row per anomaly and channel that wants its detected tier; the kind `none` sends nothing."""
    channel = F.col("_channel")
    return (
        anomalies.filter(F.col("tier") > NONE)
        .withColumn("_channel", F.explode(F.col("policy")["notify"]))
        .filter((channel["kind"] != "none") & (F.col("tier") >= tier_rank(channel["min_tier"])))
        .withColumn("channel", channel["kind"])
        .drop("_channel")
    )


def alert_outbox(anomalies: DataFrame) -> DataFrame:
    """Messages to send. An anomaly is announced even if every action on it was held back."""
    return min_tier_filter(anomalies).select(*EVENT_KEY, "channel", "tier", alert_text().alias("text"))
