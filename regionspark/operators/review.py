"""Review of masks and frames: states, checks, scopes, orders and acceptance, as columns or small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a mask, the most severe first; filters and the states that they show.
SEVERITY = (
    "unreadable_image", "unreadable_mask", "no_mask", "size_mismatch", "empty_mask", "full_mask", "intermediate_values", "not_saved", "needs_check", "ok",
)
FILTERS = {
    "ok": ("ok",), "warn": ("needs_check", "intermediate_values", "full_mask"), "not_saved": ("not_saved",), "no_mask": ("no_mask",),
    "size_mismatch": ("size_mismatch",), "empty_mask": ("empty_mask",), "full_mask": ("full_mask",),
    "intermediate_values": ("intermediate_values",), "error": ("unreadable_image", "unreadable_mask"),
}
#: Shares from which a mask is full, excludes much or differs much.
FULL, EXCLUDED_HIGH, DIFF_HIGH = 0.95, 0.95, 0.50


def effective_status(checked: Column, modified: Column, mismatch: Column, has_mask: Column) -> Column:
    """The result of the check, if there is one (unsaved edits turn ``ok`` into ``not_saved``); else what the flags say."""
    of_check = F.when(modified & (checked == "ok"), "not_saved").otherwise(checked)
    of_flags = F.when(mismatch, "size_mismatch").when(modified, "not_saved").when(has_mask, "ok").otherwise("no_mask")
    return F.when(checked.isNotNull(), of_check).otherwise(of_flags)


def matches(name: Column, status: Column, modified: Column, registered: Column) -> Column:
    """Whether a row shows under a filter; unknown filters and ``all`` show all."""
    shown = F.when(name == "unregistered", ~registered)
    for filter_name, states in FILTERS.items():
        hit = status.isin(*states)
        shown = shown.when(name == filter_name, hit | modified if filter_name == "not_saved" else hit)
    return shown.otherwise(F.lit(True))


def checked_mask(image_ok: Column, mask_there: Column, mask_ok: Column, same_size: Column, black: Column, total: Column, between: Column, modified: Column) -> Column:
    """A struct (status, others): the most severe issue of a mask and the others joined by commas. Empty: nothing is
    excluded; full: the excluded share is 0.95 or more."""
    share = F.when(total > 0, black / total).otherwise(0.0)
    found = {"size_mismatch": ~same_size, "empty_mask": black == 0, "full_mask": share >= FULL, "intermediate_values": between, "not_saved": modified}
    rank = {name: i for i, name in enumerate(SEVERITY)}
    issues = F.array_compact(F.array(*[F.when(found[name], name) for name in sorted(found, key=rank.__getitem__)]))
    early = F.when(~image_ok, "unreadable_image").when(~mask_there, F.when(modified, "not_saved").otherwise("no_mask")).when(~mask_ok, "unreadable_mask")
    status = F.coalesce(early, F.get(issues, F.lit(0)), F.lit("ok"))
    others = F.when(early.isNotNull(), "").otherwise(F.array_join(F.slice(issues, 2, F.greatest(F.size(issues) - 1, F.lit(0))), ","))
    return F.struct(status.alias("status"), others.alias("others"))


def save_warnings(effective: Column, total: Column, changed: Column) -> Column:
    """Codes of a mask about to be saved, in a fixed order: nothing left, nothing excluded, much excluded, much changed
    (null: no mask before)."""
    excluded = total - effective
    codes = F.array(
        F.when(effective == 0, "ALL_ZERO"),
        F.when(excluded == 0, "ALL_FULL"),
        F.when((effective > 0) & (excluded / total >= EXCLUDED_HIGH), "EXCLUDED_HIGH"),
        F.when(changed / total >= DIFF_HIGH, "DIFF_HIGH"),
    )
    return F.when(total > 0, F.array_compact(codes)).otherwise(F.array().cast("array<string>"))


def cache_validity(schema: Column, source: Column, size: Column, segments: Column, partition: Column, settings: Column) -> Column:
    """The first of six comparisons of a stored partition that fails, else ``valid``; a missing value fails."""
    out = None
    for same, name in ((schema, "schema"), (source, "source"), (size, "size"), (segments, "segments"), (partition, "partition"), (settings, "settings")):
        fails = ~F.coalesce(same, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise("valid")


def is_stale(there: Column, *same: Column) -> Column:
    """Whether a stored index or state must be made again: it is missing, or one of its keys differs."""
    out = ~F.coalesce(there, F.lit(False))
    for s in same:
        out |= ~F.coalesce(s, F.lit(False))
    return out


def in_scope(scope: str, state: Column, failed: Column, selected: Column, current: Column) -> Column:
    """Which images a scope takes: all, current, selected, failed, unprocessed (missing or corrupt), stale."""
    scopes = {"all": F.lit(True), "current": current, "selected": selected, "failed": failed, "unprocessed": state.isin("missing", "corrupt"), "stale": state == "stale"}
    return scopes[scope]


def review_items(images: DataFrame, states: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Images with a reusable result, and their status in the batch (``unprocessed`` where it has none)."""
    ready = images.join(states.filter("state = 'reusable'").select(key), key, "left_semi")
    return ready.join(batch.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("unprocessed")))


def cache_summary(states: DataFrame) -> DataFrame:
    """Results by state, and the megabytes that those to be made again are planned to take (half a megabyte each)."""
    again = F.count_if(F.col("state") != "reusable")
    return states.agg(
        F.count_if(F.col("state") == "reusable").alias("reusable"), F.count_if(F.col("state") == "corrupt").alias("corrupt"),
        F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"), (again * 0.5).alias("planned_mb"),
    )


def is_reviewable(state: Column, has_result: Column) -> Column:
    return has_result & state.isin("done", "warning")


def accepted_frames(frames: DataFrame) -> DataFrame:
    """Frames (accepted, state, has_result, is_reference) that a bulk apply takes."""
    return frames.filter(F.col("accepted") & is_reviewable(F.col("state"), F.col("has_result")) & ~F.col("is_reference"))


def bulk_accepted(frames: DataFrame, kind: str) -> DataFrame:
    """Frames after accepting ``all``, ``none`` or those without warnings (``no_warn``); only reviewable ones change."""
    made = {"all": F.lit(True), "none": F.lit(False), "no_warn": F.col("warnings") == 0}[kind]
    return frames.withColumn("accepted", F.when(is_reviewable(F.col("state"), F.col("has_result")), made).otherwise(F.col("accepted")))


def session_counts(frames: DataFrame, job: str) -> DataFrame:
    """Completed (with or without warnings), warning and failed frames of each job."""
    state = F.col("state")
    return frames.groupBy(job).agg(F.count_if(state.isin("done", "warning")).alias("completed"), F.count_if(state == "warning").alias("warning"), F.count_if(state == "failed").alias("failed"))


def batch_counters(items: DataFrame, job: str) -> DataFrame:
    """Processed, succeeded, reused and failed items of a job, and the largest memory seen."""
    status = F.col("status")
    return items.groupBy(job).agg(
        F.count_if(status.isin("succeeded", "reused", "failed")).alias("processed"), F.count_if(status == "succeeded").alias("succeeded"),
        F.count_if(status == "reused").alias("reused"), F.count_if(status == "failed").alias("failed"), F.max("memory").alias("peak"),
    )


def recovered(items: DataFrame) -> DataFrame:
    """After a crash what was being processed counts as not processed."""
    return items.withColumn("status", F.when(F.col("status") == "processing", "unprocessed").otherwise(F.col("status")))


def latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The latest row of each key, as events update a state; ties go to the largest of the other columns."""
    rest = [c for c in rows.columns if c not in (*key, seq)]
    last = rows.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("_last"))
    return last.select(*key, "_last.*")


def sort_ranks(candidates: DataFrame, widget: bool = False) -> DataFrame:
    """Ranks of an image's candidates by priority, area, quality and edge, ties by id; in the list widget, ties by edge go
    by priority first."""
    own = Window.partitionBy("image")
    edge = [F.desc("edge"), *([F.desc("priority")] if widget else []), "sid"]
    orders = {"priority": [F.desc("priority"), "sid"], "area": [F.desc("area"), "sid"], "quality": [F.desc("quality"), "sid"], "edge": edge}
    ranks = [F.row_number().over(own.orderBy(*order)).cast("long").alias(f"by_{name}") for name, order in orders.items()]
    return candidates.select("image", "sid", *ranks)


def bounded_history(log: DataFrame, key: list[str], seq: str, most: int) -> DataFrame:
    """The latest ``most`` steps of each key."""
    back = Window.partitionBy(*key).orderBy(F.desc(seq))
    return log.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= most).drop("_n")


def undo_redo(log: DataFrame, key: list[str], most: int = 50, unchanged: bool = False) -> DataFrame:
    """State after a log (seq, op, value) of edits with undo and redo: an edit drops what could be redone, at most ``most``
    steps can be undone, undo and redo without steps do nothing. Columns: value, undos, redos. With ``unchanged`` an edit
    without a value is a step that keeps the value, as an edit of a mask that leaves the decisions beside it alone.

    A fold over an item's own steps in order; an item's log is short."""
    steps = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "value"))).alias("steps"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("now"), none.alias("back"), none.alias("ahead"))

    def step(state: Column, s: Column) -> Column:
        pushed = F.concat(state["back"], F.array(F.coalesce(state["now"], F.lit(""))))
        kept = F.when(F.size(pushed) > most, F.slice(pushed, 2, most)).otherwise(pushed)
        value = F.coalesce(s["value"], state["now"]) if unchanged else s["value"]
        edit = F.struct(value.alias("now"), kept.alias("back"), none.alias("ahead"))
        popped = F.slice(state["back"], 1, F.greatest(F.size(state["back"]) - 1, F.lit(0)))
        undone = F.struct(F.try_element_at(state["back"], F.lit(-1)).alias("now"), popped.alias("back"), F.concat(state["ahead"], F.array(F.coalesce(state["now"], F.lit("")))).alias("ahead"))
        left = F.slice(state["ahead"], 1, F.greatest(F.size(state["ahead"]) - 1, F.lit(0)))
        redone = F.struct(F.try_element_at(state["ahead"], F.lit(-1)).alias("now"), pushed.alias("back"), left.alias("ahead"))
        return (
            F.when(s["op"] == "edit", edit)
            .when((s["op"] == "undo") & (F.size(state["back"]) > 0), undone)
            .when((s["op"] == "redo") & (F.size(state["ahead"]) > 0), redone)
            .otherwise(state)
        )

    end = F.aggregate("steps", start, step)
    return steps.select(*key, end["now"].alias("value"), F.size(end["back"]).cast("long").alias("undos"), F.size(end["ahead"]).cast("long").alias("redos"))


def timed_out(requests: DataFrame, responses: DataFrame, limits: dict[str, int], default: int) -> DataFrame:
    """Requests (request_id, command, sent) without a response (request_id, received) within the seconds of their command."""
    pairs = [F.lit(x) for item in limits.items() for x in item]
    limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("command")), F.lit(default)) if pairs else F.lit(default)
    due = requests.withColumn("due", F.col("sent") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), limit))
    first = responses.groupBy("request_id").agg(F.min("received").alias("received"))
    return due.join(first, "request_id", "left").filter(F.col("received").isNull() | (F.col("received") > F.col("due"))).select(*requests.columns)
