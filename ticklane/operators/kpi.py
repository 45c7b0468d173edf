"""KPI report per run.

One pass over the ticks of all runs at once. Ticks are shuffled once, by (run,
tick slice), and reduced to a handful of numbers per slice; only those are
brought together per run.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.constants import IN_LANE_CTE, NO_HIT, OFFTRACK_CTE
from ticklane.functions.rounding import round_sql
from ticklane.plans.spread import TICK_SLICE, slice_of
from ticklane.schemas import KPI, KPI_FIELDS

# Spark orders NaN above every number; the contract counts it for nothing.
IN_LANE = f"abs(cte) < {IN_LANE_CTE}D"
OFF_TRACK = f"abs(cte) >= {OFFTRACK_CTE}D and not isnan(cte)"
COLLIDED = f"hit != '{NO_HIT}'"

#: Telemetry columns that the report reads, besides run_id.
COLUMNS = ["tick", "ts", "speed", "cte", "hit", "lap_count", "last_lap_time"]

_SCORED = [
    "run_id",
    "tick",
    "ts",
    "speed",
    "lap_count",
    "last_lap_time",
    "abs(cte) as abs_cte",
    f"{IN_LANE} as in_lane",
    f"{OFF_TRACK} as off",
    f"{COLLIDED} as hit_on",
]

# Totals over ticks, and how partial totals are put together.
_OF_TICKS = [
    "count(*) as ticks",
    "min(ts) as ts_min",
    "max(ts) as ts_max",
    "max(lap_count) as laps",
    "sum(abs_cte) as cte_sum",
    "max(abs_cte) as cte_max",
    "sum(speed) as speed_sum",
    "max(speed) as speed_max",
    "count_if(in_lane) as lane_ticks",
]
_TOTALS = [part.split(" as ")[1] for part in _OF_TICKS]
_OF_TOTALS = [
    "sum(ticks) as ticks",
    "min(ts_min) as ts_min",
    "max(ts_max) as ts_max",
    "max(laps) as laps",
    "sum(cte_sum) as cte_sum",
    "max(cte_max) as cte_max",
    "sum(speed_sum) as speed_sum",
    "max(speed_max) as speed_max",
    "sum(lane_ticks) as lane_ticks",
]
_OF_EVENTS = ["sum(collisions) as collisions", "sum(offtrack_events) as offtrack_events"]

# Report fields from totals. A last time stamp of 0 counts as missing.
_FROM_TOTALS = [
    f"coalesce(if(ts_max != 0D, {round_sql('(ts_max - ts_min)', 1)}, null), 0D) as duration_s",
    "ticks",
    "coalesce(laps, 0) as laps",
    f"coalesce({round_sql('(cte_sum / ticks)', 3)}, 0D) as mean_abs_cte",
    f"coalesce({round_sql('cte_max', 3)}, 0D) as max_abs_cte",
    f"{round_sql('(100D * lane_ticks / ticks)', 1)} as pct_in_lane",
    f"coalesce({round_sql('(speed_sum / ticks)', 3)}, 0D) as avg_speed",
    f"coalesce({round_sql('speed_max', 3)}, 0D) as max_speed",
]


def _all(*expressions: list[str]) -> list[Column]:
    return [F.expr(e) for part in expressions for e in part]


def basics(telemetry: DataFrame) -> DataFrame:
    """The order-free part of the report: one hash aggregate, combined map-side."""
    totals = telemetry.selectExpr(*_SCORED).groupBy("run_id").agg(*_all(_OF_TICKS))
    return totals.selectExpr("run_id", *_FROM_TOTALS)


_FIRST = ["hit_on", "off", "lap_count", "last_lap_time"]
_LAST = ["hit_on", "off", "lap_count"]
_FINISHES = "{0}last_lap_time > 0D and not isnan({0}last_lap_time)"


def slices(
    telemetry: DataFrame, size: int = TICK_SLICE, placed: bool = False, apart: Sequence[str] = ()
) -> DataFrame:
    """One row per (run, tick slice): totals, events inside it, its end states.

    Events at the first tick are left out; they depend on what comes before, and are
    settled when rows are put in order. With ``placed``, ticks carry their slice in the
    column _slice, as spread_join leaves it. Ticks that differ in the columns ``apart`` are
    summarised apart.

    Lap times need a list, but collecting lists over raw ticks would turn the
    aggregate into an object one. The ticks that finish a lap are few and are made
    groups of their own first, next to one group of all others, so that each group
    has at most one lap time and plain numbers suffice.
    """
    key = ["run_id", "_slice", *apart]
    by_tick = f"(partition by {', '.join(key)} order by tick)"
    # The first tick of a slice has no previous one here: its conditions are
    # null and count for nothing.
    lap_done = f"lap_count > prev_laps and {_FINISHES.format('')}"
    if not placed:
        telemetry = telemetry.withColumn("_slice", slice_of("tick", size))
    ticks = (
        telemetry.selectExpr(*_SCORED, *key[1:])
        .selectExpr(
            "*",
            f"lag(hit_on) over {by_tick} as prev_hit",
            f"lag(off) over {by_tick} as prev_off",
            f"lag(lap_count) over {by_tick} as prev_laps",
        )
        .selectExpr("*", f"if({lap_done}, tick, null) as lap_tick")
    )
    laps = ticks.groupBy(*key, "lap_tick").agg(
        *_all(
            _OF_TICKS,
            [
                "count_if(hit_on and not prev_hit) as collisions",
                "count_if(off and not prev_off) as offtrack_events",
                "max(if(lap_tick is not null, last_lap_time, null)) as lap_time",
                "min(tick) as first_tick",
                "max(tick) as last_tick",
            ],
            [f"min_by({s}, tick) as first_{s}" for s in _FIRST],
            [f"max_by({s}, tick) as last_{s}" for s in _LAST],
        )
    )
    lap_list = "sort_array(collect_list(if(lap_tick is not null, struct(lap_tick, lap_time), null))) as lap_list"
    return laps.groupBy(*key).agg(*_all(_OF_TOTALS, _OF_EVENTS, [lap_list], _OF_ENDS))


_OF_ENDS = [
    "min(first_tick) as first_tick",
    "max(last_tick) as last_tick",
    *[f"min_by(first_{s}, first_tick) as first_{s}" for s in _FIRST],
    *[f"max_by(last_{s}, last_tick) as last_{s}" for s in _LAST],
]


def merged(parts: DataFrame) -> DataFrame:
    """One row per (run, slice) from several, as ``slices`` of all their ticks would give.

    The parts of a slice must not overlap in their tick ranges.
    """
    before = "over (partition by run_id, _slice order by first_tick)"
    lap = f"first_lap_count > lag(last_lap_count) {before} and {_FINISHES.format('first_')}"
    joined = parts.selectExpr(
        "run_id",
        "_slice",
        *_TOTALS,
        f"collisions + coalesce(int(first_hit_on and not lag(last_hit_on) {before}), 0) as collisions",
        f"offtrack_events + coalesce(int(first_off and not lag(last_off) {before}), 0) as offtrack_events",
        f"concat(if({lap}, array(struct(first_tick as lap_tick, first_last_lap_time as lap_time)), "
        "filter(lap_list, x -> false)), lap_list) as lap_list",
        "first_tick",
        "last_tick",
        *[f"first_{s}" for s in _FIRST],
        *[f"last_{s}" for s in _LAST],
    )
    laps = "sort_array(flatten(collect_list(lap_list))) as lap_list"
    return joined.groupBy("run_id", "_slice").agg(*_all(_OF_TOTALS, _OF_EVENTS, [laps], _OF_ENDS))


def _in_order(rows: DataFrame) -> DataFrame:
    """Slices of ``slices`` with the events at their first tick added."""
    before = "over (partition by run_id order by _slice)"
    was_hit = f"lag(last_hit_on, 1, false) {before}"
    was_off = f"lag(last_off, 1, false) {before}"
    had_laps = f"lag(last_lap_count, 1, 0) {before}"
    first_lap = f"first_lap_count > {had_laps} and {_FINISHES.format('first_')}"
    return rows.selectExpr(
        "run_id",
        "_slice",
        *_TOTALS,
        f"collisions + int(first_hit_on and not {was_hit}) as collisions",
        f"offtrack_events + int(first_off and not {was_off}) as offtrack_events",
        f"concat(if({first_lap}, array(first_last_lap_time), cast(array() as array<double>)), "
        "lap_list.lap_time) as slice_laps",
    )


def report_of(rows: DataFrame) -> DataFrame:
    """The report from slices, which no tick is needed for."""
    laps_by_slice = (
        "sort_array(collect_list(if(size(slice_laps) > 0, struct(_slice, slice_laps), null))) "
        "as laps_by_slice"
    )
    runs = _in_order(rows).groupBy("run_id").agg(*_all(_OF_TOTALS, _OF_EVENTS, [laps_by_slice]))
    return runs.selectExpr(
        "run_id",
        *_FROM_TOTALS,
        "collisions",
        "offtrack_events",
        f"transform(flatten(laps_by_slice.slice_laps), t -> {round_sql('t', 1)}) as lap_times",
    ).select("run_id", *KPI_FIELDS)


def report(telemetry: DataFrame, size: int = TICK_SLICE, placed: bool = False) -> DataFrame:
    """run_id and the KPI fields, one row per run that has ticks; ``placed`` as in ``slices``."""
    return report_of(slices(telemetry, size, placed))


def lap_rows(telemetry: DataFrame, size: int = TICK_SLICE) -> DataFrame:
    """Lap times in long form: (run_id, lap_index, lap_time), index from 0.

    Numbered by slices: no array holds the laps of a whole run.
    """
    earlier = "over (partition by run_id order by _slice rows between unbounded preceding and 1 preceding)"
    numbered = _in_order(slices(telemetry, size)).selectExpr(
        "run_id", "slice_laps", f"int(coalesce(sum(size(slice_laps)) {earlier}, 0)) as before"
    )
    return numbered.selectExpr("run_id", "before", "posexplode(slice_laps) as (i, t)").selectExpr(
        "run_id", "before + i as lap_index", f"{round_sql('t', 1)} as lap_time"
    )


def _or_empty() -> list[str]:
    """Report fields, with the values of a run without ticks where there are none."""
    kinds = dict(part.split(" ") for part in KPI.split(", "))
    zero = {name: f"cast(0 as {kind})" for name, kind in kinds.items()}
    zero["lap_times"] = f"cast(array() as {kinds['lap_times']})"
    return [f"coalesce({name}, {zero[name]}) as {name}" for name in KPI_FIELDS]


def report_for(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """A report from slices for each run_id in ``runs``, all zeros where there is none."""
    found = runs.join(report_of(rows), "run_id", "left")
    return found.selectExpr(*runs.columns, *_or_empty())


def as_json(report_rows: DataFrame) -> DataFrame:
    """The report as the JSON document that is stored with a run."""
    return report_rows.select("run_id", F.to_json(F.struct(*KPI_FIELDS)).alias("summary"))
