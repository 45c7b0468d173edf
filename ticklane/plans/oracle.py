"""The same questions as plain SQL over the supplied tables, for checking.

Written for clarity on one machine: whole-run windows, no slices.
"""

from ticklane.plans.derive import RUN_PREFIX, SEASON_PREFIX, UNKNOWN_SEASON

ORACLE_SQL: dict[str, str] = {}


def _round(x: str, digits: int) -> str:
    return f"cast(format('{{:.{digits}f}}', cast({x} as double)) as double)"


def _run_id(n: str) -> str:
    return f"concat('{RUN_PREFIX}', lpad(cast({n} as varchar), 12, '0'))"


def _season_id(n: str) -> str:
    return f"concat('{SEASON_PREFIX}', lpad(cast({n} as varchar), 12, '0'))"


_N = f"cast(substr(run_id, {len(RUN_PREFIX) + 1}) as int)"

TELEMETRY = f"""
e as (
  select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k,
    row_number() over (partition by user_id order by ts, event_id) - 1 as tick0,
    sum(case when event_type = 'signup' then 1 else 0 end) over (
      partition by user_id order by ts, event_id
      rows between unbounded preceding and current row) as laps0
  from events),
telemetry as (
  select row_number() over (order by ts, event_id) as arrival,
    {_season_id('user_id % 10')} as season_id, {_run_id('user_id')} as run_id,
    cast(tick0 as int) as tick, epoch_us(ts) / cast(1000000 as double) as ts,
    cast((event_id % 241) - 120 as double) / cast(100 as double) as steering,
    cast(0.3 as double) as throttle,
    value / cast(9.7 as double) as speed, value / cast(11.3 as double) as forward_vel,
    case when value = 50 then cast(0 as double) else
      (case when k % 2 = 1 then -1 else 1 end) * (value - cast(50 as double))
      / cast(37 as double) end as cte,
    value as pos_x, cast(k as double) as pos_y, cast(0 as double) as pos_z,
    value / cast(3 as double) as vel_x, cast(0 as double) as vel_y,
    cast(k as double) / cast(7 as double) as vel_z,
    cast(k - 50 as double) / cast(100 as double) as gyro_z,
    case when event_type <> 'error' then 'none' when k % 2 = 0 then 'pole' else 'cone' end as hit,
    cast(laps0 % 4 as int) as lap_count,
    case when event_type = 'signup' and k % 10 <> 0 then value else cast(0 as double) end
      as last_lap_time,
    event_type = 'error' and k > 95 as terminated
  from e)"""

SEASONS = f"""
seasons as (
  select {_season_id('n_nationkey')} as id, n_name,
    case when n_nationkey % 2 = 0 then 'windows' else 'linux' end as os,
    concat('track-', cast(n_regionkey as varchar)) as track_id,
    case when n_nationkey % 3 = 0 then 'rl' else 'random' end as driver,
    cast(1704067200 + n_nationkey * 3600 as double) as created_at
  from nation)"""

RUNS = f"""
runs as (
  select run_id as id,
    case when {_N} % 50 = 7 then '{UNKNOWN_SEASON}' else season_id end as season_id,
    case when {_N} % 3 = 0 then 'rl' else 'random' end as driver,
    case {_N} % 4 when 0 then 'running' when 1 then 'crashed' else 'completed' end as status,
    min(ts) as started_at, case when {_N} % 4 <> 0 then max(ts) end as ended_at
  from telemetry group by run_id, season_id)"""

FRAMES = """
frames as (
  select run_id, tick as frame_tick from telemetry where tick % 5 = 0 and pos_y % 3 <> 0)"""

LOG = f"""
b as (select *, arrival as o, {_N} as n, max(tick) over (partition by run_id) as mt
      from telemetry),
log as (
  select o * 20 as log_offset, 'telemetry' as kind, season_id, run_id, tick, ts, speed, cte, hit,
    lap_count, last_lap_time, terminated, cast(null as varchar) as driver,
    cast(null as varchar) as status from b
  union all select o * 20 + 1, 'telemetry', season_id, run_id, tick, ts, speed + 1, cte, hit,
    lap_count, last_lap_time, terminated, null, null from b where o % 10 = 0
  union all select o * 20 - 1, 'run_start', season_id, run_id, null, ts, null, null, null,
    null, null, null, case when n % 3 = 0 then 'rl' else 'random' end, null
    from b where tick = 0 and n % 17 <> 0
  union all select o * 20 + 2, 'run_start', season_id, run_id, null, ts, null, null, null,
    null, null, null, 'rl', null from b where tick = 5 and n % 4 = 0
  union all select o * 20 + 3, 'run_end', season_id, run_id, null, ts, null, null, null,
    null, null, null, null, case when n % 3 = 0 then 'crashed' else 'completed' end
    from b where tick = mt - 3 and n % 7 <> 0
  union all select o * 20 + 4, 'run_end', season_id, run_id, null, ts, null, null, null,
    null, null, null, null, 'crashed' from b where tick = mt - 1 and n % 5 = 0),
bad as (
  select o * 20 + 6 as log_offset, 'malformed' as kind, 'malformed' as reason, ts, season_id from b
    where o % 101 = 1
  union all select o * 20 + 7, 'telemetry', 'missing:run_id', ts, season_id from b where o % 103 = 2
  union all select o * 20 + 8, 'telemetry', 'bad_id:run_id', ts, season_id from b where o % 107 = 3
  union all select o * 20 + 9, 'telemetry', 'bad_type:tick', ts, season_id from b where o % 109 = 4
  union all select o * 20 + 10, 'telemetry', 'not_finite:cte', ts, season_id from b where o % 113 = 5
  union all select o * 20 + 11, 'telemetry', 'too_long:hit', ts, season_id from b where o % 127 = 6
  union all select o * 20 + 12, 'telemetry', 'null:speed', ts, season_id from b where o % 131 = 7
  union all select o * 20 + 13, 'run_start', 'null:driver', ts, season_id from b where o % 137 = 8
  union all select o * 20 + 14, 'run_start', 'unknown:season_id', ts, season_id from b where o % 139 = 9),
starts as (
  select run_id, min(log_offset) as start_offset, arg_min(season_id, log_offset) as season_id,
    arg_min(driver, log_offset) as driver, arg_min(ts, log_offset) as started_at
  from log where kind = 'run_start' group by run_id),
ends as (
  select l.run_id, arg_min(l.status, l.log_offset) as status, arg_min(l.ts, l.log_offset) as ended_at,
    max(l.log_offset) as last_end_offset
  from log l join starts s on l.run_id = s.run_id and l.log_offset > s.start_offset
  where l.kind = 'run_end' group by l.run_id),
kept as (
  select l.* from log l join starts s on l.run_id = s.run_id and l.log_offset > s.start_offset
  where l.kind = 'telemetry'
  qualify row_number() over (partition by l.run_id, l.tick order by l.log_offset) = 1),
closed as (
  select k.* from kept k join ends d on k.run_id = d.run_id
  where k.log_offset < d.last_end_offset)"""


def _report(source: str, name: str) -> str:
    """CTEs that end in a report per run over ``source``."""
    return f"""
{name}_l as (
  select *, lag(hit, 1, 'none') over w as ph, lag(lap_count, 1, 0) over w as pl,
    lag(case when abs(cte) >= 1.0 then 1 else 0 end, 1, 0) over w as po
  from {source} window w as (partition by run_id order by tick)),
{name} as (
  select run_id,
    {_round('max(ts) - min(ts)', 1)} as duration_s, count(*) as ticks, max(lap_count) as laps,
    coalesce(string_agg(format('{{:.1f}}', last_lap_time), ',' order by tick)
      filter (where lap_count > pl and last_lap_time > 0), '') as lap_times,
    {_round('avg(abs(cte))', 3)} as mean_abs_cte, {_round('max(abs(cte))', 3)} as max_abs_cte,
    {_round('cast(100 as double) * count(*) filter (where abs(cte) < 0.5) / count(*)', 1)}
      as pct_in_lane,
    {_round('avg(speed)', 3)} as avg_speed, {_round('max(speed)', 3)} as max_speed,
    count(*) filter (where hit <> 'none' and ph = 'none') as collisions,
    count(*) filter (where abs(cte) >= 1.0 and po = 0) as offtrack_events
  from {name}_l group by run_id)"""


def _zeros(alias: str) -> str:
    """Report columns with the values of a run without ticks."""
    zero = {"lap_times": "''", "ticks": "0", "laps": "0", "collisions": "0", "offtrack_events": "0"}
    names = (
        "duration_s ticks laps lap_times mean_abs_cte max_abs_cte pct_in_lane avg_speed "
        "max_speed collisions offtrack_events"
    ).split()
    return ", ".join(
        f"coalesce({alias}.{n}, {zero.get(n, 'cast(0 as double)')}) as {n}" for n in names
    )


def _add(name: str, ctes: list[str], select: str) -> None:
    ORACLE_SQL[name] = (f"with {','.join(ctes)}\n" if ctes else "") + select


_KPI = [TELEMETRY, _report("telemetry", "report")]
_BASIC = "run_id, duration_s, ticks, laps, mean_abs_cte, max_abs_cte, pct_in_lane, avg_speed, max_speed"
_add("kpi_report", _KPI, "select * from report")
_add("kpi_basic", _KPI, f"select {_BASIC} from report")
_add("kpi_duration", _KPI, "select run_id, duration_s from report")
_add("kpi_pct_in_lane", _KPI, "select run_id, ticks, pct_in_lane from report")
_add(
    "kpi_cte_speed",
    _KPI,
    "select run_id, mean_abs_cte, max_abs_cte, avg_speed, max_speed from report",
)
_add("kpi_laps", _KPI, "select run_id, laps from report")
_add("collisions", _KPI, "select run_id, collisions from report")
_add("offtrack_events", _KPI, "select run_id, offtrack_events from report")
_add(
    "lap_times",
    _KPI,
    f"""select run_id, cast(row_number() over (partition by run_id order by tick) - 1 as int)
      as lap_index, {_round('last_lap_time', 1)} as lap_time
    from report_l where lap_count > pl and last_lap_time > 0""",
)
_add(
    "empty_run_report",
    _KPI,
    f"""select w.run_id, {_zeros('r')}
    from (select {_run_id('c_custkey')} as run_id from customer) w
    left join report r on w.run_id = r.run_id""",
)

_T = [TELEMETRY]
_POINT = "run_id, tick, ts, speed, cte, pos_x, pos_y, steering, throttle"
_add("run_tick_counts", _T, "select run_id, count(*) as ticks from telemetry group by run_id")
_add("telemetry_points", _T, f"select {_POINT} from telemetry")
for _points in (10, 1000):
    _add(
        f"downsample_{_points}",
        _T,
        f"""select {_POINT} from (
          select *, greatest(1, cast(ceil(count(*) over (partition by run_id) / {_points}.0) as bigint))
            as stride from telemetry)
        where tick % stride = 0""",
    )
_add("speed_series", _T, "select run_id, tick, speed from telemetry")
_add(
    "cte_series_band",
    _T,
    """select run_id, tick, cte, cast(0.5 as double) as upper, cast(-0.5 as double) as lower
    from telemetry""",
)
_add("track_path", _T, "select run_id, tick, pos_x, pos_y from telemetry")

_S = [TELEMETRY, SEASONS, RUNS]
_add(
    "season_rows",
    [SEASONS],
    """select id, cast(null as varchar) as user_id, os, '1.0' as sdk_version,
      '22.11' as simulator_version, track_id, n_name as car_body, driver, created_at,
      created_at as updated_at from seasons""",
)
_add(
    "seasons_by_driver",
    _S,
    """select id, track_id, driver from seasons s
    where exists (select 1 from runs r where r.season_id = s.id and r.driver = 'rl')""",
)
_add(
    "season_detail",
    _S,
    """select s.id, s.track_id, s.driver, r.id as run_id, r.driver as run_driver,
      r.status as run_status, r.started_at as run_started_at, r.ended_at as run_ended_at,
      case when r.id is not null then
        row_number() over (partition by s.id order by r.started_at desc, r.id desc) - 1 end as position
    from seasons s left join runs r on r.season_id = s.id""",
)
_add("season_runs", _S, "select season_id, id, driver, status, started_at, ended_at from runs")
_add(
    "newest_run",
    _S,
    """select season_id, id, status, started_at from runs
    qualify row_number() over (partition by season_id order by started_at desc, id desc) = 1""",
)
_add(
    "orphan_runs",
    _S,
    "select id, season_id from runs where season_id not in (select id from seasons)",
)
_add(
    "orphan_ticks",
    _S,
    """select run_id, tick from telemetry
    where cast(substr(run_id, 25) as int) % 20 = 3""",
)
for _name, _not in (("cascade_set", ""), ("cascade_survivors", "not ")):
    _add(
        _name,
        _S,
        f"""select 'run' as kind, id as run_id, -1 as tick from runs
        where season_id {_not}in (select id from seasons where driver = 'rl')
        union all select 'tick', run_id, tick from telemetry where run_id {_not}in (
          select id from runs where season_id in (select id from seasons where driver = 'rl'))""",
    )
_add(
    "run_enriched",
    _S,
    """select t.run_id, t.tick, t.speed, t.cte, r.season_id, r.driver, r.status, s.track_id, s.os
    from telemetry t join runs r on t.run_id = r.id join seasons s on r.season_id = s.id""",
)
_TIME = "make_timestamp(cast(round({} * 1000000) as bigint))"
_add(
    "run_labels",
    _S,
    f"""select id, substr(id, 1, 8) as short_id, concat(driver, ' · ', status, ' · ',
      strftime({_TIME.format('started_at')}, '%H:%M:%S')) as label from runs""",
)
_add(
    "season_labels",
    [SEASONS],
    f"""select id, substr(id, 1, 8) as short_id, concat(
      strftime({_TIME.format('created_at')}, '%Y-%m-%d %H:%M:%S'), ' · ', track_id) as label
    from seasons""",
)
_add("driver_backfill", [SEASONS], "select id, driver from seasons")
_add(
    "season_conformance",
    [],
    """select p_partkey, array_to_string(list_filter([
      case when p_size % 7 = 0 then 'missing:sdk_version' end,
      case when length(p_brand) > 10 then 'too_long:os' end,
      case when length(p_type) > 10 then 'too_long:simulator_version' end,
      case when length(p_name) * 6 > 100 then 'too_long:track_id' end,
      case when p_size % 3 = 2 then 'not_allowed:driver' end], lambda x: x is not null), ',')
      as reasons from part""",
)

_F = [TELEMETRY, FRAMES]
_add("frame_cadence", _F, "select run_id, tick from telemetry where tick % 5 = 0")
_add(
    "frame_floor",
    _F,
    "select run_id, max(frame_tick) as frame_tick from frames where frame_tick <= 42 group by run_id",
)
_add(
    "frame_asof",
    _F,
    """select t.run_id, t.tick as at_tick, f.frame_tick,
      case when f.frame_tick is not null then concat(t.season_id, '/runs/', t.run_id, '/frames/',
        format('{:06d}.jpg', f.frame_tick)) end as path
    from telemetry t asof left join frames f on t.run_id = f.run_id and t.tick >= f.frame_tick""",
)
_add(
    "frame_names",
    _F,
    "select run_id, frame_tick, format('{:06d}.jpg', frame_tick) as name from frames",
)

_L = [TELEMETRY, LOG]
_add(
    "quarantine",
    _L,
    """select log_offset, kind, reason, ts as log_ts, season_id as key, true as whole from bad
    union all select l.log_offset, l.kind, 'unknown:run_id', l.ts, l.season_id, true from log l
      left join starts s on l.run_id = s.run_id
      where l.kind = 'telemetry' and (s.start_offset is null or l.log_offset < s.start_offset)""",
)
_RUN_STATE = """s.run_id, s.season_id, s.driver, coalesce(d.status, 'running') as status,
      s.started_at, d.ended_at"""
_add(
    "replay_runs",
    _L,
    f"select {_RUN_STATE} from starts s left join ends d on s.run_id = d.run_id",
)
_KEPT = "run_id, tick, ts, speed, cte, hit, lap_count, terminated"
_add("replay_telemetry", _L, f"select {_KEPT} from kept")
_R = [*_L, _report("closed", "report")]
_SUMMARY = f"""select d.run_id, {_zeros('r')}
    from ends d left join report r on d.run_id = r.run_id"""
_add("replay_summary", _R, _SUMMARY)
_add(
    "kpi_cards",
    [*_R, f"summary as ({_SUMMARY})"],
    """select s.run_id,
      coalesce(regexp_replace(format('{:.1f}', m.pct_in_lane), '[.]0$', '') || '%', '—')
        as pct_in_lane,
      coalesce(regexp_replace(regexp_replace(format('{:.3f}', m.avg_speed), '0+$', ''),
        '[.]$', ''), '—') as avg_speed,
      coalesce(cast(m.collisions as varchar), '—') as collisions,
      coalesce(cast(m.laps as varchar), '—') as laps
    from starts s left join summary m on s.run_id = m.run_id""",
)
_MEMORY = """
m as (
  select *, coalesce(lag(cte) over w, cte) as pc, {steer} as st,
    lag({steer}, 1, cast(0 as double)) over w as ps,
    case when hit <> 'none' then cast(1 as double) else cast(0 as double) end as crash
  from telemetry window w as (partition by run_id order by tick))"""
_RAW = _MEMORY.format(steer="steering")
_CLIPPED = _MEMORY.format(steer="greatest(cast(-1 as double), least(cast(1 as double), steering))")
_REWARD = """{p}speed - cast(0.5 as double) * {p}cte * {p}cte - cast(5 as double) * {p}crash
      - cast(0.01 as double) * (({p}st - {p}ps) * ({p}st - {p}ps))"""


def _state(prefix: str, p: str = "") -> str:
    return (
        f"cast({p}cte as real) as {prefix}_cte, cast({p}cte - {p}pc as real) as {prefix}_cte_rate, "
        f"cast({p}speed as real) as {prefix}_speed, cast({p}gyro_z as real) as {prefix}_yaw_rate, "
        f"cast({p}ps as real) as {prefix}_prev_steering"
    )


_add("state_vector", [TELEMETRY, _RAW], f"select run_id, tick, {_state('s')} from m")
_add(
    "shaped_reward",
    [TELEMETRY, _RAW],
    f"select run_id, tick, {_REWARD.format(p='')} as reward from m",
)
_add(
    "action",
    [TELEMETRY, _CLIPPED],
    "select run_id, tick, cast(st as real) as steering, cast(0.3 as real) as throttle from m",
)
_add(
    "transitions",
    [TELEMETRY, _CLIPPED],
    f"""select a.run_id, a.tick, {_state('s', 'a.')}, cast(b.st as real) as a_steering,
      cast(0.3 as real) as a_throttle, {_REWARD.format(p='b.')} as reward, {_state('n', 'b.')},
      b.terminated as done
    from m a join m b on a.run_id = b.run_id and b.tick = a.tick + 1""",
)

PACKETS = """
packets as (
  select cast(o_orderkey // 1000 as varchar) as log_id, o_orderkey as pkt_id,
    case when o_orderkey % 1000 = 0 then '***identified***'
      when o_orderkey % 1000 = 930 and o_orderkey // 1000 % 6 = 1 then '***shutdown***'
      when o_orderkey % 1000 = 930 and o_orderkey // 1000 % 6 = 4 then '***restart***'
      else concat(
        '(angle 0.', lpad(cast(o_custkey % 100 as varchar), 2, '0'),
        ')(trackPos ', case when o_orderkey % 2 = 0 then '-' else '' end, '0.',
        lpad(cast(o_orderkey % 100 as varchar), 2, '0'),
        ')(speedX ', cast(o_orderkey % 300 as varchar),
        ')(track ', cast(o_custkey % 200 as varchar), ' ', cast(o_orderkey % 200 as varchar), ' 7)',
        case when o_orderkey % 9 = 4
          then concat('(angle 0.', lpad(cast(o_orderkey % 90 as varchar), 2, '0'), ')')
          else '' end,
        '(gear 1)') end as msg
  from orders),
parsed as (
  select log_id, pkt_id,
    cast(regexp_extract(msg, '.*[(]angle ([^)]*)[)]', 1) as double) as angle,
    cast(regexp_extract(msg, '[(]trackPos ([^)]*)[)]', 1) as double) as trackpos,
    cast(regexp_extract(msg, '[(]speedX ([^)]*)[)]', 1) as double) as speedx,
    cast(regexp_extract(msg, '[(]track ([0-9]+) ', 1) as double) as track_0,
    cast(regexp_extract(msg, '[(]track [0-9]+ ([0-9]+) ', 1) as double) as track_1,
    cast(regexp_extract(msg, '[(]track [0-9]+ [0-9]+ ([0-9]+)', 1) as double) as track_2,
    cast(regexp_extract(msg, '[(]gear ([^)]*)[)]', 1) as double) as gear
  from packets p
  where msg <> '***identified***' and not exists (
    select 1 from packets q where q.log_id = p.log_id and q.msg in ('***shutdown***', '***restart***')
      and q.pkt_id <= p.pkt_id)),
driven as (
  select *, case when speedx < 60 then cast(0.6 as double) else cast(0 as double) end as act_accel,
    cast(0 as double) as act_brake,
    cast(greatest(1, least(6, 1 + floor(speedx / 45))) as int) as act_gear,
    greatest(cast(-1 as double), least(cast(1 as double),
      (angle - trackpos * cast(0.5 as double)) / cast(0.785398 as double))) as act_steer
  from parsed)"""
_add("packet_parse", [PACKETS], "select * from parsed")
_add(
    "packet_controls",
    [PACKETS],
    "select log_id, pkt_id, act_accel, act_brake, act_gear, act_steer from driven",
)
_add("csv_packet_export", [PACKETS], "select * from driven")

_add(
    "record_defaults",
    [],
    """select event_id, cast(event_id % 1000 as int) as tick, cast(event_id as double) as ts,
      cast(event_id % 3 - 1 as double) as steering, cast(0.3 as double) as throttle,
      value as reward, event_type = 'error' as terminated,
      case when event_id % 4 = 0 then cast(event_id % 30 as double) else 0.0 end as speed,
      cast(0 as double) as forward_vel,
      case when event_id % 4 = 1 then cast(-1.25 as double) else 0.0 end as cte,
      case when event_id % 4 = 3 then 'pole' else 'none' end as hit,
      cast(case when event_id % 4 = 0 then event_id % 3 else 0 end as int) as lap_count,
      cast(0 as double) as last_lap_time,
      case when event_id % 4 = 0 then cast(event_id % 7 as double) else 0.0 end as pos_x,
      case when event_id % 4 = 0 then cast(0.5 as double) else 0.0 end as pos_y,
      cast(0 as double) as pos_z,
      cast(0 as double) as vel_x, cast(0 as double) as vel_y, cast(0 as double) as vel_z,
      cast(0 as double) as accel_x, cast(0 as double) as accel_y, cast(0 as double) as accel_z,
      case when event_id % 4 = 0 then cast(1 as double) else 0.0 end as gyro_x,
      case when event_id % 4 = 0 then cast(2 as double) else 0.0 end as gyro_y,
      case when event_id % 4 = 0 then cast(event_id % 100 as double) else 0.0 end as gyro_z,
      0 as n_bad from events""",
)
_add(
    "vector_component",
    [],
    """select event_id,
      case when event_id % 4 < 2 then cast(1 as double) else 0.0 end as gyro_x,
      case when event_id % 4 < 2 then cast(2 as double) else 0.0 end as gyro_y,
      case when event_id % 4 < 2 then cast(event_id % 100 as double) else 0.0 end as gyro_z
    from events""",
)
_add(
    "flatten_vectors",
    _T,
    """select run_id, tick, pos_x as pos_0, pos_y as pos_1, pos_z as pos_2,
      vel_x as vel_0, vel_y as vel_1, vel_z as vel_2, speed from telemetry""",
)
FIELDS = """
fields as (
  select event_id, unnest(case event_id % 4
    when 0 then ['gyro_0', 'gyro_1', 'gyro_2', 'speed', 'pos_0', 'pos_1', 'lap_count']
    when 1 then ['gyro', 'cte'] when 3 then ['gyro', 'hit'] else [] end) as field,
    unnest(case event_id % 4
    when 0 then ['1', '2', cast(event_id % 100 as varchar), cast(event_id % 30 as varchar),
      cast(event_id % 7 as varchar), '0.5', cast(event_id % 3 as varchar)]
    when 1 then [concat('{"x":1,"y":2,"z":', cast(event_id % 100 as varchar), '}'), '-1.25']
    when 3 then ['bad', 'pole'] else [] end) as value
  from events)"""
_add("flatten_fields", [FIELDS], "select event_id, field, value from fields")
_add(
    "flatten_wide",
    [FIELDS],
    "select event_id, "
    + ", ".join(
        f"max(value) filter (where field = '{f}') as {f}"
        for f in "cte gyro gyro_0 gyro_1 gyro_2 hit lap_count pos_0 pos_1 speed".split()
    )
    + " from fields group by event_id",
)

_add(
    "raw_zone_roundtrip",
    _T,
    """select season_id, run_id, tick, ts, speed, cte, hit, lap_count, terminated
    from telemetry""",
)
_add(
    "topic_roundtrip",
    _T,
    "select season_id as key, season_id, run_id, tick, ts, speed from telemetry",
)
_add(
    "csv_union_export",
    _T,
    """select run_id, tick, speed, cast(null as double) as pos_x, cast(null as double) as pos_y
    from telemetry
    union all select run_id, tick, null, pos_x, pos_y from telemetry""",
)

_add(
    "stream_runs",
    [*_R, f"summary as ({_SUMMARY})"],
    f"""select {_RUN_STATE}, m.duration_s, m.ticks, m.laps, m.lap_times, m.mean_abs_cte,
      m.max_abs_cte, m.pct_in_lane, m.avg_speed, m.max_speed, m.collisions, m.offtrack_events
    from starts s left join ends d on s.run_id = d.run_id
    left join summary m on s.run_id = m.run_id""",
)
_add("stream_telemetry", _L, f"select {_KEPT} from kept")
_COUNTS = """
kinds as (
  select kind, count(*) as messages from (
    select kind from log union all select kind from bad
    union all select 'unknown' from b where o % 97 = 0) group by kind)"""
_add("log_type_counts", [*_L, _COUNTS], "select kind, messages from kinds")
_add(
    "stream_counts",
    [*_L, _COUNTS],
    """select kind, messages from kinds
    union all select 'all', cast(sum(messages) as bigint) from kinds""",
)
_add("season_by_id", [SEASONS], f"select id, track_id, driver from seasons where id = {_season_id('7')}")
_add(
    "run_by_ids",
    _S,
    f"""select id, season_id, driver, status, started_at, ended_at from runs
    where id = {_run_id('13')} and season_id = {_season_id('3')}""",
)
_add("telemetry_of_run", _T, f"select {_KEPT} from telemetry where run_id = {_run_id('13')}")
_add(
    "live_series",
    _L,
    f"""select {_POINT} from (
      select k.run_id, k.tick, k.ts, k.speed, k.cte, t.pos_x, t.pos_y, t.steering, t.throttle,
        greatest(1, cast(ceil(count(*) over (partition by k.run_id) / 10.0) as bigint)) as stride
      from kept k join telemetry t on t.run_id = k.run_id and t.tick = k.tick
      where k.run_id = {_run_id('13')})
    where tick % stride = 0""",
)
