"""From wire messages to typed records, with reasons for what does not conform.

Nothing here fails a job on bad input: each message gets a list of reasons, and
an empty list means that it conforms.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane import schemas

# What is left of a valid id without prefixes, braces and hyphens.
_HEX = "^[0-9a-f]{32}$"
_PLAIN = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"

_CORRUPT = "_corrupt"
_NONE = "cast(array() as array<string>)"
# The keys of a message with their raw text, for telling why a field is null. Only
# looked at for messages that do not conform.
_RAW = r"from_json(regexp_replace(value, r':\s*(NaN|-?Infinity)', ':0'), 'map<string, string>')"


def canonical_id(raw: str) -> str:
    """SQL for the lower-case hyphenated form of a valid id, null for anything else.

    Ids may come with urn:uuid: before them, in braces, and with hyphens anywhere.
    """
    bare = f"replace(replace({raw}, 'urn:', ''), 'uuid:', '')"
    digits = f"replace(lower(trim(BOTH '{{}}' FROM {bare})), '-', '')"
    parts = ", ".join(
        f"substring({digits}, {start}, {size})"
        for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    )
    # Most ids have that form already; $ would let a line end pass, so the length counts too.
    other = f"if({digits} rlike '{_HEX}', concat_ws('-', {parts}), null)"
    return f"if(length({raw}) = 36 and {raw} rlike '{_PLAIN}', {raw}, {other})"


def _problems(name: str) -> list[tuple[str, str]]:
    """Conditions, in SQL, under which a field that is present does not conform."""
    if name in schemas.DOUBLE_COLUMNS:
        return [(f"isnan({name}) or abs({name}) = double('inf')", f"not_finite:{name}")]
    if name in c.MAX_LENGTH:
        return [(f"length({name}) > {c.MAX_LENGTH[name]}", f"too_long:{name}")]
    return []


def _reasons(required: list[str], defaulted: list[str], ids: list[str]) -> str:
    """SQL for the list of reasons of one kind of message; ``_<id>`` is the form of an id."""
    checks = [check for name in [*required, *defaulted] for check in _problems(name)]
    checks += [(f"{name} is not null and _{name} is null", f"bad_id:{name}") for name in ids]

    def nulls(names: list[str]) -> str:
        found = ", ".join(f"if({name} is null, '{name}', null)" for name in names)
        why = (
            f"case when not map_contains_key({_RAW}, n) then 'missing:' "
            f"when {_RAW}[n] is null then 'null:' else 'bad_type:' end"
        )
        return f"transform(array_compact(array({found})), n -> concat({why}, n))"

    failed = ", ".join(f"if({bad}, '{reason}', null)" for bad, reason in checks)
    found = [nulls([*ids, *required]), f"array_compact(array({failed}))"]
    if defaulted:
        # A default stands in for an absent key only; an explicit null is an error.
        found.append(f"filter({nulls(defaulted)}, r -> not startswith(r, 'missing:'))")
    # Most messages conform; a plain conjunction settles those.
    clean = [f"{name} is not null" for name in [*ids, *required, *defaulted]]
    clean += [f"not ({bad})" for bad, _ in checks]
    return f"if({' and '.join(clean)}, {_NONE}, concat({', '.join(found)}))"


def decode(log: DataFrame) -> DataFrame:
    """Log columns, then kind, the message fields and reasons.

    The text stays as value, for quarantine; a stored table reads it only there. kind is a message type, 'unknown' (counted and skipped) or 'malformed'.
    """
    # A generator keeps the parse in one place: filters on its fields are not pushed
    # below it, where they would parse the text again.
    message = F.from_json(
        "value", f"{schemas.MESSAGE}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT}
    )
    types = ", ".join(f"'{t}'" for t in c.MESSAGE_TYPES)
    kinds = (
        f"case when type in ({types}) then type "
        f"when value is null or ({_CORRUPT} is not null and {_RAW} is null) then '{c.MALFORMED}' "
        f"else '{c.UNKNOWN}' end as kind"
    )
    reasons = (
        f"case kind when '{c.MALFORMED}' then array('{c.MALFORMED}') "
        f"when '{c.TELEMETRY}' then {_reasons(schemas.TELEMETRY_COLUMNS, [], ['run_id'])} "
        f"when '{c.RUN_START}' then {_reasons([], ['driver'], ['run_id', 'season_id'])} "
        f"when '{c.RUN_END}' then {_reasons([], ['status'], ['run_id'])} "
        f"else {_NONE} end as reasons"
    )
    return (
        log.select("*", F.inline(F.array(message)))
        .selectExpr("*", kinds, *[f"{canonical_id(n)} as _{n}" for n in ("season_id", "run_id")])
        .selectExpr(
            *log.columns,
            "kind",
            "_season_id as season_id",
            "_run_id as run_id",
            "driver",
            "status",
            "last_tick",
            *schemas.TELEMETRY_COLUMNS,
            reasons,
        )
    )


def conforming(messages: DataFrame) -> DataFrame:
    return messages.filter(
        (F.size("reasons") == 0) & F.col("kind").isin(c.MESSAGE_TYPES)
    ).drop("reasons")


def rejected(messages: DataFrame) -> DataFrame:
    return messages.filter(F.size("reasons") > 0)


def type_counts(messages: DataFrame) -> DataFrame:
    """Messages per kind; repeats count, bad messages count under their type."""
    return messages.groupBy("kind").agg(F.count("*").alias("messages"))


def season_problems(seasons: DataFrame) -> DataFrame:
    """Season input with its list of reasons (lengths, driver, required fields)."""
    required = ["os", "sdk_version", "simulator_version", "track_id"]
    checks = [F.when(F.col(n).isNull(), F.lit(f"missing:{n}")) for n in required]
    checks += [
        F.when(F.length(n) > c.MAX_LENGTH[n], F.lit(f"too_long:{n}")) for n in required
    ]
    checks.append(F.when(~F.col("driver").isin(c.DRIVERS), F.lit("not_allowed:driver")))
    return seasons.withColumn("reasons", F.array_compact(F.array(*checks)))


def backfill_driver(seasons: DataFrame) -> DataFrame:
    """Seasons recorded before the driver column existed get the default."""
    if "driver" not in seasons.columns:
        seasons = seasons.withColumn("driver", F.lit(None).cast("string"))
    return seasons.fillna({"driver": c.DEFAULT_DRIVER})
