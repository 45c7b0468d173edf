"""Telemetry records from simulator info, given as JSON text with open fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane import constants as c
from ticklane.functions.numbers import double_sql
from ticklane.plans.once import with_computed

AXES = ["x", "y", "z"]
_VECTORS = ["pos", "vel", "accel", "gyro"]
_SCALARS = {
    "speed": "double",
    "forward_vel": "double",
    "cte": "double",
    "hit": "string",
    "lap_count": "int",
    "last_lap_time": "double",
}

#: Fields of the loop around the simulator: kind, and default where rows lack the column.
_GIVEN = {
    "tick": ("int", "0"),
    "ts": ("double", "null"),
    "steering": ("double", "0"),
    "throttle": ("double", "0"),
    "reward": ("double", "0"),
    "terminated": ("boolean", "false"),
}


def _cast(text: str, kind: str) -> str:
    """SQL for a number in JSON text form; whole numbers drop their fraction."""
    if kind == "string":
        return text
    return f"try_cast({double_sql(text)} as {kind})"


def _field_sql() -> tuple[list[str], list[str]]:
    """Value and complaint, in SQL, per record field.

    A vector gives its components; a plain field of the component's flattened name
    counts as well.
    """
    sources = {name: ([f"_f['{name}']"], kind) for name, kind in _SCALARS.items()}
    for vector in _VECTORS:
        for i, axis in enumerate(AXES):
            texts = [f"get(_v.{vector}, {i})", f"_f['{vector}_{i}']"]
            sources[f"{vector}_{axis}"] = (texts, "double")
    values, bad = [], []
    for name, (texts, kind) in sources.items():
        default = f"'{c.NO_HIT}'" if kind == "string" else f"cast(0 as {kind})"
        typed = ", ".join(_cast(t, kind) for t in texts)
        values.append(f"coalesce({typed}, {default}) as {name}")
        given = f"coalesce({', '.join(texts)}) is not null"
        if name in _SCALARS:
            given = f"map_contains_key(_f, '{name}')"
        bad.append(f"if(coalesce({typed}) is null and {given}, '{name}', null)")
    return values, bad


def build_records(rows: DataFrame, info: str = "info") -> DataFrame:
    """Add the record fields and bad_fields, the names of uncastable values.

    What the simulator does not report comes from columns of rows where they exist: tick, ts,
    steering, throttle, reward and terminated. A field that is absent gets its default, and
    ts stays null. So does one that cannot be cast, but it is also listed in bad_fields, for
    the caller to keep or set aside.
    """
    fields = F.coalesce(
        F.from_json(info, "map<string, string>"), F.create_map().cast("map<string, string>")
    )
    vectors = [f"from_json(_f['{v}'], 'array<string>') as {v}" for v in _VECTORS]
    out = with_computed(rows, "_f", fields)
    out = with_computed(out, "_v", F.struct(*map(F.expr, vectors)))
    values, bad = _field_sql()
    kept = [n for n in rows.columns if n not in _GIVEN]
    given = [f"cast({n if n in rows.columns else default} as {kind}) as {n}" for n, (kind, default) in _GIVEN.items()]
    return out.selectExpr(
        *kept, *given, *values, f"array_compact(array({', '.join(bad)})) as bad_fields"
    )


def with_variant(rows: DataFrame, info: str = "info") -> DataFrame:
    return with_computed(rows, "_info", F.try_parse_json(info))


def component(info: Column, field: str, index: int) -> Column:
    """One component of a vector field: an array, an {x, y, z} object, else 0."""
    return F.coalesce(
        F.try_variant_get(info, f"$.{field}[{index}]", "double"),
        F.try_variant_get(info, f"$.{field}.{AXES[index]}", "double"),
        F.lit(0.0),
    )


def flatten_arrays(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Array columns of known width become ``<name>_0 .. <name>_<n-1>``."""
    out = []
    for name in rows.columns:
        if name in widths:
            out += [F.get(name, F.lit(i)).alias(f"{name}_{i}") for i in range(widths[name])]
        else:
            out.append(F.col(name))
    return rows.select(*out)


def flatten_fields(rows: DataFrame, key: str, info: str = "info") -> DataFrame:
    """(key, field, value as text): open fields in long form, arrays by element."""
    fields = rows.select(
        key, F.explode(F.from_json(info, "map<string, string>")).alias("name", "text")
    )
    is_array = F.col("text").startswith("[")
    parts = F.when(is_array, F.from_json("text", "array<string>")).otherwise(F.array("text"))
    return fields.select(
        key, "name", is_array.alias("is_array"), F.posexplode(parts).alias("i", "value")
    ).select(
        key,
        F.when(F.col("is_array"), F.concat_ws("_", "name", F.col("i").cast("string")))
        .otherwise(F.col("name"))
        .alias("field"),
        "value",
    )


def field_names(long_rows: DataFrame) -> DataFrame:
    """(field, rows) of what occurs, to choose the columns of widen from."""
    return long_rows.groupBy("field").agg(F.count("*").alias("rows"))


def widen(long_rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per key, one column for each of the names; other fields are left out."""
    return long_rows.groupBy(key).pivot("field", names).agg(F.max("value"))
