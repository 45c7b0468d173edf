"""Numbers in text, by the grammar of the producers of packets and records."""

_DIGITS = r"\d+(?:_\d+)*"
_FINITE = rf"[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_SPECIAL = "(?i)[+-]?(?:inf|infinity|nan)"
_EDGES = r"(?U)^\s+|\s+$"


def double_sql(text: str) -> str:
    """SQL for the number that a text holds, null if it is none.

    Type suffixes and hexadecimal forms, which the JVM would take, are no numbers; single
    underscores between digits are allowed, and so is white space around the number.
    """
    own = f"regexp_replace({text}, r'{_EDGES}', '')"
    special = f"try_cast(if(lower({own}) like '%nan', 'NaN', replace({own}, '+', '')) as double)"
    return (
        f"case when {own} rlike r'^{_FINITE}$' then try_cast(replace({own}, '_', '') as double) "
        f"when {own} rlike r'^{_SPECIAL}$' then {special} end"
    )


def words_sql(text: str) -> str:
    """SQL for the parts of a text between white space; one empty part if there is none."""
    return f"split(regexp_replace({text}, r'{_EDGES}', ''), r'(?U)\\s+')"
