"""Scalar column functions: durations, positions, names, times, bases."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# The formats a duration may have, and the codes of an outcome.
DURATION = r"^[+-]*((?:\d+:)?(?:\d+:)?\d+\.\d{1,3})$"
RETIRED, WITHDRAWN, FAILED = "R", "W", "F"
NULL_TOKEN = r"\N"


def duration_ms(text: Column) -> Column:
    """`SS.mmm`, `M:SS.mmm` or `H:MM:SS.mmm`, signed, to milliseconds; null otherwise.

    The text is matched and split once and the seconds read as a decimal, so a short fraction
    counts as tenths or hundredths. What does not match leaves no seconds; nothing stands behind a
    condition, so that the parts are shared."""
    parts = F.split(F.regexp_extract(F.trim(text), DURATION, 1), ":")
    seconds = F.element_at(parts, -1).try_cast("decimal(20,3)") * 1000
    minutes = F.coalesce(F.try_element_at(parts, F.lit(-2)).try_cast("bigint"), F.lit(0)) * 60_000
    hours = F.coalesce(F.try_element_at(parts, F.lit(-3)).try_cast("bigint"), F.lit(0)) * 3_600_000
    sign = F.when(F.ltrim(text).startswith("-"), -1).otherwise(1)
    return sign * (hours + minutes + seconds.cast("bigint"))


def is_gap(text: Column) -> Column:
    """True when a time is a `+gap` behind someone rather than an absolute time."""
    return F.coalesce(F.trim(text).startswith("+"), F.lit(False))


def number(text: Column) -> Column:
    """Lenient number: null where the text is not one."""
    return F.trim(text).try_cast("double")


def encode_position(rank: Column, text: Column) -> dict[str, Column]:
    """Dense rank plus classification text: the position is null unless classified."""
    shown = F.coalesce(text, F.lit(""))
    return {
        "position": F.when(shown.rlike(r"^\d+$"), shown.try_cast("int")),
        "position_text": shown,
        "position_order": F.nullif(F.trim(rank.cast("string")), F.lit("")).try_cast("int"),
    }


def half_away(x: Column, digits: int) -> Column:
    """A double rounded on its binary value, halves away from zero: the product with 10^digits decides, not the shortest decimal."""
    scaled = F.abs(x) * F.lit(float(10 ** digits))
    whole = F.floor(scaled)
    rounded = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).cast("double") / F.lit(float(10 ** digits))
    return F.when(scaled >= 2.0 ** 52, x).when(x < 0, -rounded).otherwise(rounded)


def best_of(*times: Column) -> Column:
    """Smallest non-null of several nullable columns."""
    return F.least(*times) if len(times) > 1 else times[0]


def is_retired(code: Column) -> Column:
    return F.coalesce(code == RETIRED, F.lit(False))


def targets(finish: Column, code: Column) -> dict[str, Column]:
    """The four binary outcomes of an entry."""
    classified = ~is_retired(code)

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    return {
        "win": flag(code == "1"),
        "podium": flag((finish <= 3) & classified),
        "top10": flag((finish <= 10) & classified),
        "dnf": flag(~classified),
    }


def _accent_table() -> tuple[str, str]:
    """Lower-case letters whose decomposition is one base letter plus marks."""
    source, target = [], []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for point in block:
            letter = chr(point).lower()
            if len(letter) != 1:
                continue
            base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            if len(base) == 1 and base != letter and letter not in source:
                source.append(letter)
                target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def name_key(text: Column) -> Column:
    """Accent- and case-insensitive key of a name, kept in the JVM."""
    bare = F.regexp_replace(F.lower(text), r"\p{M}+", "")
    return F.trim(F.translate(bare, _ACCENTED, _PLAIN))


def same_name(left: Column, right: Column) -> Column:
    """Equality that ignores case and accents, by collation rather than by key."""
    return F.collate(F.trim(left), "UNICODE_CI_AI") == F.collate(F.trim(right), "UNICODE_CI_AI")


def stand_in_key(season: Column, name: Column, event: Column, session: Column, num: Column) -> Column:
    """Key of a participant without an id: by season and name, or by where they appeared."""
    key = name_key(name)
    named = key.isNotNull() & ~key.isin("", "nan", "none")
    return F.when(
        named, F.concat_ws("_", season.cast("string"), F.replace(key, F.lit(" "), F.lit("_")))
    ).otherwise(
        F.concat_ws("_", F.lit("unknown"), season.cast("string"), F.concat(F.lit("r"), event.cast("string")),
                    F.replace(name_key(session), F.lit(" "), F.lit("")), num.cast("string"))
    )


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes, safe in a URL."""
    dashed = F.regexp_replace(name_key(text), r"[^\p{L}\p{N}]+", "-")
    return F.regexp_replace(dashed, r"^-+|-+$", "")


def timestamp_at(date: Column, time: Column, default_time: str) -> Column:
    """UTC timestamp from a date and an optional time, both text."""
    clock = F.regexp_replace(F.coalesce(time, F.lit(default_time)), "Z$", "")
    return F.when(date.isNotNull(), F.concat_ws(" ", date.cast("string"), clock).try_cast("timestamp"))


def finished(start: Column, as_of: Column, hours: int = 4) -> Column:
    return start + F.expr(f"INTERVAL {hours} HOURS") <= as_of


def provisional(start: Column, as_of: Column, days: int = 30) -> Column:
    return (start <= as_of) & (start > as_of - F.expr(f"INTERVAL {days} DAYS"))


def stop_class(count: Column) -> Column:
    """Zero or one, two, three or more."""
    return F.when(count <= 1, 0).when(count == 2, 1).otherwise(2)


# Knots of the position basis, and the range a position is held to.
KNOTS = (1, 2, 3, 5, 8, 12, 20)


def spline_basis(position: Column, prefix: str = "q") -> dict[str, Column]:
    """Log and cubed hinges of a position; an unknown position counts as the last knot."""
    held = F.least(F.greatest(F.coalesce(position.cast("double"), F.lit(20.0)), F.lit(1.0)), F.lit(22.0))
    basis = {f"{prefix}_log": F.log(held)}
    for i, knot in enumerate(KNOTS[:-1]):
        basis[f"{prefix}_h{i}"] = F.pow(F.greatest(held - knot, F.lit(0.0)), F.lit(3.0))
    return basis


def one_hot_basis(position: Column, size: int = 20, prefix: str = "q") -> dict[str, Column]:
    held = F.least(F.greatest(F.coalesce(position.cast("int"), F.lit(0)), F.lit(0)), F.lit(size))
    return {f"{prefix}_{k}": (held == k).cast("double") for k in range(1, size + 1)}
