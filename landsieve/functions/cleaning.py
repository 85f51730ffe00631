"""Text and number cleaning rules as Columns, and column-name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landsieve import constants as K


def pick_column(present: Sequence[str], candidates: Sequence[str], what: str, required: bool = True) -> str | None:
    """First candidate that exists, ignoring case; the real casing is returned."""
    by_lower = {name.lower(): name for name in reversed(list(present))}
    for wanted in candidates:
        if wanted.lower() in by_lower:
            return by_lower[wanted.lower()]
    if required:
        raise ValueError(f"no column for {what}: wanted one of {list(candidates)}, source has {list(present)}")
    return None


def text_or_null(name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")


def pick_text(df: DataFrame, field: str, required: bool = False, forced: str | None = None) -> Column:
    """Text column for a known field; a forced name replaces the candidate list."""
    names = [forced] if forced else K.FIELDS[field]
    return text_or_null(pick_column(df.columns, names, field, required or bool(forced)))


def apn_norm(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def zone_code_norm(c: Column) -> Column:
    """Base district: leading token, upper case, no trailing stars, else OTHER."""
    token = F.upper(F.regexp_extract(F.trim(c), "^[^( ]+", 0))
    return F.coalesce(F.nullif(F.rtrim(token, F.lit("*")), F.lit("")), F.lit("OTHER"))


def station_name_norm(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " ")
    s = F.regexp_replace(s, "[0-9]+", " ")
    s = F.regexp_replace(s, r"\b(" + "|".join(K.STATION_NOISE_WORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def num_try(c: Column) -> Column:
    return c.try_cast("double")


def num_clean(c: Column) -> Column:
    """Number from text with stray characters such as commas or units."""
    return F.nullif(F.regexp_replace(c.cast("string"), "[^0-9.-]", ""), F.lit("")).try_cast("double")


def voltage_known(v: Column) -> Column:
    """NULL for unknown markers and for anything not above zero."""
    return F.when(v.isNotNull() & ~v.isin(K.VOLTAGE_UNKNOWN) & (v > 0), v)


def acres(sqm: Column) -> Column:
    return sqm / F.lit(K.SQM_PER_ACRE)


def is_flood_hazard(zone: Column, flag: Column | None = None) -> Column:
    """Zone starts with A or V and is mapped; an explicit F flag overrides."""
    z = F.upper(F.trim(zone))
    hit = z.rlike("^[AV]") & (z != F.lit(K.FLOOD_NOT_MAPPED))
    if flag is not None:
        f = F.upper(F.trim(flag))
        hit = hit & (f.isNull() | (f != "F"))
    return hit


def mentions_county(c: Column, name: str = K.COUNTY_NAME) -> Column:
    """County text contains the name as a whole word."""
    return F.upper(F.trim(c)).rlike(rf"\b{name.upper()}\b")


def is_active(status: Column) -> Column:
    low = F.lower(status)
    ended = F.lit(False)
    for fragment in K.INACTIVE_STATUS:
        ended = ended | low.contains(fragment)
    return status.isNotNull() & ~F.coalesce(ended, F.lit(False))


def place_norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), F.lit(" ,."))


def csv_safe(c: Column) -> Column:
    """Spreadsheet-safe CSV cell: quoted when needed, formulas neutralised."""
    s = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike('[",\r\n]'), quoted).otherwise(s), F.lit(""))
