"""Names, identifiers and times in the text of catalogs and files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeframe.functions.numeric import Num, col

#: Forms of event identifiers, in the order in which they are tried.
EVENT_ID_FORMS = {
    "specfem_datetime": r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})[A-Za-z]$",
    "gcmt_c_full": r"^C(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})[A-Za-z]$",
    "gcmt_b_full": r"^B(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})[A-Za-z]$",
    "gcmt_c_short": r"^C(\d{2})(\d{2})(\d{2})[A-Za-z]$",
    "gcmt_b_short": r"^B(\d{2})(\d{2})(\d{2})[A-Za-z]$",
}


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def classify_event_id(event_id: Num) -> Column:
    """Form of an event identifier, or unknown."""
    out = F.lit("unknown")
    for name, pattern in reversed(EVENT_ID_FORMS.items()):
        out = F.when(F.trim(col(event_id)).rlike(pattern), name).otherwise(out)
    return out


def event_id_year(event_id: Num) -> Column:
    """Year of an identifier with a full date, if it is between 1970 and 2035."""
    year = _number(F.trim(col(event_id)), r"^[BC]?(\d{4})\d{8}[A-Za-z]$", 1)
    return F.when(year.between(1970, 2035), year)


def event_id_time(event_id: Num) -> list[Column]:
    """year, month, day, hour, minute of an identifier that begins with a letter and a full date."""
    pattern = r"^[A-Z](\d{4})(\d{2})(\d{2})(\d{2})(\d{2})"
    return [_number(col(event_id), pattern, k).alias(n) for k, n in enumerate(("year", "month", "day", "hour", "minute"), 1)]


def event_directory(t: Num) -> Column:
    """Directory name of an event's origin time."""
    return F.date_format(col(t), "yyyyMMdd.HH.mm")


def strip_year(name: Num) -> Column:
    """A model's name without its leading year."""
    return F.regexp_replace(col(name), r"^\d{4}_", "")


def strip_net_suffix(network: Num) -> Column:
    """A network's code without a numbered suffix."""
    return F.regexp_replace(col(network), r"_\d+$", "")


def station_id(network: Num, station: Num) -> Column:
    return F.concat_ws(".", col(network), col(station))


def provider_of(network: Num, national: list[str], international: list[str], dense: str = "N", known: Num | None = None) -> Column:
    """Source family of a station: what a catalog says, else by its network."""
    net = F.upper(col(network))
    by_net = F.when(net.isin(national), "CNSN").when(net == dense, "Hinet").when(net.isin(international), "IRIS").otherwise("Other")
    if known is None:
        return by_net
    k = F.upper(col(known))
    return F.when(k.contains("CNSN"), "CNSN").when(k.contains("HINET"), "Hinet").when(k.contains("IRIS"), "IRIS").otherwise(by_net)


def waveform_key(path: Num) -> Column:
    """NET.STA from a waveform's file name, in either dialect (fields parted by ``__`` or by dots)."""
    name = F.regexp_extract(col(path), r"([^/]+)$", 1)
    parts = F.split(F.when(name.contains("__"), F.regexp_replace(name, "__.*$", "")).otherwise(name), r"\.")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def waveform_fields(name: Num, station_first: bool = False) -> list[Column]:
    """network, station, location, channel of NET.STA.LOC.CHA (or STA.NET.CHA) file names."""
    parts = F.split(col(name), r"\.")
    at = lambda k: F.get(parts, F.lit(k))
    if station_first:
        return [at(1).alias("network"), at(0).alias("station"), F.lit("").alias("location"), at(2).alias("channel")]
    return [at(0).alias("network"), at(1).alias("station"), at(2).alias("location"), at(3).alias("channel")]


def module_prefix(path: Num, default: str = "0_0") -> Column:
    """Leading stage number of a file's name, such as 5_2."""
    found = F.regexp_extract(col(path), r"([0-9]+_[0-9]+)[^/]*$", 1)
    return F.when(found != "", found).otherwise(default)


def short_label(label: Num, most: int = 24) -> Column:
    """A label without its parenthesis, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(col(label), r"\s*[\(\[].*$", "")), 1, most)


def origin_time(date: Num, time: Num) -> Column:
    """Timestamp of date (y/m/d) and time (h:m:s) as text. Seconds of 60 are read as 59; without a readable time the date counts; else null."""
    d = F.regexp_replace(col(date), "/", "-")
    t = F.regexp_replace(col(time), r":60(\.\d*)?$", ":59")
    whole = F.try_to_timestamp(F.concat_ws(" ", d, t))
    return F.coalesce(whole, F.try_to_timestamp(d))


def sort_time(date: Num, time: Num) -> Column:
    """``origin_time`` with what cannot be read at the epoch."""
    return F.coalesce(origin_time(date, time), F.lit("1970-01-01 00:00:00").cast("timestamp"))


def scientific(x: Num, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}e", col(x).cast("double"))


def resolve_name(short: str, names: list[str]) -> str:
    """The one name that begins with ``short`` (or that it begins with), after leading years; raises KeyError if there is none or more."""
    import re

    strip = lambda x: re.sub(r"^\d{4}_", "", x)
    if short in names:
        return short
    found = [n for n in names if strip(n).startswith(strip(short)) or strip(short).startswith(strip(n))]
    if len(found) != 1:
        raise KeyError(f"{short}: {len(found)} models match")
    return found[0]
