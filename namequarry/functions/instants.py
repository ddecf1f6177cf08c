"""Times in many notations as one instant in UTC."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NORMAL_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_ZONE = r"\[?([Zz]|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?\]?\s*\[?([A-Za-z]+(?:/[A-Za-z0-9_+\-]+){1,3})?\]?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(?:([AaPp][Mm])(?![A-Za-z]))?\s*" + _ZONE
#: Each notation, rewritten as: kind | year | month | day (numeric dates: first part | second part) | hour | minute | second | fraction | half of day | offset | zone.
_NOTATIONS = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})[T\s]\s*" + _CLOCK + "$", "Y|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + _ZONE + "$", "Y|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}),?[T\s]\s*" + _CLOCK + "$", "D|$4|$1|$3|$5|$6|$7|$8|$9|$10|$11"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?,?\s+(\d{4}),?\s+" + _CLOCK + "$", "N|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
)


def _zones() -> list[str]:
    names = {z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix", "right", "System"))}
    return sorted(names | {"UTC", "GMT"})


def epoch_text_ms(text: Column) -> Column:
    """Unix time written in digits, its unit told by their number: 9-11 s, 12-14 ms, 15-17 us, 18-19 ns; else null.

    The text must match ``^\\d{9,19}(\\.\\d+)?$``; a fraction is read for seconds only, elsewhere it is below a millisecond.
    """
    whole = F.substring_index(text, ".", 1)
    size = F.length(whole)
    part = F.when(text.contains("."), F.rpad(F.substring(F.substring_index(text, ".", -1), 1, 3), 3, "0")).otherwise("000")
    ms = F.when(size <= 11, F.concat(whole, part)).when(size <= 14, whole).when(size <= 17, F.left(whole, size - 3)).otherwise(F.left(whole, size - 6))
    return F.when(text.rlike(r"^\d{9,19}(\.\d+)?$"), ms.try_cast("bigint"))


def with_instant(df: DataFrame, raw: str, out: str, zone: str | None = None, order: str | None = None) -> DataFrame:
    """Add ``out``: the epoch milliseconds that the text in ``raw`` denotes, or null.

    zone and order name columns with the feed's own zone id and its order of numeric dates (DMY, MDY, YMD), both
    used only where the text doesn't say. Null results: null or blank text, text that is no time, dates without a
    time of day, dates that don't exist, local times that the zone's clock showed twice or never, zone-less times
    without a known zone, numeric dates without a known order, unknown zone names. A missing seconds field is
    zero; fractions below a millisecond are cut off. Text may have any length, blanks around it don't count. Everything runs in the JVM.
    """
    p = f"__{out}_"
    # no end is looked for within a run of blanks, and runs become one: else a long run takes time beyond its length
    trimmed = F.regexp_replace(F.col(raw), r"^[\s ]+|(?<![\s ])[\s ]+$", "")
    text = F.when(~F.contains(F.col(raw), F.lit("|")), F.regexp_replace(trimmed, r"\s{2,}", " "))
    for pattern, layout in _NOTATIONS:
        text = F.regexp_replace(text, pattern, layout)
    df = df.withColumn(p + "p", F.split(text, r"\|", -1))
    a = [F.get(F.col(p + "p"), F.lit(i)) for i in range(11)]
    kind, month_at, day_at, half, offset, zone_at = a[0], a[2], a[3], F.lower(a[8]), F.nullif(F.upper(a[9]), F.lit("")), a[10]
    day_order = F.col(order) if order else F.lit(None).cast("string")
    own = F.col(zone) if zone else F.lit(None).cast("string")
    # of numeric dates, MDY puts the month first and DMY the day; without such an order they stay undecided
    swap = (kind == "D") & (day_order == "DMY")
    place = F.instr(F.lit(MONTHS), F.lower(month_at))
    month = F.when(kind == "N", F.when((place > 0) & (place % 4 == 1), F.floor(place / 4) + 1).cast("string")).when(swap, day_at).otherwise(month_at)
    day = F.when(swap, month_at).otherwise(day_at)
    hour = a[4].try_cast("int")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    wall = F.concat(a[1], F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour.cast("string"), F.lit(":"), a[5], F.lit(":"), F.when(a[6] == "", "0").otherwise(a[6]), F.lit("."), F.rpad(F.substring(a[7], 1, 3), 3, "0"))
    known = (F.size(F.col(p + "p")) == 11) & ((kind != "D") | F.coalesce(day_order.isin("DMY", "MDY"), F.lit(False)))
    named = F.when(zone_at == "", own).otherwise(zone_at)
    # plain columns, each used more than once: the optimizer keeps them apart, where it would inline the fields of a struct
    df = df.withColumns({
        p + "e": F.when(F.size(F.col(p + "p")) == 1, epoch_text_ms(a[0])),
        p + "l": F.when(known, F.unix_millis(F.concat(wall, F.coalesce(offset, F.lit("Z"))).try_cast("timestamp"))),
        p + "z": F.when(offset.isNull(), F.coalesce(F.when(named.isin(*_zones()), named), F.lit(""))),
    })
    local, z = F.col(p + "l"), F.col(p + "z")

    def shown(utc_ms: Column) -> Column:
        return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(utc_ms), z))

    # the offsets a day before and a day after are the only ones that can hold at this local time
    before, after = local - DAY_MS, local + DAY_MS
    in_zone = (z != "") & local.isNotNull()
    df = df.withColumns({p + "a": F.when(in_zone, local - (shown(before) - before)), p + "b": F.when(in_zone, local - (shown(after) - after))})
    first, second = F.col(p + "a"), F.col(p + "b")
    df = df.withColumns({p + "x": F.when(in_zone, shown(first) == local), p + "y": F.when(in_zone & (first != second), shown(second) == local)})
    ok1, ok2 = F.col(p + "x"), F.coalesce(F.col(p + "y"), F.lit(False))
    once = F.when(ok1 & ~ok2, first).when(ok2 & ~ok1, second)
    # the row number, never negative, keeps filters on the result above this projection: pushed below, they would repeat the whole parse many times
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn(out, F.when(F.col(p + "e").isNotNull(), F.col(p + "e")).when(here & z.isNull(), local).when(in_zone, once))
    return df.drop(*(p + x for x in "pelzabxy"))


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as ``yyyy-MM-ddTHH:mm:ss.SSSZ``, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))
    rest = F.pmod(ms, F.lit(DAY_MS))
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02d.%03dZ", F.floor(rest / 3_600_000).cast("int"), (F.floor(rest / 60_000) % 60).cast("int"), (F.floor(rest / 1000) % 60).cast("int"), (rest % 1000).cast("int")))


def utc_day(ms: Column) -> Column:
    """The UTC day of epoch milliseconds, as days since 1970."""
    return F.floor(ms / DAY_MS).cast("int")
