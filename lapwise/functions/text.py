"""Text rules of reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lapwise.functions.binding import let

TRUNCATION_NOTICE = "... earlier output truncated\n"


def pad_start(value: Column, width: int) -> Column:
    """Left-pad with blanks; longer text is kept whole."""
    missing = F.greatest(F.lit(0), F.lit(width) - F.length(value))
    return F.concat(F.repeat(F.lit(" "), missing), value)


def format_duration(milliseconds: Column) -> Column:
    """``42s``, ``2m 5s`` or ``1h 0m 3s``; negative durations show as ``0s``."""
    seconds = F.greatest(F.lit(0), F.floor(milliseconds / 1000 + F.lit(0.5))).cast("bigint")
    text = lambda number, unit: F.concat(number.cast("string"), F.lit(unit))
    minutes = lambda s: F.floor(s / 60)
    return let(
        seconds,
        lambda s: F.when(s < 60, text(s, "s"))
        .when(s < 3600, F.concat(text(minutes(s), "m "), text(s % 60, "s")))
        .otherwise(F.concat(text(F.floor(s / 3600), "h "), text(minutes(s) % 60, "m "), text(s % 60, "s"))),
    )


def html_escape(value: Column) -> Column:
    """Escape markup; the ampersand goes first so that nothing is escaped twice."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def units(value: Column) -> Column:
    """Size of a text in UTF-16 units, as the receivers of messages count it."""
    return F.floor(F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def tail_units(value: Column, limit: Column) -> Column:
    """The last ``limit`` UTF-16 units of a text; half of a character that is cut reads as a replacement character."""

    def cut(data: Column) -> Column:
        tail = F.substring(data, F.greatest(F.lit(1), F.octet_length(data) + 1 - 2 * limit), 2 * limit)
        text = lambda kept: F.decode(kept, "UTF-16BE")
        half = lambda t: F.hex(F.substring(t, F.lit(1), F.lit(1))).between("DC", "DF")
        return let(
            tail,
            lambda t: F.when(half(t), F.concat(F.lit("\ufffd"), text(F.substring(t, F.lit(3), 2 * limit)))).otherwise(text(t)),
        )

    # Without characters of two units the last characters are the last units.
    plain = units(value) == F.length(value)
    return F.when(limit <= 0, "").when(plain, F.right(value, limit)).otherwise(let(F.encode(value, "UTF-16BE"), cut))


def sized(value: Column, most: int) -> Column:
    """A text as far as a message of ``most`` units can show it, with its whole size."""
    return F.struct(tail_units(value, F.lit(most)).alias("tail"), units(value).alias("units"))


def truncate_sized(text: Column, limit: Column) -> Column:
    """Keep the end of a sized text within ``limit`` units, after a notice."""
    notice = len(TRUNCATION_NOTICE)
    return (
        F.when(text["units"] <= limit, text["tail"])
        .when(limit <= notice, F.left(F.lit(TRUNCATION_NOTICE), F.greatest(F.lit(0), limit)))
        .otherwise(F.concat(F.lit(TRUNCATION_NOTICE), tail_units(text["tail"], limit - notice)))
    )


def truncate_tail(value: Column, limit: Column) -> Column:
    """Keep the end of a text within ``limit`` units, after a notice."""
    return let(F.struct(value.alias("tail"), units(value).alias("units")), lambda text: truncate_sized(text, limit))


def utf8_tail(value: Column, limit: int) -> Column:
    """The last ``limit`` bytes of a text, not starting inside a character."""
    data = F.encode(value, "UTF-8")
    length = F.octet_length(value)
    start = length - limit
    # A character has at most three continuation bytes (10xxxxxx).
    byte = lambda offset: F.conv(F.hex(F.substring(data, start + 1 + offset, F.lit(1))), 16, 10).cast("int")
    inside = lambda offset: F.coalesce(byte(offset).bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))
    skip = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    tail = F.substring(data, start + 1 + skip, F.lit(limit))
    return F.when(length <= limit, value).otherwise(F.decode(tail, "UTF-8"))


def first_characters(value: Column, count: int) -> Column:
    return F.left(value, F.lit(count))
