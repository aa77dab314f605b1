"""Scalar functions as Column expressions; none is a user-defined function. Nulls give null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BINARY_EXTENSIONS, IGNORED_EXTENSIONS, IGNORED_NEEDLES, THRESHOLD_KB, TITLES, UNKNOWN_TITLE

#: White space of JavaScript's \s and trim(), which results follow; Java's \s is ASCII's.
SPACE = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: What a name may hold.
NAME_CHARS = rf"\w{SPACE}À-ɏ"


def half_up(x: Column) -> Column:
    """To the nearest integer, halves upward."""
    return F.floor(x + 0.5)


def file_percentage(part: Column, whole: Column) -> Column:
    """A whole percentage; 0 where there is nothing to share."""
    return F.when(whole > 0, half_up(part / F.when(whole > 0, whole) * 100)).otherwise(0).cast("long")


def author_percentage(part: Column, whole: Column) -> Column:
    """A percentage with two decimals; 0 where there is nothing to share."""
    return F.when(whole > 0, half_up(part / F.when(whole > 0, whole) * 100 * 100) / 100).otherwise(0.0)


def threshold_bytes(kb: Column, default_kb: float = THRESHOLD_KB) -> Column:
    """Null: the default."""
    return F.coalesce(kb.cast("double"), F.lit(float(default_kb))) * 1024


def bar(percent: Column, width: int = 15) -> Column:
    """A bar of filled and empty blocks; what is no number is 0, what is beyond 0 to 100 is cut."""
    width = width if width > 0 else 15
    p = F.when(F.isnan(percent) | percent.isNull() | (F.abs(percent) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)))
    filled = half_up(p / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def segment_width(percent: Column, width: int = 60) -> Column:
    """Of a pie laid out as a line; one column at least."""
    return F.greatest(F.lit(1), half_up(percent / 100 * width)).cast("long")


def progress(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), half_up(value / F.when(total > 0, total) * 100))).otherwise(0).cast("long")


def iso_time(epoch_seconds: Column) -> Column:
    """UTC with milliseconds; the session's time zone has no part in it."""
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(epoch_seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.lit(".000Z"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_name(path: Column) -> Column:
    """The last part of a path; the path itself where that is empty."""
    return F.when(basename(path) == "", path).otherwise(basename(path))


def extension(path: Column) -> Column:
    """From the last dot on, lower-cased; null for none, and for a name that only begins with its dot."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)), F.lit(""))


def is_binary(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*BINARY_EXTENSIONS), F.lit(False))


def is_ignored(path: Column) -> Column:
    """By extension, or by what the path contains."""
    return F.coalesce(extension(path).isin(*IGNORED_EXTENSIONS), F.lit(False)) | path.rlike(any_needle(IGNORED_NEEDLES))


def any_needle(needles: Iterable[str]) -> str:
    """A pattern that finds any of them, with common beginnings factored out so that each character is looked at once."""
    tree: dict = {}
    for needle in needles:
        at = tree
        for c in needle:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        if "" in at:
            return ""
        some = [(re.escape(c), pattern(below)) for c, below in at.items()]
        last = [c for c, below in some if not below]
        out = [c + below for c, below in some if below]
        if last:
            out.append(last[0] if len(last) == 1 else f"[{''.join(last)}]")
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    return pattern(tree)


def is_blank(line: Column) -> Column:
    """Nothing but white space, Unicode's included, and byte order marks."""
    return line.rlike(rf"^[{SPACE}]*\z")


#: The characters of SPACE.
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(s: Column) -> Column:
    """Without SPACE at both ends; only the ends are looked at, however long the text."""
    return F.btrim(s, F.lit(BLANKS))


def display_name(name: Column) -> Column:
    """One comma: what follows it comes first; runs of white space are one blank."""
    parts = F.split(trimmed(name), ",")
    turned = F.when(F.size(parts) == 2, F.concat_ws(" ", trimmed(F.get(parts, 1)), trimmed(F.get(parts, 0)))).otherwise(trimmed(name))
    return trimmed(F.regexp_replace(turned, f"[{SPACE}]+", " "))


def clean_email(email: Column) -> Column:
    return F.regexp_replace(trimmed(email), "[<>]", "")


def clean_name(name: Column) -> Column:
    """What names are compared by: letters, digits, underscores and single blanks, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, f"[^{NAME_CHARS}]", ""), f"[{SPACE}]+", " ")))


def compare_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[._0-9-]", "")


def has_artifacts(name: Column) -> Column:
    """Looks like an encoding: letters, digits and + / = alone, or any character that names do not hold."""
    solid = F.regexp_replace(name, f"[{SPACE}]", "")
    return solid.rlike(r"^[A-Za-z0-9+/=]+\z") | name.rlike(f"[^{NAME_CHARS}.-]")


def email_part(email: Column, at: int) -> Column:
    """Lower-cased, before (0) or after (1) the @; empty where there is none."""
    return F.coalesce(F.get(F.split(F.lower(email), "@"), at), F.lit(""))


def split_file_name(name: Column) -> Column:
    """struct(base, ext without its dot) for display: hidden files are cut at their second dot, others at the last."""
    hidden = name.startswith(".")
    base = F.when(hidden, F.regexp_extract(name, r"^(\.[^.]*)", 1)).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))
    base = F.when(base == "", name).otherwise(base)
    return F.struct(base.alias("base"), F.substr(name, F.length(base) + 2).alias("ext"))


def padded(s: Column, width: int) -> Column:
    """Blanks on the right up to width; longer strings stay whole."""
    return F.concat(s, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(s))))


def short_base(base: Column) -> Column:
    """12 characters and dots, or padded to 15."""
    return padded(F.when(F.length(base) > 12, F.concat(F.left(base, F.lit(12)), F.lit("..."))).otherwise(base), 15)


def short_name(name: Column, most: int = 30) -> Column:
    return F.when(F.length(name) > most, F.concat(F.left(name, F.lit(most - 3)), F.lit("..."))).otherwise(name)


def capitalized(s: Column) -> Column:
    """The first letter alone."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def medal(rank: Column) -> Column:
    return F.when(rank == 1, "👑").when(rank == 2, "🥈").when(rank == 3, "🥉").otherwise("  ")


def ratio(part: Column, whole: Column) -> Column:
    return F.concat(F.lit("["), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit("]"))


def title_at(index: Column) -> Column:
    titles = F.array(*map(F.lit, TITLES))
    return F.when((index >= 0) & (index < len(TITLES)), F.get(titles, index.cast("int"))).otherwise(UNKNOWN_TITLE)


def title_index(title: Column) -> Column:
    """-1 for what is no title."""
    return (F.array_position(F.array(*map(F.lit, TITLES)), F.lower(title)) - 1).cast("long")


def title_range(start: int, stop: int) -> Column:
    """Both ends included."""
    return F.slice(F.array(*map(F.lit, TITLES)), start + 1, stop - start + 1)


def distributed_index(place: Column, n: Column) -> Column:
    """The title of the developer in that place (0 first) of n: a fifth on each outer tier, one at least."""
    outer = F.greatest(F.lit(1), F.floor(n / 5)).cast("long")
    high, middle = place < outer, place < n - outer
    spread = F.when(high, place).when(middle, 12 + place - outer).otherwise(38 + place - (n - outer))
    few = F.when(n == 2, 49 * place).when(n == 3, F.get(F.array(F.lit(0), F.lit(12), F.lit(38)), F.least(place, F.lit(2)).cast("int")))
    return F.when(n == 1, 0).when(n < 4, few).otherwise(spread).cast("long")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
