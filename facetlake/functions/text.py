"""String helpers as columns: splitting, numbers in text, path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")


def split_string(s: Column, delimiters: str) -> Column:
    """Non-empty parts between any of the delimiter characters."""
    one = "[" + "".join("\\" + c if not c.isalnum() and c not in " \t" else c for c in delimiters) + "]"
    return F.filter(F.split(s, one), lambda x: x != "")


def leading_number(s: Column) -> Column:
    """The number a text begins with, 0 where it begins with none."""
    return F.coalesce(F.regexp_extract(s, NUMBER, 1).try_cast("double"), F.lit(0.0))


def split_numbers(s: Column, delimiters: str) -> Column:
    return F.transform(split_string(s, delimiters), leading_number)


def numbers_from_string(s: Column) -> Column:
    """The numbers between white space, up to the first part that isn't one."""
    parts = F.filter(F.split(s, r"\s+"), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    first = F.array_position(F.transform(values, lambda x: x.isNull()), True)
    return F.when(first > 0, F.slice(values, F.lit(1), (first - 1).cast("int"))).otherwise(values)


def path_of(s: Column) -> Column:
    """Everything up to the last / or \\, empty without one."""
    return F.regexp_extract(s, r"^(.*)[/\\]", 1)


def without_path(s: Column) -> Column:
    return F.regexp_replace(s, r"^.*[/\\]", "")


def without_extension(s: Column) -> Column:
    return F.regexp_replace(s, r"\.[^./\\]*$", "")


def stem(s: Column) -> Column:
    return without_extension(without_path(s))


def extension(s: Column) -> Column:
    """Lower-case extension, empty without one."""
    return F.lower(F.regexp_extract(s, r"\.([^./\\]*)$", 1))


def strip_spaces(s: Column) -> Column:
    return F.regexp_replace(s, r"^[ \t]+|[ \t]+$", "")


def strip_quotes(s: Column) -> Column:
    return F.btrim(s, F.lit('"'))


def strip_newlines(s: Column) -> Column:
    return F.translate(s, "\r\n", "")


def replace_any(s: Column, characters: str, by: str) -> Column:
    """Each of the characters replaced by one character."""
    return F.translate(s, characters, by * len(characters))


def token_rest(s: Column, token: str) -> Column:
    """What follows a token that a line begins with (any case), trimmed; null where it doesn't."""
    return F.when(F.startswith(F.lower(s), F.lit(token.lower())), F.trim(F.substring(s, len(token) + 1, 2**30)))


def is_image(s: Column) -> Column:
    return extension(s).isin(*IMAGES)


def picker_name(position: Column, name: Column) -> Column:
    return F.format_string("%03d : %s", position, name)
