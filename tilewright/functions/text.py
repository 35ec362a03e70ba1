"""String, path, attribute-map and JSON expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_control(s: Column) -> Column:
    """Without leading and trailing characters below 33."""
    return F.regexp_replace(F.regexp_replace(s, r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def lowered(s: Column) -> Column:
    return F.lower(s)


def raised(s: Column) -> Column:
    return F.upper(s)


def replaced(s: Column, old: str, new: str) -> Column:
    """Every occurrence of a text, from left to right."""
    return F.replace(s, F.lit(old), F.lit(new))


def split_regex(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)


def escape_char(s: Column, char: str) -> Column:
    """A character as ``&#n;``; a text that holds that already is an error."""
    code = f"&#{ord(char)};"
    return F.when(F.contains(s, F.lit(code)), F.raise_error(F.lit(f"already escaped: {code}"))).otherwise(F.replace(s, F.lit(char), F.lit(code)))


def unescape_char(s: Column, char: str) -> Column:
    return F.replace(s, F.lit(f"&#{ord(char)};"), F.lit(char))


def join_list(values: Column, delimiter: str = ";") -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), delimiter)


def parse_list(s: Column, kind: str = "double", delimiter: str = ";") -> Column:
    return F.transform(F.split(s, re.escape(delimiter)), lambda v: v.cast(kind))


def padded_hex(i: Column, width: int = 6) -> Column:
    """0x and the hexadecimal digits; the width counts the prefix."""
    digits = F.lower(F.hex(i))
    return F.concat(F.lit("0x"), F.when(F.length(digits) < width - 2, F.lpad(digits, width - 2, "0")).otherwise(digits))


def number_text(v: Column, precision: int | None = None) -> Column:
    """A number as text, with a fixed number of digits after the point if one is given.

    Digits are rounded by the exact binary value, halves to the even digit, and not by its shortest decimal form;
    only numbers of less than 2 ** -9, 0 apart, are rounded by the latter.
    """
    if precision is None:
        return v.cast("string")
    v = v.cast("double")
    one, bits = 10**precision, 1 << 62
    size = F.abs(v)
    whole = F.floor(size)
    part = (size - whole) * float(bits)  # the fraction in units of 2 ** -62, exact
    units = F.floor(part)
    # units * 10 ** precision = digits * 2 ** 62 + rest, in long arithmetic by halves of 31 bits
    high, low = F.shiftright(units, 31), units.bitwiseAND(F.lit((1 << 31) - 1))
    top, bottom = high * one, low * one
    middle = F.shiftleft(top.bitwiseAND(F.lit((1 << 31) - 1)), 31) + bottom
    digits = F.shiftright(top, 31) + F.shiftright(middle, 62)
    rest = middle.bitwiseAND(F.lit(bits - 1))
    odd = (digits % 2 if precision else whole % 2) == 1
    up = (rest > bits // 2) | ((rest == bits // 2) & (odd | (part != units)))
    digits = digits + up.cast("int")
    text = F.concat(F.when(v < 0, "-").otherwise(""), (whole + F.floor(digits / one)).cast("string"))
    if precision:
        text = F.concat(text, F.lit("."), F.lpad((digits % one).cast("string"), precision, "0"))
    # long arithmetic holds for up to nine digits
    return F.when((size < 9e15) & ((size == 0) | (size >= 2.0**-9)) & F.lit(precision <= 9), text).otherwise(F.format_string(f"%.{precision}f", v))


def list_text(values: Column, separator: str = ";", precision: int | None = None) -> Column:
    return F.array_join(F.transform(values, lambda v: number_text(v, precision)), separator)


# ---- paths


def normalized(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(normalized(path), r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(normalized(path), r"([^/]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The extension without its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def lowest_directory(path: Column) -> Column:
    return F.regexp_extract(directory(path), r"([^/]*)$", 1)


def complete_path(folder: Column, name: Column) -> Column:
    folder = normalized(folder)
    return F.when(folder == "", name).when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def with_extension(path: Column, new: str) -> Column:
    name = F.concat(base_name(path), F.lit("." + new.lstrip(".") if new else ""))
    return complete_path(directory(path), name)


def with_base_name(path: Column, new: Column) -> Column:
    ext = extension(path)
    return complete_path(directory(path), F.concat(new, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))))


def with_directory(path: Column, new: Column) -> Column:
    return complete_path(new, file_name(path))


def matches(path: Column, glob: str) -> Column:
    """Wildcards * and ? against the file name."""
    pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return file_name(path).rlike(f"^{pattern}$")


# ---- attribute maps


def set_attribute(attributes: Column, key: str, value: Column) -> Column:
    """The map with a value, as text; lists are joined by ;."""
    kept = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(kept, F.create_map(F.lit(key), value.cast("string")))


def get_attribute(attributes: Column, key: str) -> Column:
    return F.try_element_at(attributes, F.lit(key))


# ---- JSON records


def json_fields(record: Column, fields: list[str]) -> list[Column]:
    """Fields of a JSON object as text: a list becomes comma-separated, null becomes '', quotes go."""
    out = []
    for f in fields:
        raw = F.get_json_object(record, f"$.{f}")
        out.append(F.coalesce(F.when(raw.startswith("["), F.replace(F.regexp_replace(raw, r"^\[|\]$", ""), F.lit('"'), F.lit(""))).otherwise(raw), F.lit("")).alias(f))
    return out


def described_columns(document: Column) -> Column:
    """Column names from a description of an endpoint: the keys of its nested POST object."""
    return F.json_object_keys(F.get_json_object(document, "$.actions.POST"))
