"""The INFO bag: 'K=V;K2=V2;FLAG', '.' when empty. Keys are matched at the start or after a semicolon."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def info_field(info: Column, key: str) -> Column:
    """The value of the first 'key=', null when absent; flags have no value."""
    pattern = f"(?:^|;){re.escape(key)}=([^;]*)"
    return F.when(info.rlike(pattern), F.regexp_extract(info, pattern, 1))


def has_info_field(info: Column, key: str) -> Column:
    """Whether 'key=' is there."""
    return info.rlike(f"(?:^|;){re.escape(key)}=")


def delete_info_field(info: Column, key: str) -> Column:
    """info without the key and its separator; '.' when nothing is left."""
    left = F.array_join(F.filter(F.split(info, ";"), lambda kv: ~kv.startswith(f"{key}=")), ";")
    return F.coalesce(F.nullif(left, F.lit("")), F.when(info.isNotNull(), "."))


def _with_value(info: Column, value: Column, use) -> Column:
    """use(info, value), both computed once: names for them inside use, or nested rewrites would copy their input at each use."""
    bound = F.array(F.struct(info.alias("info"), value.alias("value")))
    return F.get(F.transform(bound, lambda b: use(b["info"], b["value"])), F.lit(0))


def _replaced(info: Column, key: str, value: Column) -> Column:
    return F.array_join(F.transform(F.split(info, ";"), lambda kv: F.when(kv.startswith(f"{key}="), F.concat(F.lit(f"{key}="), value)).otherwise(kv)), ";")


def replace_info_field(info: Column, key: str, value: Column) -> Column:
    """The key's value replaced in its place, if it is there; else info as it is."""
    return _with_value(info, value, lambda i, v: F.when(has_info_field(i, key), _replaced(i, key, v)).otherwise(i))


def set_info_field(info: Column, key: str, value: Column) -> Column:
    """Replaced in its place, or appended; '.' gives way."""

    def use(i: Column, v: Column) -> Column:
        new = F.concat(F.lit(f"{key}="), v)
        return F.when(i == ".", new).when(has_info_field(i, key), _replaced(i, key, v)).otherwise(F.concat_ws(";", i, new))

    return _with_value(info, value, use)


def set_in_column(info: Column, key: str, value: Column) -> Column:
    """set_info_field without lambdas, which are interpreted, where info is a column of its own and value is never null:
    both are named more than once."""
    literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    replaced = F.regexp_replace(info, F.lit(f"(^|;){re.escape(key)}=[^;]*"), F.concat(F.lit(f"$1{key}="), literal))
    new = F.concat(F.lit(f"{key}="), value)
    there = info.contains(f"{key}=") & has_info_field(info, key)
    return F.when(info == ".", new).when(there, replaced).otherwise(F.concat_ws(";", info, new))


def info_map(info: Column) -> Column:
    """Keys to values (flags: null); of a repeated key the first value counts."""
    pairs = F.filter(F.split(info, ";"), lambda kv: (kv != ".") & (kv != ""))
    keys = F.transform(pairs, lambda kv: F.split(kv, "=")[0])
    first = F.filter(
        F.transform(pairs, lambda kv, i: F.struct(F.split(kv, "=")[0].alias("key"), F.regexp_extract(kv, "=(.*)", 1).alias("v"), kv.contains("=").alias("has"), i.alias("i"))),
        lambda e: F.array_position(keys, e["key"]) == e["i"] + 1,
    )
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"].alias("key"), F.when(e["has"], e["v"]).alias("value"))))
