"""Label normalization, recoding, selection and scopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.numbers import all_of, sure
from evenkeel.functions.ranks import gapless_rank


def strip_suffix(c: Column, suffix: str) -> Column:
    """c without the suffix at its very end."""
    return F.when(c.endswith(suffix), c.substr(F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def recode(c: Column, names: Mapping[str, str]) -> Column:
    """c by the map; labels that it doesn't know pass unchanged."""
    if not names:
        return c.cast("string")
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, c.cast("string")), c.cast("string"))


def keep_raw(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_raw": F.col(c) for c in columns})


def normalise(df: DataFrame, maps: Mapping[str, Mapping[str, str]], suffixes: Mapping[str, str] = {}) -> DataFrame:
    """Keeps the raw labels as *_raw, strips suffixes, then recodes."""
    columns = list(dict.fromkeys([*suffixes, *maps]))
    stripped = {c: strip_suffix(F.col(c).cast("string"), suffixes[c]) if c in suffixes else F.col(c) for c in columns}
    return keep_raw(df, columns).withColumns({c: recode(stripped[c], maps.get(c, {})) for c in columns})


def select_controlled(df: DataFrame, fixed: Mapping[str, object], maps: Mapping[str, Mapping[str, str]] = {}, suffixes: Mapping[str, str] = {}) -> DataFrame:
    """Rows whose (recoded) columns equal the fixed values. Where maps and suffixes tell the raw labels of a value, a filter
    on the kept raw column is added, which reaches the scan."""
    flags = []
    for column, value in fixed.items():
        flags.append(F.col(column) == F.lit(value))
        raw = [k for k, v in maps.get(column, {}).items() if v == value]
        if raw and f"{column}_raw" in df.columns and value not in maps[column]:
            raw.append(value)
            flags.append(F.col(f"{column}_raw").isin([x + end for x in raw for end in {"", suffixes.get(column, "")}]))
    return df.filter(sure(all_of(*flags))) if flags else df


def in_scopes(df: DataFrame, column: str, scopes: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """df once for each scope that its label belongs to; None is a scope of all labels."""
    tags = [F.when(F.lit(True) if labels is None else F.col(column).isin(list(labels)), F.lit(name)) for name, labels in scopes.items()]
    return df.withColumn("scope", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())))


def of_scope(df: DataFrame, column: str, scopes: Mapping[str, Sequence[str] | None], name: str) -> DataFrame:
    if name not in scopes:
        raise ValueError(f"unknown scope {name!r}; there are {sorted(scopes)}")
    return df if scopes[name] is None else df.filter(F.col(column).isin(list(scopes[name])))


def config_id(cfg: Sequence[str]) -> Column:
    return F.concat_ws("|", *cfg)


def position(c: Column, levels: Sequence[str]) -> Column:
    """The place of a label in its ordered levels, from 0; unknown labels come after them all."""
    at = F.array_position(F.array(*map(F.lit, levels)), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(levels)))


def composite_position(parts: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    """One number that orders by the positions of several labels, the first the most important."""
    out = F.lit(0)
    for c, levels in parts:
        out = out * (len(levels) + 1) + position(c, levels)
    return out


def dense_codes(cells: DataFrame, cfg: Sequence[str]) -> DataFrame:
    """cells, one row a configuration, with config_id and its dense number from 0 in the order of the labels."""
    named = cells.withColumns({"config_id": config_id(cfg), "__all": F.lit(0)})
    return gapless_rank(named, ["__all"], ["config_id"], "config_code", 1).drop("__all")


def agreement(df: DataFrame, row_id: str, column: str, names: Mapping[str, str]) -> DataFrame:
    """For each raw label of the map: runs with it, runs with its display label, and runs that have only one of the two."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    raw = df.filter(F.col(f"{column}_raw").isin(list(names))).select(row_id, F.element_at(table, F.col(f"{column}_raw")).alias("by_raw"))
    shown = df.filter(F.col(column).isin(list(names.values()))).select(row_id, F.col(column).alias("by_name"))
    both = raw.join(shown, row_id, "full_outer").withColumn("label", F.coalesce("by_raw", "by_name"))
    return both.groupBy("label").agg(F.count("by_raw").alias("n_raw"), F.count("by_name").alias("n_shown"), F.count_if(~F.col("by_raw").eqNullSafe(F.col("by_name"))).alias("n_apart"))
