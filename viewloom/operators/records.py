"""Joins and set operations on shards, metadata and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a selected row without metadata gets.
MISSING_ID, MISSING_SEGMENT = "-1", (-1.0, -1.0)


def last_wins(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Per key the values of the row with the largest order, as one aggregation that combines early."""
    got = F.max_by(F.struct(*values), F.col(order))
    return df.groupBy(key).agg(got.alias("_v")).select(key, "_v.*")


def first_wins(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Of rows that agree in ``columns`` the first in order, as one aggregation that combines early."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(columns)]).agg(row.alias("_row")).select("_row.*")


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done, keys, "left_anti")


def having(df: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(meta, keys, "left_semi")


def with_metadata(selected: DataFrame, meta: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Left join to metadata; a row without gets the sentinel given for each value."""
    joined = selected.join(meta, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), default) for c, default in values.items()})


def output_rows(selected: DataFrame, meta: DataFrame) -> DataFrame:
    """The selection file's rows: shard, file, id and segment, keyed on shard and stem."""
    sentinel = {"id": F.lit(MISSING_ID), "segment": F.array(*map(F.lit, MISSING_SEGMENT))}
    return with_metadata(selected, meta, ["shard_name", "stem"], sentinel)


def complete_shards(rows: DataFrame, sizes: DataFrame, ratio: float = 0.99) -> DataFrame:
    """Shards with at least the half-even-rounded share of their rows; the others are dropped."""
    have = rows.groupBy("shard_name").agg(F.count("*").alias("have"))
    joined = have.join(sizes, "shard_name")
    return joined.where(F.col("have") >= F.bround(F.col("shard_size") * F.lit(ratio)))


def with_shard_size(rows: DataFrame) -> DataFrame:
    """Each row's shard size; sizes are aggregated first, so no window holds a whole shard."""
    return rows.join(rows.groupBy("shard_name").agg(F.count("*").alias("shard_size")), "shard_name")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def non_matching(files: DataFrame, listed: DataFrame, keys: tuple[str, ...] = ("shard_name", "filename")) -> DataFrame:
    """Files that their shard's metadata does not list, with their number of rows."""
    return not_done(files, listed, list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def complete_modalities(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value in each of the columns; what could not be read is null there and goes."""
    return rows.na.drop(subset=columns)


def transposed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per position of equally long arrays: columns of lists as a list of rows; other columns are repeated."""
    rest = [c for c in rows.columns if c not in columns]
    each = rows.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("pos", "_z"))
    return each.select(*rest, F.col("pos").cast("long").alias("pos"), *[F.col(f"_z.{c}").alias(c) for c in columns])


def levels_exchanged(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(inner, map of outer to value) from rows that are keyed by outer, then inner."""
    return rows.groupBy(inner).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(outer, value)))).alias(value))


def flat_maps(rows: DataFrame, columns: list[str], separator: str = "_") -> DataFrame:
    """``flat``: several maps as one, whose keys begin with the name of the map."""

    def named(column: str) -> Column:
        return F.transform_keys(column, lambda k, _: F.concat(F.lit(f"{column}{separator}"), k))

    return rows.withColumn("flat", F.map_concat(*map(named, columns)))


def shard_partitions(shards: DataFrame, logs: DataFrame) -> DataFrame:
    """The partition of each shard by the latest log, by its time stamp as text, that lists it; -1 if none does."""
    listed = logs.select("partition", "timestamp", F.explode("shards").alias("shard_name"))
    latest = listed.groupBy("shard_name").agg(F.max_by("partition", F.struct("timestamp", "partition")).alias("partition"))
    return shards.join(latest, "shard_name", "left").withColumn("partition", F.coalesce("partition", F.lit(-1)))


def flatten_features(rows: DataFrame, column: str = "features") -> DataFrame:
    """(key, layer, value) from an array of structs that each hold a map by layer."""
    each = rows.select("*", F.explode(column).alias("_f"))
    return each.select(*[c for c in rows.columns if c != column], F.col("_f.model_key").alias("model_key"), F.explode("_f.array").alias("layer", "value"))


def samples_by_prefix(members: DataFrame) -> DataFrame:
    """Archive members grouped into samples by name before the first dot; a repeated suffix is an error."""
    base = F.regexp_extract("name", r"^((?:.*/)?[^./]+)\.", 1)
    ext = F.lower(F.regexp_extract("name", r"^(?:.*/)?[^./]+\.(.*)$", 1))
    grouped = members.where(base != "").groupBy("shard_name", base.alias("prefix")).agg(F.sort_array(F.collect_list(F.struct(ext.alias("ext"), F.col("content")))).alias("_m"))
    clash = F.size(F.array_distinct(F.transform("_m", lambda m: m.ext))) < F.size("_m")
    return grouped.select("shard_name", "prefix", F.when(clash, F.raise_error(F.concat(F.lit("repeated suffix in "), F.col("prefix")))).otherwise(F.map_from_entries("_m")).alias("sample"))


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs exactly once, such as the unselected part of candidates plus selection."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def covering_models(models: DataFrame, shards: list[str], subset: bool = True) -> DataFrame:
    """Cached models whose shard set lies within (or covers) the wanted one."""
    want = F.array(*map(F.lit, shards))
    left = F.array_except("shards", want) if subset else F.array_except(want, F.col("shards"))
    return models.where(F.size(left) == 0)


def completeness(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Groups that do not have the expected number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def new_sizes(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Sizes of the shards that the cache (shard_name, shard_size) lacks, with those that it has."""
    fresh = rows.join(cached.select("shard_name"), "shard_name", "left_anti").groupBy("shard_name").agg(F.count("*").alias("shard_size"))
    return cached.select("shard_name", "shard_size").unionByName(fresh)


def merged_last_wins(parts: list[DataFrame], key: str, values: list[str]) -> DataFrame:
    """The union of parts in which, of rows with one key, that of the latest part stays."""
    each = [p.select(key, *values, F.lit(i).alias("_part")) for i, p in enumerate(parts)]
    out = each[0]
    for p in each[1:]:
        out = out.unionByName(p)
    return last_wins(out, key, "_part", values)


def no_nan(df: DataFrame, column: str) -> DataFrame:
    """``df``, or an error if a value is not a number."""
    bad = F.raise_error(F.concat(F.lit("not a number in "), F.lit(column)))
    return df.withColumn(column, F.when(F.isnan(column), bad.cast("double")).otherwise(F.col(column)))
