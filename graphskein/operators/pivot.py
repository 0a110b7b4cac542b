"""Attribute-value rows to a wide table with typed columns, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphskein.plans.scratch import cut

# fixed values: declared type of an attribute -> type of its column
COLUMN_TYPES = {"long": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp_ntz", "string": "string", "default": "string", "geo": "string", "password": "string"}

# fixed values: text forms that fit a type
LONG_TEXT = r"^[+-]?[0-9]+$"
DOUBLE_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
TIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?$"

#: More attributes than this are refused: each is a column of the plan.
MAX_COLUMNS = 5000


def time_of(text: Column) -> Column:
    """A timestamp without zone, in UTC, of ISO text with or without an offset; null if it is no valid time."""
    local = F.expr("null").cast("timestamp_ntz")
    local = F.when(text.rlike(TIME_TEXT), F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")).otherwise(local)
    offset = F.regexp_extract(text, r"([+-])([0-9]{2}):([0-9]{2})$", 0)
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")
    minutes = F.when((F.length(text) < 20) | (offset == ""), 0).when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes)
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def cell_value(declared: Column, text: Column, typed: Mapping[str, Column]) -> Column:
    """The value of a row as canonical text, or null if it does not fit the ``declared`` type.

    ``text`` counts if it is not blank (empty or only spaces), else the column of the declared type in ``typed``. NaN
    and infinite typed doubles do not fit.
    """
    filled = F.trim(text) != ""
    t = F.trim(text)
    number = F.when(filled, F.when(t.rlike(LONG_TEXT), t.try_cast("bigint"))).otherwise(typed["long"])
    parsed = F.when(filled, F.when(t.rlike(DOUBLE_TEXT), t.try_cast("double"))).otherwise(F.coalesce(typed["double"], typed["long"].cast("double")))
    decimal = F.when(~F.isnan(parsed) & (F.abs(parsed) != float("inf")), parsed)
    lower = F.lower(t)
    truth = F.when(filled, F.when(lower.isin("true", "1"), True).when(lower.isin("false", "0"), False)).otherwise(typed["boolean"])
    moment = F.when(filled, time_of(t)).otherwise(typed["timestamp"].cast("timestamp_ntz"))
    out = F.when(declared == "long", number.cast("string")).when(declared == "double", decimal.cast("string"))
    out = out.when(declared == "boolean", truth.cast("string")).when(declared == "timestamp", moment.cast("string"))
    for kind in ("geo", "password"):
        out = out.when(declared == kind, F.when(filled, text).otherwise(typed[kind]))
    return out.when(declared.isin("string", "default"), F.when(filled, text))


def attributes_to_wide(
    triples: DataFrame, attributes: DataFrame, *, entity: str = "subject", attribute: str = "predicate", order_by: tuple[str, str] = ("read_at", "triple_id"),
    skip_types: tuple[str, ...] = ("uid",), prefix: str = "",
) -> DataFrame:
    """One row per entity with one column of declared type per attribute of ``attributes(predicate, objecttype)``.

    Attribute names are compared trimmed and in lower case; undeclared ones and those of ``skip_types`` give no
    column. Among the rows of an entity and attribute whose value fits the declared type (:func:`cell_value`), the one of
    greatest ``order_by`` fills the cell (a null counts as least; equal rows give the same value, and among different
    rows equal in both the greatest value holds). An entity without any usable row has a row of nulls; rows with a
    null entity are left out. Columns are named ``prefix`` + attribute, so an attribute called like the entity column
    needs a prefix (refused otherwise). Empty input: no rows, all columns.

    Plan: rows shrink to one value per cell before and after one shuffle; entities times attribute positions make the
    grid, built in the entity's own partition; values are left-joined there (the position is a residual condition, so
    that grid, join and the collecting of arrays share the partitioning by entity); the arrays, sorted by position,
    have fixed indices, which are cast to their column's type.
    """
    declared = [(r[0], r[1]) for r in attributes.where(~F.col("objecttype").isin(*skip_types)).select("predicate", "objecttype").distinct().orderBy("predicate").limit(MAX_COLUMNS + 1).collect()]
    if len(declared) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} attributes")
    if unknown := sorted({t for _, t in declared} - set(COLUMN_TYPES)):
        raise ValueError(f"unknown declared types: {unknown}")
    if entity in {prefix + p for p, _ in declared} or len({p for p, _ in declared}) < len(declared):
        raise ValueError("clashing column names; give a prefix, or declare each attribute once")
    spark = triples.sparkSession
    known = spark.createDataFrame([(p.strip().lower(), i, t) for i, (p, t) in enumerate(declared)], "_attr string, _pos int, _type string")
    at, tie = order_by
    typed = {"long": F.col("objectlong"), "double": F.col("objectdouble"), "boolean": F.col("objectboolean"), "timestamp": F.col("objecttimestamp"), "geo": F.col("objectgeo"), "password": F.col("objectpassword")}
    rows = triples.where(F.col(entity).isNotNull()).join(F.broadcast(known), F.lower(F.trim(F.col(attribute))) == F.col("_attr"), "left")  # at most MAX_COLUMNS rows
    rows = rows.select(F.col(entity).alias("e"), "_pos", F.col(at).alias("at"), F.col(tie).alias("tie"), cell_value(F.col("_type"), F.col("objectstring"), typed).alias("v"))
    # unusable rows only say that the entity is there
    rows = rows.select("e", F.when(F.col("v").isNotNull(), F.col("_pos")).otherwise(-1).alias("pos"), F.when(F.col("v").isNotNull(), F.struct("at", "tie", "v")).alias("s"))
    cells = cut(rows.groupBy("e", "pos").agg(F.max("s").alias("s")).select("e", "pos", F.col("s.v").alias("v")))

    by_entity = cells.repartition("e")
    grid = by_entity.select(F.col("e").alias("entity")).distinct().select("entity", F.explode(F.array(*(F.lit(i) for i in range(len(declared))))).alias("at")) if declared else None
    if grid is None:
        return by_entity.select(F.col("e").alias(entity)).distinct()
    values = by_entity.where("pos >= 0")
    full = grid.join(values.hint("shuffle_hash"), (F.col("entity") == F.col("e")) & (F.col("at") - F.col("pos") == 0), "left")
    arrays = full.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("a"))
    columns = [F.col("a")[i]["v"].try_cast(COLUMN_TYPES[t]).alias(prefix + p) for i, (p, t) in enumerate(declared)]
    return arrays.select(F.col("entity").alias(entity), *columns)


def cell_text(value: Column, column_type: str) -> Column:
    """A typed cell as text: doubles with three decimals, timestamps as 'yyyy-MM-dd HH:mm:ss', others as they are."""
    if column_type == "double":
        return F.format_string("%.3f", value)
    if column_type.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return value.cast("string")


def wide_to_cells(wide: DataFrame, entity: str = "subject", attribute: str = "predicate", prefix: str = "") -> DataFrame:
    """The filled cells of a wide table: ``entity``, ``attribute``, ``cell_text``."""
    cells = [(c, t) for c, t in wide.dtypes if c != entity]
    each = F.explode(F.array_compact(F.array(*(F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c[len(prefix) :]).alias("a"), cell_text(F.col(f"`{c}`"), t).alias("v"))) for c, t in cells))))
    return wide.select(entity, each.alias("_c")).select(entity, F.col("_c.a").alias(attribute), F.col("_c.v").alias("cell_text"))
