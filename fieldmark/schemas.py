"""Table layouts of the data model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "date": T.DateType(),
          "vector": T.ArrayType(T.DoubleType())}


def layout(text: str) -> T.StructType:
    """Schema from "name type, ..."; needs no running session, unlike the DDL parser."""
    fields = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


OBSERVATION = layout(
    "global_id string, hotspot_id string, lat double, lon double, state string, country string, checklist_id string, "
    "observer_id bigint, obs_date date, species string, complete int")
CHECKLIST = layout(
    "checklist_id string, hotspot_id string, lat double, lon double, state string, country string, obs_date date, "
    "edited_date date, complete int")
OCCURRENCE = layout(
    "occurrence_id bigint, event_id string, species string, lat double, lon double, country_code string, state string, "
    "occ_date date")
TARGET = layout("hotspot_id string, probs vector, num_complete_checklists bigint")
PATCH = layout("bands int, h int, w int, data vector")

# Environmental layers in vector order, 19 climate then 8 soil.
CLIMATE = [f"bio_{i}" for i in range(1, 20)]
SOIL = ["bdticm", "bldfie", "cecsol", "clyppt", "orcdrc", "phihox", "sltppt", "sndppt"]
ENVIRONMENT = CLIMATE + SOIL


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType) and _holds_numbers(kind):
        return F.transform(value, lambda v: _clean(v, kind.elementType))
    if isinstance(kind, T.StructType) and _holds_numbers(kind):
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def _holds_numbers(kind: T.DataType) -> bool:
    """Whether floating-point numbers occur at any depth."""
    if isinstance(kind, T.ArrayType):
        return _holds_numbers(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_numbers(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def null_for_nan(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL throughout; NaN becomes NULL at ingest, inside arrays and structs too."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
