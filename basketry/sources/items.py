"""Reading item records from tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source names and the Spark data source each stands for.  Those with a dotted
# or foreign name need that connector's package on the class path.
FORMATS = {
    "parquet": "parquet",
    "orc": "orc",
    "csv": "csv",
    "json": "json",
    "text": "text",
    "jdbc": "jdbc",
    "elastic": "org.elasticsearch.spark.sql",
    "cassandra": "org.apache.spark.sql.cassandra",
    "hbase": "org.apache.hadoop.hbase.spark",
    "mongodb": "mongodb",
}

# Fields of an item record and their types.
FIELDS = {"site": "string", "user": "string", "group": "string", "item": "int", "timestamp": "bigint"}

Spec = Mapping[str, "str | tuple[str, str]"]


def chosen_fields(df: DataFrame, spec: Spec | None = None) -> dict[str, tuple[str, str]]:
    """The source column and type of each field; an unknown field or a missing column is an error."""
    chosen = {name: (name, kind) for name, kind in FIELDS.items()}
    for name, value in (spec or {}).items():
        if name not in FIELDS:
            raise ValueError(f"unknown field {name!r}, expected one of {sorted(FIELDS)}")
        chosen[name] = (value, FIELDS[name]) if isinstance(value, str) else tuple(value)
    missing = [source for source, _ in chosen.values() if source not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return chosen


def map_fields(df: DataFrame, spec: Spec | None = None) -> DataFrame:
    """Item records (site, user, group, item, timestamp) from any table.

    ``spec`` maps a field to a source column or to (source column, type).  A
    field it leaves out is taken from the column of the same name.  An unknown
    field or a missing column is an error.  ``rejects.check_fields`` takes dirty
    values.
    """
    fields = chosen_fields(df, spec).items()
    return df.select(*[F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in fields])


def read_items(spark: SparkSession, format: str, mapping: Spec | None = None, **options) -> DataFrame:
    """Item records from a named source.

    ``options`` go to the data source; ``path`` is the path of file sources.
    For ``jdbc`` give ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``, or the table is read by one task.
    """
    if format not in FORMATS:
        raise ValueError(f"unknown source {format!r}, expected one of {sorted(FORMATS)}")
    reader = spark.read.format(FORMATS[format])
    schema = options.pop("schema", None)
    if schema is not None:
        reader = reader.schema(schema)
    return map_fields(reader.options(**options).load(), mapping)
