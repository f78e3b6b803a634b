"""Run records whose settings are open: JSON of any shape, held as VARIANT.

A record is an object with a name, scores and parameters; families of models bring settings of their own, and later
versions bring parts that earlier ones lack. Nothing is parsed into a fixed structure before a query asks for a part, so
no setting vanishes and no schema has to be inferred over all records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, key: str = "run") -> None:
    """One JSON object per line from (``key``, ``record`` VARIANT); other columns are left out."""
    line = F.to_json(F.struct(F.col(key), F.col("record")))
    records.select(line.alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, key: str = "run") -> DataFrame:
    """(``key``, ``record``, ``broken``): the records as written. A line that is no JSON object is kept in ``broken``,
    with nothing in the other columns, so that it can be counted."""
    line = spark.read.text(path)
    whole = F.try_parse_json("value")
    is_record = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    return line.select(
        F.when(is_record, F.try_variant_get(whole, f"$.{key}", "string")).alias(key),
        F.when(is_record, F.try_variant_get(whole, "$.record", "variant")).alias("record"),
        F.when(~is_record, F.col("value")).alias("broken"),
    )


def settings(records: DataFrame, path: str = "$", key: str = "run") -> DataFrame:
    """(``key``, setting, value, kind): one row per entry of the object at ``path``, values as JSON text.

    Records without that object have no rows. Entries that are JSON nulls are kept, with the value ``null``.
    """
    entries = F.try_variant_get("record", path, "map<string,variant>")
    flat = records.select(key, F.explode(entries).alias("setting", "_value"))
    kind = F.coalesce(F.schema_of_variant("_value"), F.lit("VOID"))
    # a JSON null comes out of the object as no value at all
    return flat.select(key, "setting", F.coalesce(F.to_json("_value"), F.lit("null")).alias("value"), kind.alias("kind"))


def unapplied(found: DataFrame, applied: Mapping[str, Sequence[str]], family: str = "family") -> DataFrame:
    """The rows of ``found`` (with a ``family`` column) whose setting the family's learner does not know.

    ``applied`` lists the settings each learner takes; of an unlisted family none is applied.
    """
    known: Column = F.lit(False)
    for name, names in applied.items():
        known = known | ((F.col(family) == name) & F.col("setting").isin(list(names)))
    return found.where(~F.coalesce(known, F.lit(False)))


def roll_up(found: DataFrame, by: Sequence[str] = ("setting",)) -> DataFrame:
    """How many records hold each setting, in how many different values and kinds: partial aggregates, whatever the count."""
    return found.groupBy(*by).agg(
        F.count("*").alias("records"), F.countDistinct("value").alias("values"), F.countDistinct("kind").alias("kinds")
    )
