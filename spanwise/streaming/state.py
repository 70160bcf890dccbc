"""The state of a stopped stream as tables, and a manifest of what a checkpoint was made with."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "spanwise-manifest"


def state_rows(spark: SparkSession, checkpoint: str, where: str = "true") -> DataFrame:
    """One row per operator and variable of the checkpoint's last batch: ``operator_id``, ``operator``, ``variable``, ``rows``.

    Built-in operators have one unnamed variable; a join has one for each side. ``where`` may tell which ``key`` and ``value`` count.
    """
    return reduce(DataFrame.unionByName, [
        table.where(where).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(number).alias("operator_id"), F.lit(operator).alias("operator"), F.lit(variable).alias("variable"), "rows")
        for number, operator, variable, table in _tables(spark, checkpoint)])


def state_table(spark: SparkSession, checkpoint: str, operator_id: int = 0, variable: str = "") -> DataFrame:
    """The keys and values that an operator (or a variable of it) holds."""
    for number, _, name, table in _tables(spark, checkpoint):
        if (number, name) == (operator_id, variable):
            return table
    raise ValueError(f"no state of operator {operator_id} named {variable!r}")


def _tables(spark: SparkSession, checkpoint: str):
    # A few rows, one per store of an operator.
    stores = spark.read.format("state-metadata").load(checkpoint).select(
        "operatorId", "operatorName", "stateStoreName", "operatorProperties").distinct().orderBy("operatorId", "stateStoreName")
    seen = set()
    for number, operator, store, properties in stores.collect():
        variables = [v["stateName"] for v in json.loads(properties or "{}").get("stateVariables", [])]
        sides = ("left", "right") if store.startswith(("left", "right")) else ()
        for name in [v for v in variables if not v.startswith("$")] or sides or [""]:
            if (number, name) in seen:
                continue
            seen.add((number, name))
            reader = spark.read.format("statestore").option("operatorId", number)
            if variables:
                reader = reader.option("stateVarName", name)
            elif sides:
                reader = reader.option("joinSide", name)
            yield number, operator, name, reader.load(checkpoint)


def check_manifest(spark: SparkSession, checkpoint: str, settings: dict) -> None:
    """Note the settings in a new checkpoint; refuse an old one that was made with others.

    A checkpoint's state is laid out by them: with another number of lanes or another slice, keys would look for their state in the wrong
    place and lose pairs without a word.
    """
    given = {name: str(value) for name, value in settings.items()}
    path = f"{checkpoint.rstrip('/')}/{_MANIFEST}"
    table = spark.createDataFrame(sorted(given.items()), "name string, value string")
    # Written once: a folder that is there is left as it is.
    table.coalesce(1).write.mode("ignore").json(path)
    made = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(path).collect()}
    if made != given:
        other = sorted(n for n in made.keys() | given.keys() if made.get(n) != given.get(n))
        raise ValueError(f"the checkpoint {checkpoint} was made with other settings: " + ", ".join(
            f"{n} was {made.get(n)}, is {given.get(n)}" for n in other))
