"""Named operators and the plan of those that apply to a source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Operator:
    name: str
    stage: str
    run: Callable[..., DataFrame]
    input_types: tuple[str, ...] = ()
    description: str = ""


@dataclass
class Registry:
    """Operators by name; a name can be given once."""

    operators: dict[str, Operator] = field(default_factory=dict)

    def register(self, op: Operator) -> None:
        if not op.name or op.name in self.operators:
            raise ValueError(f"no name, or one that is taken: {op.name!r}")
        self.operators[op.name] = op

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(o.name, o.stage, list(o.input_types), o.description) for o in self.operators.values()], "name string, stage string, input_types array<string>, description string")

    def plan(self, spark: SparkSession, source_type: str) -> DataFrame:
        """Each operator with whether it is selected for a source type, and why not."""
        ok = (F.size("input_types") == 0) | F.array_contains("input_types", source_type)
        return self.manifest(spark).select("name", "stage", ok.alias("selected"), F.when(~ok, F.concat(F.lit("not for "), F.lit(source_type))).alias("reason"))

    def plans(self, sources: DataFrame) -> DataFrame:
        """As plan, for each of many sources (source_id, source_type); a source without a type takes what asks for none."""
        told = F.array(*[F.struct(F.lit(o.name).alias("name"), F.lit(o.stage).alias("stage"), (F.array(*map(F.lit, o.input_types)) if o.input_types else F.array().cast("array<string>")).alias("types")) for o in self.operators.values()])
        each = sources.select("source_id", "source_type", F.explode(told).alias("o"))
        ok = (F.size("o.types") == 0) | F.coalesce(F.array_contains("o.types", F.col("source_type")), F.lit(False))
        return each.select("source_id", "o.name", "o.stage", ok.alias("selected"), F.when(~ok, F.concat(F.lit("not for "), F.coalesce("source_type", F.lit("a source of no type")))).alias("reason"))
