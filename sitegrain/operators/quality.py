"""Contract checks: every violation of a declared row contract."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.text import strip
from sitegrain.operators.ordered import lookup
from sitegrain.session import cut_lineage


@dataclass(frozen=True)
class Field:
    """One field of a contract; ``kind`` is string, array, enum or any."""

    name: str
    kind: str = "string"
    required: bool = True
    min_length: int = 0
    trim: bool = True
    min_items: int = 0
    values: tuple[str, ...] = ()
    pattern: str | None = None


def _violations(label: str, field: Field) -> list[Column]:
    value, where = F.col(field.name), f"{label}.{field.name}"
    out = []
    if field.required:
        out.append(F.when(value.isNull(), F.lit(f"{where} is required.")))
    present = value.isNotNull()
    if field.kind == "string":
        if field.trim and field.min_length > 0:
            short = present & (F.length(strip(value)) < field.min_length)
            out.append(
                F.when(short, F.lit(f"{where} must be at least {field.min_length} characters."))
            )
        if field.pattern:
            out.append(
                F.when(
                    present & ~value.rlike(field.pattern),
                    F.lit(f"{where} is not in the expected format."),
                )
            )
    if field.kind == "array" and field.min_items > 0:
        few = present & (F.size(value) < field.min_items)
        out.append(F.when(few, F.lit(f"{where} must contain at least {field.min_items} item(s).")))
    if field.kind == "enum":
        listed = ", ".join(field.values)
        out.append(
            F.when(present & ~value.isin(*field.values), F.lit(f"{where} must be one of: {listed}."))
        )
    return out


def check_contract(
    df: DataFrame, label: str, fields: Sequence[Field], keys: Sequence[str] = (), allow_unknown: bool = False
) -> DataFrame:
    """Add ``violations``, the messages of a row in contract order.

    Columns outside the contract and the keys are unknown keys: a value there
    is a violation unless unknown keys are allowed.
    """
    messages = [m for field in fields for m in _violations(label, field)]
    if not allow_unknown:
        known = {f.name for f in fields} | set(keys)
        messages += [
            F.when(F.col(c).isNotNull(), F.lit(f"{label}.{c} is not allowed."))
            for c in df.columns
            if c not in known
        ]
    return df.withColumn("violations", F.array_compact(F.array(*messages)))


def check_blueprints(blueprints: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unknown components and variants, one row per bad section.

    ``blueprints(keys…, sections)``, ``registry(component, variant)``. The
    registry is reduced to one row per component and written before the join:
    its size is known, so Spark sends a small one to all tasks, and a large one
    meets the sections in an exchange of its own, whose hot keys are split.
    """
    sections = blueprints.select(*keys, F.posexplode("sections").alias("pos", "section")).select(
        *keys,
        F.col("pos").cast("long").alias("pos"),
        F.col("section.component").alias("component"),
        F.col("section.variant").alias("variant"),
    )
    known = registry.distinct().groupBy("component").agg(F.collect_set("variant").alias("variants"))
    joined = lookup(sections, cut_lineage(known, "registry"), ["component"], keys[0])
    message = F.when(
        F.col("variants").isNull(),
        F.concat(F.lit('Blueprint references unknown component "'), F.col("component"), F.lit('".')),
    ).when(
        ~F.array_contains("variants", F.col("variant")),
        F.concat(
            F.lit('Component "'), F.col("component"), F.lit('" does not define variant "'),
            F.col("variant"), F.lit('".'),
        ),
    )
    return joined.withColumn("message", message).filter("message IS NOT NULL").select(
        *keys, "pos", "component", "variant", "message"
    )
