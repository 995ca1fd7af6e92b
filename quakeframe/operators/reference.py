"""Values of reference columns at depths, on either side of their interfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def layers(column: DataFrame, group: Sequence[str], depth: str, side: str, values: Sequence[str]) -> DataFrame:
    """``group``, _z0, _z1 and _v0, _v1 (the values at both ends) of what lies between a column's knots, with a layer of 1 km beyond either end.

    Knots follow each other by depth and side; two of one depth make an interface and no layer.
    """
    order = Window.partitionBy(*group).orderBy(depth, side)
    ends = [F.col(depth).alias("_z"), F.struct(*values).alias("_v"), F.lead(depth).over(order).alias("_zn"), F.lead(F.struct(*values)).over(order).alias("_vn"), F.lag(depth).over(order).isNull().alias("_first")]
    knots = column.filter(F.col(depth).isNotNull()).select(*group, *ends)
    layer = lambda a, b, v, w: F.struct(a.alias("_z0"), b.alias("_z1"), v.alias("_v0"), w.alias("_v1"))
    z, v = F.col("_z"), F.col("_v")
    between = F.when(F.col("_zn").isNull(), layer(z, z + 1, v, v)).otherwise(layer(z, F.col("_zn"), v, F.col("_vn")))
    made = F.when(F.col("_first"), F.array(layer(z - 1, z, v, v), between)).otherwise(F.array(between))
    return knots.select(*group, F.explode(made).alias("_l")).select(*group, "_l.*").filter("_z1 > _z0")


def at_depth(points: DataFrame, column: DataFrame, group: Sequence[str], depth: str, values: Sequence[str], below: bool = True, side: str = "side", width: float = 10.0) -> DataFrame:
    """``points`` with ``values`` of the column of their group, linear between its knots, held beyond its ends.

    At an interface the lower side's value counts if ``below``, else the upper one's. Layers are filed in steps of
    ``width``, so each point meets the layers of its own step by an equality join. Points without a depth or a column get
    nulls. Columns of points keep their names; ``values`` must not be among them.
    """
    flat = layers(column, group, depth, side, values)
    ends = flat.groupBy(*group).agg(F.min("_z0").alias("_low"), F.max("_z1").alias("_high"))
    step = lambda x: F.floor(x / width).cast("long")
    filed = flat.withColumn("_step", F.explode(F.sequence(step(F.col("_z0")), step(F.col("_z1")))))
    at = points.join(ends, list(group), "left").withColumn("_at", F.least(F.greatest(F.col(depth), F.col("_low") + 0.5), F.col("_high") - 0.5))
    at = at.withColumn("_at", F.when(F.col(depth).isNotNull() & ~F.isnan(depth), F.col("_at"))).withColumn("_step", step(F.col("_at"))).drop("_low", "_high")
    same = [F.col(f"p.{c}") == F.col(f"l.{c}") for c in (*group, "_step")]
    z, z0, z1 = F.col("p._at"), F.col("l._z0"), F.col("l._z1")
    inside = (z >= z0) & (z < z1) if below else (z > z0) & (z <= z1)
    condition = inside
    for s in same:
        condition = s & condition
    share = (z - z0) / (z1 - z0)
    found = [(F.col(f"l._v0.{c}") + share * (F.col(f"l._v1.{c}") - F.col(f"l._v0.{c}"))).alias(c) for c in values]
    return at.alias("p").join(filed.alias("l"), condition, "left").select(*[F.col(f"p.{c}") for c in points.columns], *found)
