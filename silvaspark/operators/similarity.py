"""Geometric similarity of two delineations of the same trees."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from silvaspark.functions import geometry


def _side(p: str, lo: str, hi: str) -> Column:
    return F.col(f"{p}_{hi}") - F.col(f"{p}_{lo}")


def box_metrics(pairs: DataFrame) -> DataFrame:
    """IoU, DIoU, CIoU and Dice of boxes ``a_minx ... a_maxy`` and ``b_minx ... b_maxy``, all in generated code."""
    c = lambda n: F.col(n)
    w = F.greatest(F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx"), F.lit(0.0))
    h = F.greatest(F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny"), F.lit(0.0))
    out = pairs.withColumn("inter", w * h).withColumn("wa", _side("a", "minx", "maxx")).withColumn("ha", _side("a", "miny", "maxy")).withColumn("wb", _side("b", "minx", "maxx")).withColumn("hb", _side("b", "miny", "maxy"))
    out = out.withColumn("both", c("wa") * c("ha") + c("wb") * c("hb"))
    out = out.withColumn("iou", F.coalesce(F.try_divide(c("inter"), c("both") - c("inter")), F.lit(0.0))).withColumn("dice", F.coalesce(F.try_divide(2 * c("inter"), c("both")), F.lit(0.0)))
    dx, dy = (c("a_minx") + c("a_maxx")) / 2 - (c("b_minx") + c("b_maxx")) / 2, (c("a_miny") + c("a_maxy")) / 2 - (c("b_miny") + c("b_maxy")) / 2
    gx, gy = F.greatest("a_maxx", "b_maxx") - F.least("a_minx", "b_minx"), F.greatest("a_maxy", "b_maxy") - F.least("a_miny", "b_miny")
    out = out.withColumn("diou", c("iou") - F.coalesce(F.try_divide(dx * dx + dy * dy, gx * gx + gy * gy), F.lit(0.0)))
    turn = F.atan(F.try_divide(c("wa"), c("ha"))) - F.atan(F.try_divide(c("wb"), c("hb")))
    v = F.lit(4 / (math.pi * math.pi)) * turn * turn
    alpha = F.coalesce(F.try_divide(v, (1 - c("iou")) + v), F.lit(0.0))
    return out.withColumn("ciou", F.when((c("ha") > 0) & (c("hb") > 0), c("diou") - alpha * v).otherwise(c("diou")))


def pair_up(reference: DataFrame, automated: DataFrame, key: str = "crown_id") -> DataFrame:
    """Boxes of equal ids side by side; repeated ids multiply."""
    box = ("minx", "miny", "maxx", "maxy")
    return reference.select(key, *(F.col(b).alias(f"a_{b}") for b in box)).join(automated.select(key, *(F.col(b).alias(f"b_{b}") for b in box)), key)


def giou(pairs: DataFrame) -> DataFrame:
    """``giou``: IoU less the share of the convex hull of both boxes that neither covers."""
    @F.pandas_udf(DoubleType())
    def hull(ax0: pd.Series, ay0: pd.Series, ax1: pd.Series, ay1: pd.Series, bx0: pd.Series, by0: pd.Series, bx1: pd.Series, by1: pd.Series) -> pd.Series:
        rows = zip(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, strict=True)
        return pd.Series([geometry.hull_area([(p, q) for x0, y0, x1, y1 in (r[:4], r[4:]) for p in (x0, x1) for q in (y0, y1)]) for r in rows])

    out = box_metrics(pairs).withColumn("hull", hull(*(f"{p}_{b}" for p in "ab" for b in ("minx", "miny", "maxx", "maxy"))))
    union = F.col("both") - F.col("inter")
    return out.withColumn("giou", F.col("iou") - F.coalesce(F.try_divide(F.col("hull") - union, F.col("hull")), F.lit(0.0)))


def analyze(reference: DataFrame, automated: DataFrame, key: str = "crown_id") -> DataFrame:
    """``key, iou, giou, diou, ciou, dice`` per pair of equal ids."""
    return giou(pair_up(reference, automated, key)).select(key, "iou", "giou", "diou", "ciou", "dice")


def polygon_iou(a: bytes, b: bytes) -> float:
    """IoU of a polygon with a convex one, on WKB."""
    p, q = geometry.polygons(geometry.from_wkb(a))[0][0], geometry.polygons(geometry.from_wkb(b))[0][0]
    q = q if geometry.area(q) > 0 else q[::-1]
    part = geometry.clip([x[:2] for x in p], [x[:2] for x in q])
    inter = abs(geometry.area(part)) if part else 0.0
    union = abs(geometry.area(p)) + abs(geometry.area(q)) - inter
    return inter / union if union > 0 else 0.0
