"""Queries of vectors, similarity and the relational store on the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaspark.operators import similarity as sim
from silvaspark.operators import store, vector
from silvaspark.plans.catalogue import ORACLES, query
from silvaspark.sources.roles import CROWNS, CROWNS2, TREES, crowns, table, trees
from silvaspark.streaming import events as stream


@query(f"with {CROWNS} select id as crown_id, species, minx, miny, maxx, maxy from k where minx >= 10 and maxx <= 60 and miny >= 5 and maxy <= 50")
def vector_scan(spark, d):
    return crowns(spark, d).where("minx >= 10 and maxx <= 60 and miny >= 5 and maxy <= 50")


@query(f"with {CROWNS} select id as crown_id, species, minx, miny, maxx, maxy from k")
def vector_layer(spark, d):
    """The whole layer, as a load gives it."""
    return crowns(spark, d)


@query(f"with {CROWNS} select id as crown_id, species, minx, miny, maxx, maxy from k where maxx - minx > 5")
def filter_vector(spark, d):
    return vector.filter_vector(crowns(spark, d), lambda df: df.maxx - df.minx > 5)


@query(f"with {CROWNS} select species, minx, miny, maxx, maxy from k")
def select_columns(spark, d):
    return vector.select_columns(crowns(spark, d), ["species"])


@query(f"with {CROWNS} select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from k")
def total_bounds(spark, d):
    return vector.total_bounds(crowns(spark, d))


@query(f"with {CROWNS} select row_number() over (order by id // 3, minx, miny, maxx, maxy) - 1 as crown_id, species, minx, miny, maxx, maxy from k")
def prepare_crowns(spark, d):
    """Ids that repeat, so all are replaced."""
    c = crowns(spark, d).withColumn("crown_id", F.expr("crown_id div 3")).withColumnsRenamed({"crown_id": "id", "species": "kind"})
    return vector.prepare_crowns(c, "id", "kind")


@query(f"with {TREES} select tree_id, species, x, y, 'Alive' as status from t")
def prepare_treetops(spark, d):
    t = trees(spark, d).withColumn("tree_id", F.col("tree_id").cast("long")).withColumnsRenamed({"tree_id": "key", "species": "kind"})
    return vector.prepare_treetops(t, {"key": "tree_id", "kind": "species"})


@query(f"with {CROWNS} select id as crown_id, round((minx + maxx) / 2, 6) as cx, round((miny + maxy) / 2, 6) as cy from k")
def centroid(spark, d):
    return vector.centroid(vector.box_ring(crowns(spark, d))).select("crown_id", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"with {TREES} select tree_id, x, y, 0.0 as z from t")
def force_z(spark, d):
    return vector.force_z(trees(spark, d).select("tree_id", "x", "y"), 3)


@query(f"""with {CROWNS}, {TREES}, m as (select id, (minx + maxx) / 2 + 0.7 as x, (miny + maxy) / 2 as y from k),
    n as (select m.id, arg_min(t.species, ((m.x - t.x) * (m.x - t.x) + (m.y - t.y) * (m.y - t.y), t.tree_id)) as s from m join t on t.x between m.x - 2 and m.x + 2 and t.y between m.y - 2 and m.y + 2
        where (m.x - t.x) * (m.x - t.x) + (m.y - t.y) * (m.y - t.y) <= 4 group by m.id)
    select k.id as crown_id, coalesce(n.s, k.species) as species from k left join n on k.id = n.id""")
def label_crowns(spark, d):
    c = crowns(spark, d).withColumn("minx", F.col("minx") + 0.7).withColumn("maxx", F.col("maxx") + 0.7)
    return vector.label_crowns(c, trees(spark, d)).select("crown_id", "species")


_ASSIGN = "a as (select min(cid) as crown_id, tree_id from (select k.id as cid, min(t.tree_id) as tree_id from k join t on t.x between minx and maxx and t.y between miny and maxy group by k.id) group by tree_id)"


@query(f"with {CROWNS}, {TREES}, {_ASSIGN} select crown_id, tree_id from a")
def assign_tree_ids(spark, d):
    return vector.assign_tree_ids(crowns(spark, d), trees(spark, d))


_METRICS = f"""{CROWNS}, {CROWNS2}, j as (select k.id, greatest(least(k.maxx, k2.maxx) - greatest(k.minx, k2.minx), 0) * greatest(least(k.maxy, k2.maxy) - greatest(k.miny, k2.miny), 0) as i,
    k.maxx - k.minx as wa, k.maxy - k.miny as ha, k2.maxx - k2.minx as wb, k2.maxy - k2.miny as hb, (k.minx + k.maxx) / 2 - (k2.minx + k2.maxx) / 2 as dx, (k.miny + k.maxy) / 2 - (k2.miny + k2.maxy) / 2 as dy,
    greatest(k.maxx, k2.maxx) - least(k.minx, k2.minx) as gx, greatest(k.maxy, k2.maxy) - least(k.miny, k2.miny) as gy from k join k2 on k.id = k2.id),
    u as (select *, coalesce(i / nullif(wa * ha + wb * hb - i, 0), 0) as iou, 4 / (pi() * pi()) * pow(atan(wa / nullif(ha, 0)) - atan(wb / nullif(hb, 0)), 2) as v from j),
    m as (select *, iou - coalesce((dx * dx + dy * dy) / nullif(gx * gx + gy * gy, 0), 0) as diou from u)"""


@query(f"with {_METRICS} select id as crown_id, round(iou, 9) as iou, round(2 * i / nullif(wa * ha + wb * hb, 0), 9) as dice, round(diou, 9) as diou, round(case when ha > 0 and hb > 0 then diou - coalesce(v / nullif(1 - iou + v, 0), 0) * v else diou end, 9) as ciou from m")
def similarity(spark, d):
    out = sim.box_metrics(sim.pair_up(crowns(spark, d), crowns(spark, d, True)))
    return out.select("crown_id", *(F.round(c, 9).alias(c) for c in ("iou", "dice", "diou", "ciou")))


@query()
def giou(spark, d):
    return sim.analyze(crowns(spark, d), crowns(spark, d, True))


@query(f"""with {CROWNS}, {TREES}, k0 as (select * from k where id % 4 <> 0), m as (select id, min(t.tree_id) as tree_id from k0 join t on t.x between minx and maxx and t.y between miny and maxy group by id),
    f as (select min(id) as id, tree_id from m group by tree_id)
    select k.id as crown_id, case when k.id % 4 = 0 then 'T' || k.id else coalesce(f.tree_id, 'SYN_20240101_' || k.id) end as tree_id from k left join f on f.id = k.id""")
def reconcile_manual(spark, d):
    c = crowns(spark, d).withColumn("tree_id", F.when(F.col("crown_id") % 4 == 0, F.concat(F.lit("T"), F.col("crown_id").cast("string"))))
    out, _ = store.reconcile_manual(c, trees(spark, d), "20240101")
    return out.select("crown_id", "tree_id")


@query(f"with {TREES} select tree_id, species, 'Alive' as status, x, y, 0.0 as z, 32619 as srid from t")
def load_trees(spark, d):
    return store.load_trees(trees(spark, d), {})


@query(f"""with {CROWNS} select 'T' || id || '_AUT' as crown_id, 'T' || id as tree_id, 'Automated' as crown_category, 'watershed' as generation_method, cast(7 as bigint) as source_lidar_id, cast(null as bigint) as source_image_id, 32619 as srid, minx, miny, maxx, maxy
    from k where id % 5 <> 0""")
def load_crowns(spark, d):
    return store.load_crowns(_typed(spark, d), "Automated", "watershed", 7)


def _typed(spark, d):
    c = crowns(spark, d)
    return c.withColumn("tree_id", F.concat(F.lit("T"), F.col("crown_id").cast("string"))).withColumn("geom_type", F.when(F.col("crown_id") % 5 == 0, "MultiPolygon").otherwise("Polygon"))


@query(f"with {TREES} select tree_id, species, 'Alive' as status, x, y, 32619 as srid from t")
def fetch_trees(spark, d):
    return store.fetch_trees(spark, store.load_trees(trees(spark, d), {}))


@query(f"""with {CROWNS}, {TREES}, {_ASSIGN} select t.tree_id, t.species, a.crown_id, e.event_type as sensor_type from a join t on t.tree_id = a.tree_id join events e on e.event_id = a.crown_id""")
def schema_join(spark, d):
    """Trees, their crowns and the acquisitions these come from."""
    a = vector.assign_tree_ids(crowns(spark, d), trees(spark, d))
    acquired = stream.acquisitions(table(spark, d, "events"))
    return trees(spark, d).select("tree_id", "species").join(a, "tree_id").join(acquired, F.col("crown_id") == F.col("id")).select("tree_id", "species", "crown_id", "sensor_type")


@query("select event_id as image_id, cast(i as int) as band_index, 400.0 + 100.0 * i as wavelength_nm, 'B' || i as band_name from events, range(1, 4) t(i) where event_type = (select min(event_type) from events)")
def register_image_bands(spark, d):
    e = table(spark, d, "events")
    return _bands(e.where(F.col("event_type") == e.agg(F.min("event_type")).scalar()))


def _bands(e):
    images = e.select(F.col("event_id").alias("id"), F.col("ts").alias("acquisition_datetime"))
    band = lambda i: F.struct(i.cast("int").alias("band_index"), (F.lit(400.0) + 100.0 * i).alias("wavelength_nm"), F.concat(F.lit("B"), i.cast("string")).alias("band_name"))
    _, bands = store.register_image(images.withColumn("bands", F.transform(F.sequence(F.lit(1), F.lit(3)), band)))
    return bands


@query("select event_id as image_id, cast(i as int) as band_index, 400.0 + 100.0 * i as wavelength_nm, 'B' || i as band_name from events, range(1, 4) t(i)")
def register_all_bands(spark, d):
    """Bands of every acquisition, whatever its type."""
    return _bands(table(spark, d, "events"))


@query("select event_id as id, try_cast(json_extract_string(case when json_valid(props) then props end, '$.k') as double) as k, json_valid(props) as valid from events")
def json_metrics(spark, d):
    e = table(spark, d, "events").withColumnRenamed("props", "metrics")
    return e.select(F.col("event_id").alias("id"), store.metric(e, "$.k").alias("k"), F.try_parse_json("metrics").isNotNull().alias("valid"))


def _json_oracle() -> str:
    from silvaspark.plans import raster_queries  # noqa: F401  registers zonal_stats

    return f"""select crown_id, med, "max" as mx from ({ORACLES['zonal_stats']})"""


def spectral_metrics_json(spark, d):
    """Statistics per crown as JSON, and two of them read back from it."""
    from silvaspark.plans.raster_queries import zonal_stats

    m = store.metrics_json(zonal_stats(spark, d), 1)
    return m.select("crown_id", store.metric(m, "$.b0001.med").alias("med"), store.metric(m, "$.b0001.max").alias("mx"))


@query("select 'supplier' as child, count(*) as orphans from supplier where s_nationkey not in (select n_nationkey from nation where n_nationkey < 20) union all select 'customer', count(*) from customer where c_nationkey not in (select n_nationkey from nation)")
def foreign_key_check(spark, d):
    n = table(spark, d, "nation")
    a = store.orphans(table(spark, d, "supplier"), "s_nationkey", n.where("n_nationkey < 20"), "n_nationkey").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("supplier").alias("child"), "orphans")
    b = store.orphans(table(spark, d, "customer"), "c_nationkey", n, "n_nationkey").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit("customer").alias("child"), "orphans")
    return a.unionByName(b)


@query("""with c as (select p_partkey as id, case p_partkey % 3 when 0 then 'Manual' when 1 then 'Automated' else 'Other' end as cat, case when p_partkey % 2 = 0 then 'ws' end as m, case when p_partkey % 5 = 0 then 1 end as l from part)
    select id, 'category' as broken from c where cat not in ('Manual', 'Automated') union all select id, 'method' from c where cat = 'Automated' and m is null union all select id, 'lineage' from c where cat <> 'Manual' and l is null""")
def constraint_check(spark, d):
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(k.alias("id"), F.when(k % 3 == 0, "Manual").when(k % 3 == 1, "Automated").otherwise("Other").alias("crown_category"), F.when(k % 2 == 0, "ws").alias("generation_method"), F.when(k % 5 == 0, 1).alias("source_lidar_id"), F.lit(None).cast("bigint").alias("source_image_id"))
    return store.violations(c).select("id", "broken")


@query("select o_custkey as key, count(*) as n from orders group by 1 having count(*) > 1")
def unique_check(spark, d):
    return store.duplicates(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key")


@query(f"with {TREES} select tree_id, round(radians(x) * 6378137, 4) as x, round(ln(tan(pi() / 4 + radians(y / 100) / 2)) * 6378137, 4) + 0.0 as y from t where y < 8000")
def to_crs_3857(spark, d):
    t = trees(spark, d).where("y < 8000").select("tree_id", F.col("x").alias("lon"), (F.col("y") / 100).alias("lat"))
    return vector.to_web_mercator(t).select("tree_id", F.round("x", 4).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(f"with {TREES} select tree_id, round(radians(x) * 6378137, 4) as x, round(ln(tan(pi() / 4 + radians(y % 8000 / 100) / 2)) * 6378137, 4) + 0.0 as y from t")
def to_crs_3857_all(spark, d):
    """Every tree, at a latitude below 80 degrees whatever its key."""
    t = trees(spark, d).select("tree_id", F.col("x").alias("lon"), (F.col("y") % 8000 / 100).alias("lat"))
    return vector.to_web_mercator(t).select("tree_id", F.round("x", 4).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query()
def validate_geoms(spark, d):
    """Crowns as polygons, every third a bow-tie that is repaired and every seventh without area that is dropped."""
    from pyspark.sql.types import BinaryType

    from silvaspark.functions import geometry

    @F.pandas_udf(BinaryType())
    def shape(k, x0, y0, x1, y1):
        ring = lambda i, a, b, c, e: [(a, b), (c, e), (c, b), (a, e), (a, b)] if i % 3 == 0 else [(a, b), (c, b), (a, b), (c, b), (a, b)] if i % 7 == 0 else [(a, b), (c, b), (c, e), (a, e), (a, b)]
        import pandas as pd

        return pd.Series([geometry.to_wkb((3, [ring(*r)])) for r in zip(k, x0, y0, x1, y1, strict=True)])

    c = crowns(spark, d)
    return vector.validate(c.select("crown_id", shape("crown_id", "minx", "miny", "maxx", "maxy").alias("geom"))).select("crown_id", F.length("geom").alias("bytes"))


@query()
def ewkb_points(spark, d):
    """Trees as extended WKB in hexadecimal, as a spatial database takes them."""
    return store.point_wkb(vector.force_z(trees(spark, d), 3), z="z", srid=32619).select("tree_id", F.hex("geom").alias("geom"))


@query("select date_trunc('hour', ts) as window_start, event_type as sensor_type, count(*) as n from events group by 1, 2")
def stream_acquisitions(spark, d):
    return stream.counts(stream.acquisitions(table(spark, d, "events")))


query(_json_oracle())(spectral_metrics_json)
