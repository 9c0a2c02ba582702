"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Slot n of the schedule is the point frac(n * golden ratio), which a table of cumulative target shares maps to a source;
a source's slots are ranked in order. Each source's documents, shuffled by a hash, are laid end to end and cut into
blocks of equally many words; its k-th slot takes its k-th block, going round again for a second pass. The slot in
which a source reaches its target is cut there, and a source that the schedule left short gets its missing ranks after
the last slot, so each source's words are its rounded target exactly.

Running sums and ranks are taken in three levels (within small buckets, over the totals of some buckets, over theirs):
no source, however large, is gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvaspark.llm.common import stored
from silvaspark.llm.native import word_count

GOLDEN = 2654435769  # 2**32 / golden ratio, odd
CIRCLE = 1 << 32
BINS = 4096
RUN = 4096  # slots that are ranked together
GROUP = 512  # documents that are summed together, about
TOP = 7  # bits of a bucket's number within the buckets that are summed together


def targets(sizes: DataFrame, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0) -> DataFrame:
    """One row per source of ``source, source_size``: its number, weight and target words.

    ``ratio`` times all words are shared by weight; no source gets over ``most`` times its size, and what that leaves
    is shared again among the rest. In order of size per weight the capped sources come first, so the level that the
    rest get per weight follows from running sums. A row per source: their number bounds the one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total", ratio * F.sum("source_size").over(whole))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / F.sum("weight").over(after))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))
    s = s.withColumn("first", F.min(open_).over(whole))
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first.level") * F.col("weight")))
    return s.select("source", "source_size", "sid", "weight", target.alias("target"), "total")


def _before(parts: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``sid, by, name``: what the parts ``sid, by, value`` of a source sum to in front of each, by running sums in two levels."""
    parts = parts.withColumn("top", F.shiftright(by, TOP))
    up = Window.partitionBy("sid").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy("sid", "top").agg(F.sum(value).alias("s")).select("sid", "top", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("above"))
    near = Window.partitionBy("sid", "top").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.select("sid", "top", by, F.coalesce(F.sum(value).over(near), F.lit(0)).alias("inside"))
    return inside.join(tops, ["sid", "top"]).select("sid", by, (F.col("inside") + F.col("above")).alias(name))


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, order``: what the schedule needs of each document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"))


def _placed(sized: DataFrame, sources: DataFrame, n_docs: int) -> DataFrame:
    """Documents with ``start``, the words of their source before them in shuffled order."""
    groups = 1 << min(28, max(0, math.ceil(math.log2(max(1, n_docs) / GROUP))))
    bucket = F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * groups / (1 << 28)).cast("long")
    same = sized["source"].eqNullSafe(sources["source"])
    docs = sized.join(sources, same).select("doc_id", "size", "order", "sid", "source_size", "target").withColumn("bucket", bucket)
    sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    base = _before(sums, "bucket", "words", "base")
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size")
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("nth", F.row_number().over(inside)).withColumn("start", F.coalesce(F.sum("size").over(prior), F.lit(0)))
    return docs.join(base, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("base", "order")


def _slots(sources: DataFrame, total: float, block: int) -> DataFrame:
    """``slot, sid, block, take``: which block each slot of the schedule takes, and how many of its words."""
    spark = sources.sparkSession
    n = math.ceil(total / block)
    running = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.withColumn("b", F.sum("target").over(running) / F.sum("target").over(Window.partitionBy()) * CIRCLE).withColumn("a", F.coalesce(F.lag("b").over(Window.orderBy("sid")), F.lit(0.0)))
    arcs = shares.where("b > a").select("sid", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / (CIRCLE // BINS)), F.least(F.floor(F.col("b") / (CIRCLE // BINS)), F.lit(BINS - 1)))).alias("bin"))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(CIRCLE // 2)) * F.lit(GOLDEN), F.lit(CIRCLE)).alias("u"))
    slots = slots.withColumn("bin", F.shiftright("u", 20)).join(arcs, "bin").where("u >= a and u < b").select("slot", "sid", F.shiftright("slot", 12).alias("run"))
    counts = slots.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    base = _before(counts, "run", "n", "base")
    rank = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1 + F.col("base")
    ranked = slots.join(base, ["sid", "run"]).select("slot", "sid", rank.alias("k"))
    # ranks that the schedule did not reach, in front of each source's target
    blocks = F.ceil(F.col("source_size") / block)
    need = F.when(F.col("goal") <= F.col("source_size"), F.ceil(F.col("goal") / block)).otherwise(blocks + F.ceil((F.col("goal") - F.col("source_size")) / block))
    goals = sources.select("sid", "source_size", F.round("target").cast("long").alias("goal")).withColumn("blocks", blocks).withColumn("need", need)
    reached = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    short = goals.join(reached, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    rest = short.select((F.lit(n) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence("n", F.col("need") - 1)).alias("k"))
    all_ = ranked.unionByName(rest).join(goals, "sid").where("k < need")
    block_no, pass_no = F.pmod("k", "blocks"), F.floor(F.col("k") / F.col("blocks"))
    used = pass_no * F.col("source_size") + block_no * block
    length = F.least(F.lit(block), F.col("source_size") - block_no * block)
    return all_.select("slot", "sid", block_no.alias("block"), F.least(length, F.col("goal") - used).alias("take")).where("take > 0")


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The schedule of the mix, and its sum per document.

    First frame, the stream: ``slot, sid, doc_id, first, words`` (which words of a document a slot takes). Second, one
    row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``. Null texts have 0 words and are
    never taken; a null source is a source, the last; null and repeated doc_ids are rows of their own; an empty table
    gives no rows; columns other than doc_id, text and source are not read.
    """
    sized = stored(_numbered(docs), "mix-sizes")
    n_docs = sized.count()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(sizes, ratio, weights, most), "mix-sources")
    total = (sources.agg(F.sum("target")).first()[0]) or 0.0
    placed = stored(_placed(sized, sources, n_docs), "mix-placed")
    last = F.floor(F.greatest(F.col("start"), F.col("start") + F.col("size") - 1) / block)
    pieces = placed.select("sid", "bucket", "nth", "doc_id", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block"))
    at = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("*", at.alias("at"), end.alias("end"))
    got = pieces.join(_slots(sources, total, block), ["sid", "block"], "left")
    words = F.greatest(F.lit(0), F.least("end", F.coalesce("take", F.lit(0))) - F.col("at"))
    got = got.withColumn("words", F.when(F.col("size") > 0, words).otherwise(F.lit(0)))
    stream = got.where("words > 0").select("slot", "sid", "doc_id", (F.col("block") * block + F.col("at") - F.col("start")).alias("first"), "words")
    taken = got.groupBy("sid", "bucket", "nth").agg(F.sum("words").alias("taken"))
    per_doc = placed.join(taken, ["sid", "bucket", "nth"]).join(sources.select("sid", "source"), "sid")
    return stream, per_doc.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: float = 2.0, block: int = 1024) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns as they are, each as often as it is taken.

    A document counts as taken once for each of its passes that is taken by half or more; texts without words are not.
    A source's stream is cut in shuffled order, so what each document gets follows from how far each pass went: a row a
    source, joined to the documents without moving these.
    """
    _, per_doc = mix(docs, ratio, weights, most, block)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    got = per_doc.where("size > 0").select("source", order.alias("o"), times.alias("times"))
    cuts = stored(got.groupBy("source").agg(*(F.max(F.when(F.col("times") >= k, F.col("o"))).alias(f"pass{k}") for k in range(1, int(most) + 1))).withColumnRenamed("source", "cut_source"), "mix-cuts")
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), order.alias("o"), F.col("source").cast("string").alias("s"), (word_count(F.col("text")) > 0).alias("full"))
    joined = row.join(cuts, F.col("s").eqNullSafe(F.col("cut_source"))).where("full")
    passes = F.filter(F.array(*(F.when(F.col("o") <= F.col(f"pass{k}"), F.lit(k)) for k in range(1, int(most) + 1))), lambda x: x.isNotNull())
    return joined.select("row", F.explode(passes).alias("pass")).select(*(F.col("row").getField(n).alias(n) for n in names))


#: The same sums in closed form: a source's stream is its shuffled documents twice in a row, cut at its target.
MIX_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as o from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as sid from d group by source),
w as (select *, 2.0 * source_size as cap, case (sid - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
    1.5 * sum(source_size) over () as total from s),
l as (select *, (total - coalesce(sum(cap) over (order by cap / weight, sid rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, sid rows between current row and unbounded following) as level from w),
f as (select min_by(level, cap / weight) as level from l where level * weight < cap),
t as (select l.source, l.source_size, cast(least(l.cap, coalesce(f.level * l.weight, l.cap)) as double) as target from l, f),
p as (select d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) over (partition by d.source order by d.o, d.doc_id, d.size
    rows between unbounded preceding and 1 preceding), 0) as start from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(greatest(0, least(size, round(target) - start))
    + greatest(0, least(size, round(target) - source_size - start)) as bigint) as taken from p
"""
