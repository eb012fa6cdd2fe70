"""Links between the members of buckets: every pair that meets is decided.

First each member is compared with its bucket's centre, the member that meets most others,
and with the member before it in the bucket's order (two pairs a member); verified links
make components, so a large group of near copies is one from then on.  Members of buckets
that still hold several components then meet by prefixes, which lose no pair: with the
elements of each set in one order, rare ones first, two sets of at least the threshold's
Jaccard similarity share one of the first n - ceil(threshold * n) + 1, with enough elements
left behind it in both, and enough of the first ones in common.  Each pair is verified once,
however many buckets it shares.  Where many sets nearly at the threshold share their
prefixes, the pairs are as many as there are; none are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import dropped, written
from quillframe.llm.components import components


def shared_buckets(met: DataFrame) -> DataFrame:
    """(bucket, pid, size) of the rows of met (bucket, pid) whose bucket has another pid as well; repeated rows are one."""
    whole = Window.partitionBy("bucket")
    again = F.lag("pid").over(whole.orderBy("pid"))
    once = met.select("bucket", "pid").withColumn("again", again).where("again IS NULL OR again <> pid")
    return once.withColumn("size", F.count("*").over(whole)).where("size > 1").select("bucket", "pid", "size")


def linked(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the pids that have links.

    met has (bucket, pid, size), no pair twice; sets has (pid, sh) of all its pids.  Pids
    that share a bucket and whose sets are similar by the threshold are linked.
    """
    degree = met.groupBy("pid").agg(F.sum("size").alias("degree"))
    order = Window.partitionBy("bucket").orderBy(F.desc("degree"), "pid")
    others = F.array(F.first("pid").over(order), F.lag("pid").over(order))
    near = met.select("bucket", "pid").join(degree, "pid").select("pid", others.alias("o")).select("pid", F.explode("o").alias("other")).where("pid <> other")
    tried = written(near.select(F.least("pid", "other").alias("u"), F.greatest("pid", "other").alias("v")).distinct(), "pairs")
    links = written(similar(tried, sets, threshold), "links")
    parts = components(links)
    found = written(parts, "components")
    # in a bucket of three all pairs were tried
    named = met.where("size > 3").select("bucket", "pid").join(found.withColumnRenamed("node", "pid"), "pid", "left").withColumn("c", F.coalesce("component", "pid"))
    rest = written(apart(named.select("bucket", "pid", "c")).select("pid", "c").distinct(), "apart")
    each = written(rest.join(sets, "pid").select("pid", "c", F.size("sh").alias("n"), F.explode("sh").alias("e")), "elements")
    fresh = written(_pairs(apart(_prefixes(each, threshold)), threshold).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    more = written(similar(fresh, sets, threshold), "links")
    out = found if more.isEmpty() else joined(found, more)
    for table in (tried, links, parts, rest, each, fresh, more, *([] if out is found else [found])):
        dropped(table)
    return out


def apart(rows: DataFrame) -> DataFrame:
    """The rows (bucket, pid, c, ...) of buckets that hold several components c."""
    whole = Window.partitionBy("bucket")
    return rows.withColumn("a_", F.min("c").over(whole)).withColumn("b_", F.max("c").over(whole)).where("a_ <> b_").drop("a_", "b_")


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """All (u, v), u < v, in different components that can be similar, each from the first element that both have.

    Of a set's first m elements all that stand no later than the other's last one are in
    the other's first ones too, or not in it at all.  So the set of the earlier end shares as
    many of them as both lists do, and at most all of its others.
    """
    a, b = rows.alias("a"), rows.alias("b")
    wanted = threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-6
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.pid") < F.col("b.pid")) & (F.col("a.c") != F.col("b.c"))
    # from the first shared element on, enough must be left of both sets
    meet &= F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) + 1 >= wanted
    shared = F.array_intersect("a.firsts", "b.firsts")
    rest = F.when(F.col("a.last") <= F.col("b.last"), F.col("a.n") - F.col("a.m")).otherwise(F.col("b.n") - F.col("b.m"))
    meet &= (F.size(shared) + rest >= wanted) & (F.array_min(shared) == F.col("a.bucket"))
    return a.join(b, meet).select(F.col("a.pid").alias("u"), F.col("b.pid").alias("v"))


def _prefixes(each: DataFrame, threshold: float) -> DataFrame:
    """(bucket, pid, c, n, place, m, firsts, last): each element of the prefix of each set as a bucket, its place there,
    the set's size, those of its first m elements that other sets have as well, and the last of the m.

    each has (pid, c, n, e), a row for each element e.  An element is named by how many sets have it and 43 bits of its
    hash, so its name is its place in the order.
    """
    often = each.groupBy("e").agg(F.count("*").alias("often")).where("often > 1")
    name = F.shiftleft(F.least(F.coalesce("often", F.lit(1)), F.lit((1 << 20) - 1)), 43).bitwiseOR(F.col("e").bitwiseAND(F.lit((1 << 43) - 1)))
    named = each.join(often, "e", "left").select("pid", "c", "n", name.alias("bucket"))
    ranked = named.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy("bucket")))
    # a little under the threshold, so that rounding cannot shorten a prefix; twice the prefix tells how much two sets share
    prefix = F.col("n") - F.ceil((threshold - 1e-9) * F.col("n")) + 1
    most = F.least("n", 2 * prefix)
    known = F.col("bucket") >= F.lit(2 << 43)
    lists = ranked.where(F.col("place") <= most).groupBy("pid", "c", "n").agg(
        F.array_sort(F.collect_list(F.when(known, F.struct("bucket", "place")))).alias("firsts"), F.max("bucket").alias("last"), F.count("*").alias("m")
    )
    firsts = lists.select("pid", "c", "n", "m", "last", F.col("firsts.bucket").alias("firsts"), F.explode("firsts").alias("f"))
    return firsts.where(F.col("f.place") <= prefix).select(F.col("f.bucket").alias("bucket"), "pid", "c", "n", F.col("f.place").alias("place"), "m", "firsts", "last")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components found (node, component) after more links (u, v), written: only components are linked anew."""
    of = found.select("node", "component")
    ends = links.join(of.withColumnRenamed("node", "u").withColumnRenamed("component", "a"), "u", "left").join(of.withColumnRenamed("node", "v").withColumnRenamed("component", "b"), "v", "left")
    between = written(ends.select("u", "v", F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b")), "between")
    parts = components(between.select(F.col("a").alias("u"), F.col("b").alias("v")))
    moved = parts.select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = between.select(F.col("u").alias("node"), F.col("a").alias("component")).unionByName(between.select(F.col("v").alias("node"), F.col("b").alias("component")))
    every = found.unionByName(new).distinct()
    out = written(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")
    for table in (between, parts):
        dropped(table)
    return out


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose sets (pid, sh) have at least the threshold's exact Jaccard similarity."""
    a, b = sets.select(F.col("pid").alias("u"), F.col("sh").alias("a")), sets.select(F.col("pid").alias("v"), F.col("sh").alias("b"))
    both = pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("a", "b")).cast("double"))
    return both.where(F.col("shared") >= threshold * (F.size("a") + F.size("b") - F.col("shared"))).select("u", "v")
