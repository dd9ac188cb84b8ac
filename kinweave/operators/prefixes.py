"""Candidates of a threshold join over several sets of features, by an inverted index of each element's rare ones.

A pair may miss ``limit`` of what its measures weigh. Each feature is given the most that sharing it can bring: the measure's weight by the number of the
element's own values where sets are compared, and the whole weight, once, where a single shared value could bring it all. Features are ordered by
the number of pairs they would make, the same way on both sides. If the first feature that two elements share stands where an element's later features together
can't bring what is needed, the pair misses the limit. So each element is filed only under the features before that place, and no acceptable pair is lost.
Features that only one side has are no keys and bring nothing. An element without any value of a sort shares that with all like it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to what is compared, as sums are rounded.
SLACK = 1e-6


def features(elements: DataFrame, values: DataFrame, weights: dict[str, float], whole: frozenset[str] = frozenset()) -> DataFrame:
    """(id, key, gain, all) of ``elements`` (id) from ``values`` (id, sort, value): one row for each value, or one for a sort without any.

    ``weights`` are those of the sorts; one value of a sort in ``whole`` may bring its weight at once. A null value is counted, but is shared with nothing.
    """
    weight = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))])
    sorts = F.explode(F.array(*[F.lit(s) for s in weights]))
    own = values.where(F.col("sort").isin(*weights)).select("id", "sort", "value").distinct().withColumn("_has", F.lit(True))
    rows = elements.select("id").withColumn("sort", sorts).join(own, ["id", "sort"], "left")
    rows = rows.withColumns({"n": F.count("_has").over(Window.partitionBy("id", "sort")), "all": F.col("sort").isin(*whole) if whole else F.lit(False)})
    key = F.when(F.col("_has").isNull(), F.col("sort")).otherwise(F.concat("sort", F.lit("\0"), "value"))
    gain = weight[F.col("sort")] / F.when(F.col("all"), 1).otherwise(F.greatest("n", F.lit(1)))
    return rows.select("id", key.alias("key"), gain.alias("gain"), "all").where("key IS NOT NULL")


def indexed(left: DataFrame, right: DataFrame, need: float) -> tuple[DataFrame, DataFrame]:
    """(id, key, reach) of both sides' ``features``: where an element is filed, and the most that its features from there on can bring.

    If nothing is needed, elements are filed under the empty key too, as any two may be a pair.
    """
    counts = [rows.groupBy("key").agg(F.count("*").alias(n)) for rows, n in ((left, "_l"), (right, "_r"))]
    common = counts[0].join(counts[1], "key").select("key", (F.col("_l") * F.col("_r")).alias("pairs"))
    onward = Window.partitionBy("id").orderBy(F.desc("pairs"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.coalesce(F.sum(F.when(~F.col("all"), F.col("gain"))).over(onward), F.lit(0.0))
    out = []
    for rows in (left, right):
        known = rows.join(common, "key")
        # sorts that bring all their weight at once count once each
        single = known.withColumn("sort", F.when(F.col("all"), F.substring_index("key", "\0", 1)))
        once = F.row_number().over(Window.partitionBy("id", "sort").orderBy(F.desc("pairs"), F.desc("key"))) == 1
        known = single.withColumn("_once", F.when(F.col("all") & once, F.col("gain")).otherwise(0.0))
        found = known.select("id", "key", (reach + F.sum("_once").over(onward)).alias("reach"))
        if need <= SLACK:
            found = found.unionByName(rows.select("id").distinct().select("id", F.lit("").alias("key"), F.lit(0.0).alias("reach")))
        out.append(found.where(F.col("reach") >= need - SLACK))
    return out[0], out[1]
