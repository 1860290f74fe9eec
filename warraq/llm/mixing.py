"""Records of several sources mixed to target shares of all tokens.

Pfair scheduling: the k-th block of a source with share w is released at floor((k-1)/w) and due at
ceil(k/w); serving the earliest deadline first interleaves the sources so that none ever departs
from its share by a whole block. Blocks are then filled with the source's records, which pass by as
often as their cap allows.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warraq.session import checkpoint

#: Unless a block's size is given: blocks in the schedule at most, and tokens in a block at least.
SLOTS = 20_000
LEAST_BLOCK = 512
ROWS_PER_BUCKET = 20_000


def pfair(shares: dict[str, float], slots: int) -> list[str]:
    """The source served in each slot; shares sum to 1. Ties in deadline go to the larger share, then by name."""
    weight = {s: Fraction(w).limit_denominator(10**9) for s, w in shares.items() if w > 0}
    total = sum(weight.values())
    weight = {s: w / total for s, w in weight.items()}
    release = lambda s, k: math.floor((k - 1) / weight[s])
    due = lambda s, k: math.ceil(k / weight[s])
    waiting = [(0, s, 1) for s in sorted(weight)]
    heapq.heapify(waiting)
    ready: list[tuple[int, Fraction, str, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), -weight[s], s, k))
        if not ready:
            break
        _, _, s, k = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, (max(t + 1, release(s, k + 1)), s, k + 1))
    return out


class Mix:
    """The chosen records, the schedule and the shares reached.

    ``records`` holds (key, source, tokens), ``targets`` (source, target_share, max_repeats). Sources
    without a target, with a null source, or without tokens cannot take part; the shares of targets
    without records are spread over the others in proportion, and reported. Unless ``total`` is given,
    the mix is as large as the scarcest source allows when used to its cap.

    ``block`` is the number of tokens served at a time: no source departs from its share by more. Without it the
    total is cut into at most ``slots`` blocks of at least ``LEAST_BLOCK`` tokens, so that the schedule, which is
    made on the driver, has a bounded length; the last block may be a part.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", tokens: str = "tokens", total: int | None = None, slots: int = SLOTS, block: int | None = None):
        self.key = key
        rec = records.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"), F.col(tokens).cast("long").alias("tokens"))
        rec = checkpoint(rec.where("source is not null and tokens > 0"))
        want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null and target_share > 0 and max_repeats >= 1").collect()}
        self.want = want
        named = rec.where(F.col("source").isin(list(want)))
        supply = {r["source"]: (r["n"], r["rows"]) for r in named.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")).collect()}
        self.supply = supply
        live = {s: want[s][0] for s in want if s in supply}
        whole = sum(live.values())
        shares = {s: w / whole for s, w in live.items()}
        cap = min((supply[s][0] * want[s][1] / w for s, w in shares.items()), default=0)
        self.total = int(min(cap, total) if total is not None else cap)
        self.block = block or max(LEAST_BLOCK, -(-self.total // slots))
        self.schedule = pfair(shares, -(-self.total // self.block)) if shares else []
        blocks: dict[str, list[int]] = {}
        for slot, s in enumerate(self.schedule):
            blocks.setdefault(s, []).append(slot)
        self.blocks = blocks
        spark = records.sparkSession
        room = {s: len(blocks.get(s, ())) * self.block for s in live}
        if self.schedule:
            room[self.schedule[-1]] -= -self.total % self.block
        quota = [(s, want[s][0], want[s][1], supply[s][0], -(-supply[s][1] // ROWS_PER_BUCKET), room[s]) for s in live]
        self.quota = spark.createDataFrame(quota, "source string, target_share double, max_repeats int, supply long, buckets long, quota long")
        self.slots = spark.createDataFrame(list(blocks.items()), "source string, at array<int>")
        self.chosen = self._choose(named)

    def _before(self, rows: DataFrame) -> DataFrame:
        """The rows with ``_before``: tokens of their source's rows that precede them in hashed order.

        Running sums are taken within buckets of bounded size and then over the buckets of a source, so
        that no task sees a whole source.
        """
        r = rows.withColumn("_bucket", F.pmod(F.shiftright("_order", 20), F.col("buckets")))
        sums = r.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
        earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
        within = Window.partitionBy("source", "_bucket").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
        r = r.withColumn("_in", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(sums.hint("shuffle_hash"), ["source", "_bucket"])
        return r.withColumn("_before", F.col("_base") + F.col("_in")).drop("_bucket", "_base", "_in")

    def _choose(self, named: DataFrame) -> DataFrame:
        """Every record passes as often as the quota holds its whole source; then some pass once more.

        Those are taken in hashed order as long as they fit; what room is left goes to later records
        that still fit, until none does.
        """
        rows = named.join(F.broadcast(self.quota), "source").withColumn("_row", F.monotonically_increasing_id())
        rows = rows.withColumn("_order", F.xxhash64("_key", "_row"))
        rounds = F.least(F.col("max_repeats").cast("long"), F.floor(F.col("quota") / F.col("supply")))
        rows = checkpoint(self._before(rows.withColumn("_full", rounds)).withColumnRenamed("_before", "_place"))
        open_ = rows.where("_full < max_repeats").select("_row", "_order", "source", "buckets", "tokens")
        gap = {r["source"]: r["quota"] - min(r["max_repeats"], r["quota"] // r["supply"]) * r["supply"] for r in self.quota.collect() if r["quota"] // r["supply"] < r["max_repeats"]}
        spark, extra = rows.sparkSession, None
        done = dict.fromkeys(gap, 0)
        while True:
            gap = {s: g for s, g in gap.items() if g > 0}
            if not gap:
                break
            gaps = spark.createDataFrame([(s, g, done[s]) for s, g in gap.items()], "source string, gap long, done long")
            fits = open_.join(F.broadcast(gaps), "source").where("tokens <= gap")
            if extra is not None:
                fits = fits.join(extra.select("_row").hint("merge"), "_row", "left_anti")
            more = checkpoint(self._before(fits).where("_before + tokens <= gap").select("_row", "source", "tokens", (F.col("done") + F.col("_before")).alias("_extra_place")))
            taken = more.groupBy("source").agg(F.sum("tokens").alias("n")).collect()
            gap = {r["source"]: gap[r["source"]] - r["n"] for r in taken}  # where nothing was taken, nothing fits
            for r in taken:
                done[r["source"]] += r["n"]
            extra = more if extra is None else extra.unionByName(more)
        if extra is None:
            out = rows.withColumn("_extra_place", F.lit(None).cast("long"))
        else:
            out = rows.join(extra.select("_row", "_extra_place").hint("merge"), "_row", "left")
        full = F.when(F.col("_full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1), lambda r: F.col("_place") + r * F.col("supply"))).otherwise(F.array().cast("array<long>"))
        last = F.when(F.col("_extra_place").isNotNull(), F.array(F.col("_full") * F.col("supply") + F.col("_extra_place"))).otherwise(F.array().cast("array<long>"))
        out = out.withColumn("places", F.concat(full, last)).withColumn("uses", F.size("places"))
        return out.select("_key", "source", "tokens", "uses", "places").where("uses > 0")

    def records(self) -> DataFrame:
        """(key, source, tokens, uses, slots): the places of a record's uses in the schedule, in order."""
        block = lambda p: F.floor(p / F.lit(self.block)).cast("int")
        slots = F.transform("places", lambda p: F.get("at", block(p))).alias("slots")
        return self.chosen.join(F.broadcast(self.slots), "source").select(F.col("_key").alias(self.key), "source", "tokens", "uses", slots)

    def shares(self) -> DataFrame:
        """(source, target_share, available, tokens, reached_share, records, most_uses) for every target."""
        spark = self.chosen.sparkSession
        targets = spark.createDataFrame([(s, w, self.supply.get(s, (0, 0))[0]) for s, (w, _) in self.want.items()], "source string, target_share double, available long")
        got = self.chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
        out = targets.join(got, "source", "left").na.fill(0, ["tokens", "records", "most_uses"])
        total = F.sum("tokens").over(Window.partitionBy())
        return out.withColumn("reached_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
