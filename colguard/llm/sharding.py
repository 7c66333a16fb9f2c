"""Sharding by balanced label propagation.

Documents with equal texts are linked (each text is a hub, so a group of n copies has n links, not n * n / 2).
A document starts in the shard that a hash of its id names. In each round every group looks at the shards that
hold most of it; its documents elsewhere want to go there, a group larger than a shard to as many shards as it
fills. Requests between each two shards are summed (shards * shards numbers), and a quota for each pair is set
from what goes the other way plus free room; a hash of the group decides which requests fit in the quota, so
that a group moves together. Documents of one group and one first shard always move together, so rounds work on
those cells with their counts. Documents without links fill the room that is left. The last step lays all
documents in order of their shard and cuts that order into even pieces: law `rows`, counts at most one apart.
A boundary shifts by no more than the quotas are off, and between shards stand documents without links.

Cases: a null text has size 16, a null checksum and no link; repeated rows are linked like copies; fewer
documents than shards leave shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colguard.llm.common import Scratch, running


def _unit(*cols: Column) -> Column:
    """0 to 1, from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def _quotas(wish: dict[tuple[int, int], int], load: list[int], cap: int) -> dict[tuple[int, int], float]:
    """For each pair of shards the share of its requests that is granted."""
    into = [sum(n for (_, b), n in wish.items() if b == t) for t in range(len(load))]
    out = {}
    for (a, b), n in wish.items():
        room = max(0, cap - load[b]) * n / into[b] if into[b] else 0
        out[a, b] = min(1.0, (min(n, wish.get((b, a), 0)) + room) / n)
    return out


def assign(docs: DataFrame, shards: int = 40, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the text's hash `linked`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.col("text").cast("string")
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("g"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(shards)).cast("int").alias("home"),
    )
    base = scratch.put(base, "base")
    n = base.count()
    cap = -(-n // shards)
    cells = base.where("g IS NOT NULL").groupBy("g", "home").agg(F.count("*").alias("c"))
    cells = cells.withColumn("n", F.sum("c").over(Window.partitionBy("g"))).where("n > 1").withColumn("label", F.col("home"))
    cells = scratch.put(cells, "cells")
    for r in range(rounds):
        held = cells.groupBy("g", "label").agg(F.sum("c").alias("w"), F.first("n").alias("n"))
        order = Window.partitionBy("g").orderBy(F.desc("w"), F.xxhash64("g", "label"), "label")
        hosts = F.ceil(F.col("n") / F.lit(max(1.0, cap * 0.9))).cast("int")  # shards that the group fills
        ranked = held.withColumn("k", F.row_number().over(order)).withColumn("hosts", F.least(hosts, F.lit(shards)))
        hosting = F.collect_list(F.when(F.col("k") <= F.col("hosts"), F.col("label"))).over(Window.partitionBy("g"))  # at most `shards` labels
        wants = ranked.withColumn("hosting", hosting)
        wants = wants.select("g", "label", F.when(F.col("k") <= F.col("hosts"), F.col("label")).otherwise(F.get("hosting", F.pmod(F.xxhash64("g", "label"), F.size("hosting")).cast("int"))).alias("to"))
        asked = scratch.put(cells.join(wants.hint("merge"), ["g", "label"]), f"asked{r}")
        sums = asked.groupBy("label", "to").agg(F.sum("c").alias("c")).collect()  # shards * shards rows at most
        load, wish = [0] * shards, {}
        for x in sums:
            load[x["label"]] += x["c"]
            if x["label"] != x["to"]:
                wish[x["label"], x["to"]] = x["c"]
        if not wish:
            scratch.drop(asked)
            break
        granted = _quotas(wish, load, cap)
        share = F.create_map(*[y for (a, b), q in granted.items() for y in (F.lit(a * shards + b), F.lit(q))])
        go = F.coalesce(F.element_at(share, F.col("label") * shards + F.col("to")), F.lit(0.0))
        moved = asked.withColumn("label", F.when(_unit(F.col("g"), F.lit(r)) < go, F.col("to")).otherwise(F.col("label"))).drop("to")
        new = scratch.put(moved, f"cells{r}")
        scratch.drop(asked, cells)
        cells = new
    load = [0] * shards
    for x in cells.groupBy("label").agg(F.sum("c").alias("c")).collect():  # one row for each shard
        load[x["label"]] = x["c"]
    room = [max(0, cap - x) for x in load]
    total, at, steps = sum(room) or 1, 0, []
    for x in room:
        at += x
        steps.append(at / total)
    u = _unit(F.col("doc_id"), F.lit(12))
    alone = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        alone = F.when(u < steps[s], F.lit(s)).otherwise(alone)
    named = cells.select(F.col("g").alias("__g"), F.col("home").alias("__home"), "label")
    linked = base.where("g IS NOT NULL")  # a group lies in up to `shards` cells, so no key holds all of it
    linked = linked.join(named.hint("merge"), (linked["g"] == named["__g"]) & (linked["home"] == named["__home"]), "left").drop("__g", "__home", "home")
    rows = linked.unionByName(base.where("g IS NULL").drop("home").withColumn("label", F.lit(None).cast("int")))
    zone = F.when(F.col("label").isNotNull(), 1).otherwise(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(2)) * 2)  # free documents at both ends
    rows = rows.withColumn("at", F.coalesce(F.col("label"), alone)).withColumn("zone", zone.cast("int"))
    placed = running(scratch, rows, [F.col("at"), F.col("zone"), F.col("g"), F.col("doc_id")], {"rank": F.lit(1).cast("long")})
    shard = F.expr(f"rank * {shards} div {max(1, n)}")
    out = placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"rank - (shard * {n}L + {shards - 1}) div {shards}"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), F.hex("g").alias("linked"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
