"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; together they share the words of all
documents. A source's target stops at `most` times its own words; what is cut off goes to the others by weight
(water level: one factor for all sources that are not cut off). A source with target t and size s takes every
document floor(t / s) times; the rest, r words, is a sample without replacement whose inclusion probabilities are in
proportion to the document's words (rounded down to seven binary digits): p = min(1, factor * words), the factor such
that the expected words are r. Documents with p = 1 are certain, one more whole copy each. The others are ranked by
their odds (u / (1 - u)) / (p / (1 - p)), with u from a hash of the document, and the first are taken until the
words of the source reach r; the one at the edge goes in if that brings the words nearer to r. So the sample has a
fixed size in words, and a document's share over many seeds is about its p.

The order is never sorted as a whole: sums over BINS equal steps of the rank find each source's bin with the edge, that
bin is cut into BINS again, until no source has more than LIMIT documents in its bin; only those are put in order.
Tables with a row for each source are made by aggregation and by running sums, range-partitioned above SOURCES rows.

Cases: a null or empty text has size 0 and is never taken; documents equal in doc_id and text are numbered, and each
number draws on its own; a null source is a source of its own; an empty table gives an empty result; very long texts
count whole; other columns pass (mixed_documents) or are not read (mix). Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colguard.llm.common import WORD, Scratch, running

BINS, LIMIT = 1024, 100_000
#: Repeated keys that are broadcast; above that they are joined by merge
BROADCAST = 500_000
#: Sources whose sums one task makes
SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _dice(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(doc_id, text, F.lit(seed))


def _size_class(size: Column) -> Column:
    """The size rounded down to seven binary digits: at most 64 classes for each doubling."""
    spare = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return F.floor(size / F.pow(F.lit(2.0), spare)).cast("long") * F.pow(F.lit(2.0), spare).cast("long")


def inclusion(g: Column, factor: Column, certain: Column) -> Column:
    """Probability of a document of size class g to be in the sample: 1 above the class `certain`."""
    return F.when(g > certain, 1.0).otherwise(F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-300), factor * g)))


def _rank(g: Column, dice: Column, factor: Column, certain: Column) -> Column:
    """The Pareto rank q carried to q / (1 + q), so that it lies in 0 to 1."""
    u = (F.shiftrightunsigned(dice, 11).cast("double") + 0.5) / float(1 << 53)
    p = inclusion(g, factor, certain)
    q = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p < 1, F.when(q < 1e300, q / (1 + q)).otherwise(1.0))


def _sums_before(scratch: Scratch, df: DataFrame, few: bool, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Sums over the rows before each: in one task for at most SOURCES rows, else by ranges in many."""
    if not few:
        return running(scratch, df, order, sums)
    before = Window.orderBy(*[c.asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(k) for k, c in sums.items()])


def targets(sizes: DataFrame, scratch: Scratch, most: int = 3) -> DataFrame:
    """sizes (source, source_size) -> with target, copies (whole copies of every document) and rest (words)."""
    named = [F.col("source").isNull(), F.col("source")]
    sizes = scratch.put(sizes, "source_sizes")
    few = sizes.count() <= SOURCES
    w = _sums_before(scratch, sizes, few, named, {"before": F.lit(1).cast("long")}).withColumn("weight", F.col("before") % 3 + 1).drop("before")
    w = w.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    w = scratch.put(_sums_before(scratch, w, few, [F.col("level"), *named], {"k": F.lit(1).cast("long"), "under": F.col("cap"), "lighter": F.col("weight")}), "levels")
    total, weights = w.agg(F.sum("source_size"), F.sum("weight")).head()
    w = w.withColumn("factor", (F.lit(total or 0) - F.col("under")) / (F.lit(weights or 0) - F.col("lighter")))
    # the first source, by level, that stays under its cap says how high the water stands
    first = w.where(F.col("factor") <= F.col("level")).agg(F.min(F.struct("k", "factor")).alias("f")).select("f.factor").head()[0]
    w = w.withColumn("factor", F.lit(first).cast("double"))
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("factor"), F.lit(0.0)) * F.col("weight")))
    w = w.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return w.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"))


def _with_factors(per: DataFrame, base: DataFrame) -> DataFrame:
    """per with factor and certain (documents of a size class above it are certain) and left (words for the others)."""
    sums = base.where("size > 0").groupBy("source", "g").agg(F.sum("size").alias("words"))
    of = Window.partitionBy("s").orderBy(F.desc("g"))  # a row for each size class
    named = per.select(F.col("source").alias("s"), "rest")
    c = sums.join(named, sums["source"].eqNullSafe(named["s"])).where("rest > 0")
    c = c.withColumn("above", F.coalesce(F.sum("words").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("factor", (F.col("rest") - F.col("above")) / F.sum(F.col("g").cast("double") * F.col("words")).over(of.rowsBetween(0, Window.unboundedFollowing)))
    c = c.where(F.col("factor") * F.col("g") < 1).groupBy("s").agg(F.max(F.struct("g", "factor", (F.col("rest") - F.col("above")).alias("left"))).alias("f"))
    out = per.join(c, per["source"].eqNullSafe(c["s"]), "left")
    return out.select(*per.columns, F.coalesce("f.factor", F.lit(0.0)).alias("factor"), F.coalesce("f.g", F.lit(0)).alias("certain"), F.col("f.left").alias("left"))


def _numbered(rows: DataFrame, repeated: DataFrame | None, dice: str, scratch: Scratch) -> DataFrame:
    """Rows whose dice come again are numbered, and each number gets dice of its own. One key's rows are numbered in many
    tasks: within the partition they stand in, behind those of the partitions before."""
    if repeated is None:
        return rows
    same = rows[dice] == repeated["__again"]
    again = scratch.put(rows.join(repeated, same, "left_semi").withColumn("__part", F.spark_partition_id()), "again")
    sizes = again.groupBy(dice, "__part").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(dice).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(dice, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    j = F.col("__before") + F.row_number().over(Window.partitionBy(dice, "__part").orderBy(dice)) - 1
    done = again.join(sizes, [dice, "__part"]).withColumn("__j", j)
    done = done.withColumn(dice, F.when(F.col("__j") > 0, F.xxhash64(dice, "__j")).otherwise(F.col(dice)))
    return rows.join(repeated, same, "left_anti").unionByName(done.select(*[F.col(f"`{c}`") for c in rows.columns]))


def _repeated(base: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The dice that more than one row has."""
    out = scratch.put(base.groupBy("dice").agg(F.count("*").alias("n")).where("n > 1").select(F.col("dice").alias("__again")), "repeated")
    n = out.count()
    return None if not n else F.broadcast(out) if n <= BROADCAST else out.hint("merge")


def plan(docs: DataFrame, scratch: Scratch, most: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """A row for each source: source, source_size, target, copies, rest, factor, certain, left, cut (rank), cut_dice;
    the documents as (doc_id, source, size, dice, g); the dice that come again. A document is in the sample if it is
    certain or (rank, dice) is not above the cut."""
    base = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _dice(F.col("doc_id"), F.col("text"), seed).alias("dice"))
    raw = scratch.put(base.withColumn("g", _size_class(F.col("size"))), "sizes")
    repeated = _repeated(raw, scratch)
    base = raw if repeated is None else scratch.put(_numbered(raw, repeated, "dice", scratch), "numbered")
    per = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, most)
    per = scratch.put(_with_factors(scratch.put(per, "targets"), base), "factors")
    named = per.select(F.col("source").alias("s"), "factor", "certain", "left")
    rows = base.join(named, base["source"].eqNullSafe(named["s"])).where((F.col("size") > 0) & (F.col("left") > 0))
    rows = rows.select("s", "size", "dice", _rank(F.col("g"), F.col("dice"), F.col("factor"), F.col("certain")).alias("rank")).where("rank IS NOT NULL")
    edges = named.select("s", "left", F.lit(0.0).alias("low"), F.lit(1.0).alias("wide"))
    for level in range(6):  # 1024 ** 6 steps are finer than a double
        e = edges.select(F.col("s").alias("es"), "left", "low", "wide")
        step = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("rank") - F.col("low")) / F.col("wide") * BINS))).cast("int")
        placed = rows.join(e, rows["s"].eqNullSafe(e["es"])).select("s", "size", "dice", "rank", step.alias("bin"))
        bins = placed.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        bins = bins.join(e, bins["s"].eqNullSafe(e["es"]))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        past = bins.withColumn("before", before).where(F.col("before") + F.col("words") > F.col("left"))
        past = past.groupBy("s").agg(F.min(F.struct("bin", "before", "n", "left", "low", "wide")).alias("e"))
        edges = past.select("s", F.col("e.bin").alias("bin"), F.col("e.n").alias("n"), (F.col("e.left") - F.col("e.before")).alias("left"), (F.col("e.low") + F.col("e.bin") * F.col("e.wide") / BINS).alias("low"), (F.col("e.wide") / BINS).alias("wide"))
        edges = scratch.put(edges, f"edges{level}")
        e = edges.select(F.col("s").alias("es"), F.col("bin").alias("edge"))
        rows = placed.join(e, placed["s"].eqNullSafe(e["es"]) & (placed["bin"] == e["edge"])).select("s", "size", "dice", "rank")
        if (edges.agg(F.max("n")).head()[0] or 0) <= LIMIT:
            break
        rows = scratch.put(rows, f"edge_rows{level}")
    named = edges.select(F.col("s").alias("es"), "left")
    cum = F.sum("size").over(Window.partitionBy("s").orderBy("rank", "dice").rowsBetween(Window.unboundedPreceding, -1))
    last = rows.withColumn("__cum", F.coalesce(cum, F.lit(0))).join(named, rows["s"].eqNullSafe(named["es"]))  # LIMIT rows of a source
    left = F.col("left") - F.col("__cum")
    fits = (left > 0) & (F.col("size") - left < left)
    cuts = last.groupBy("s").agg(F.max(F.when(fits, F.struct("rank", "dice"))).alias("c"), F.min("rank").alias("least"))
    # nothing of the edge bin goes in: the cut is before its first document
    cuts = cuts.select("s", F.coalesce("c.rank", "least").alias("cut"), F.coalesce(F.col("c.dice"), F.lit(-(1 << 63)).cast("long")).alias("cut_dice"))
    out = per.join(cuts, per["source"].eqNullSafe(cuts["s"]), "left").drop("s")
    out = out.withColumns({"cut": F.coalesce("cut", F.lit(2.0)), "cut_dice": F.coalesce("cut_dice", F.lit(0))})  # no edge: all of the source fit
    return scratch.put(out, "plan"), base, repeated


def _copies(size: Column, g: Column, dice: Column, of) -> Column:
    """How often the mix takes a document; of(name) gives a column of its source."""
    rank = _rank(g, dice, of("factor"), of("certain"))
    into = rank.isNull() | (rank < of("cut")) | ((rank == of("cut")) & (dice <= of("cut_dice")))
    return F.when(size > 0, of("copies") + F.when(of("left").isNotNull(), into.cast("long")).otherwise(0)).otherwise(0).cast("long")


def mix(docs: DataFrame, most: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted)."""
    scratch = Scratch(docs.sparkSession, "mix")
    sources, base, _ = plan(docs, scratch, most, seed)
    named = sources.withColumnRenamed("source", "__s")
    out = base.join(named, base["source"].eqNullSafe(named["__s"]), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("size"), F.col("g"), F.col("dice"), F.col)).alias("taken"))


def mixed_documents(docs: DataFrame, most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    sources, _, repeated = plan(docs, scratch, most, seed)
    per = sources.select(F.struct("*").alias("__mix"))
    rows = _numbered(docs.withColumn("__dice", _dice(F.col("doc_id"), F.col("text"), seed)), repeated, "__dice", scratch)
    rows = rows.join(per, F.col("source").cast("string").eqNullSafe(F.col("__mix.source"))).withColumn("__size", n_words(F.col("text"))).withColumn("__g", _size_class(F.col("__size")))
    times = _copies(F.col("__size"), F.col("__g"), F.col("__dice"), lambda c: F.col(f"__mix.{c}"))
    return rows.withColumn("__n", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
