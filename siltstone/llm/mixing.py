"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key ``-ln(u) / weight`` with u from a hash of its id and
its quality as weight. Within its source, documents are taken in order of the key
until the source's token budget is reached. A budget beyond the source's tokens
takes complete epochs first (each document once per epoch, at most the permitted
repeats) and then the fraction that is left, in key order.

The running sums need no sort of a whole source: keys fall into ranges, the
ranges' token sums are added up first, and each range is sorted on its own. A key's range is its place in the
distribution that the source's weights give (a mixture of exponentials), so ranges hold alike many documents
however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents per range of keys, on average.
RANGE_ROWS = 20_000


def source_name(c: Column) -> Column:
    """Source values in one spelling: lower case, no blanks at the ends, ``_`` between words; blank becomes null."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\-_]+|[\s\-_]+$", ""), r"[\s\-_]+", "_")
    return F.when(x != "", x)


def quality(text: Column) -> Column:
    """A weight in 0.05..1 from the text alone: the share of letters and blanks, less what is not text."""
    n = F.greatest(F.char_length(text), F.lit(1))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    broken = F.char_length(F.regexp_replace(text, r"[^\x{FFFD}\x{80}-\x{9F}]+", ""))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), letters / n - 10 * broken / n))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)


def targets(mixes: DataFrame) -> DataFrame:
    """``mix_id, source, share, max_repeats, size_factor``: shares of one mix add up to 1.

    Rows of one mix and source are added up; null or negative targets count as 0. A null
    ``max_repeats`` is no cap, one below 0 counts as 0.
    """
    own = mixes.groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target"),
        F.when(F.count("max_repeats") == F.count("*"), F.max(F.greatest("max_repeats", F.lit(0)))).alias("max_repeats"),
        F.max("size_factor").alias("size_factor"),
    )
    whole = F.sum("target").over(Window.partitionBy("mix_id"))
    return own.where("source is not null").select("mix_id", "source", F.when(whole > 0, F.col("target") / whole).otherwise(0.0).alias("share"), "max_repeats", "size_factor")


def budgets(docs: DataFrame, mixes: DataFrame) -> DataFrame:
    """One row per mix and source: ``available, budget, epochs, fraction`` in tokens.

    ``budget`` is the source's share of ``size_factor`` times the tokens of all documents;
    ``epochs`` complete passes fit it and the cap; ``fraction`` is what is drawn beyond them,
    0 if the cap is reached. A source without tokens yields nothing.
    """
    per = docs.groupBy("source").agg(F.sum("tokens").alias("available"))
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    x = targets(mixes).join(per, "source", "left").join(F.broadcast(total), F.lit(True))
    x = x.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("budget", F.col("share") * F.col("size_factor") * F.col("total"))
    fit = F.floor(F.col("budget") / F.col("available"))
    x = x.withColumn("epochs", F.when(F.col("available") > 0, F.least(fit, F.coalesce(F.col("max_repeats").cast("long"), fit))).otherwise(0).cast("long"))
    capped = F.col("epochs") >= F.coalesce(F.col("max_repeats").cast("long"), F.lit(2**62))
    return x.withColumn("fraction", F.when((F.col("available") > 0) & ~capped, F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0))


def key_shares(docs: DataFrame) -> DataFrame:
    """``source, ranges, shares``: how many ranges a source's keys are cut into, and its weights as ``(weight, share)`` in bands.

    Bands are a sixteenth of a natural logarithm wide, and weights lie in 0.05..1, so a source has at most some fifty (weights below a
    millionth count as that, which bounds the bands of any others).
    """
    band = F.floor(F.log(F.greatest("weight", F.lit(1e-6))) * 16)
    per = docs.groupBy("source", band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.greatest("weight", F.lit(1e-6))).alias("w"))
    all_ = per.groupBy("source").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("w", "n"))).alias("bands"))
    shares = F.transform("bands", lambda x: F.struct(x["w"].alias("w"), (x["n"] / F.col("rows")).alias("share")))
    return all_.select("source", F.greatest(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(1)).alias("ranges"), shares.alias("shares"))


def share_below(k: Column, shares: Column) -> Column:
    """The expected share of a source's documents with a key up to ``k``: it rises with the key and is spread evenly over 0..1."""
    return F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x["share"] * (1 - F.exp(-k * x["w"])))


def draw(spark: SparkSession, docs: DataFrame, mixes: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """``mix_id, source, key, copies, tokens`` of every document that a mix takes.

    ``docs`` has ``key, source, tokens, weight`` (source as in :func:`source_name`) and is read
    more than once: write it first. Documents without source or tokens are never drawn. The
    last document of the fraction is taken if that comes nearer to the budget. Ties of keys
    go to the smaller id.
    """
    own = docs.where("source is not null and tokens > 0").select(key, "source", "tokens", "weight")
    k = -F.log(uniform(F.col(key), seed)) / F.greatest("weight", F.lit(1e-6))
    plan = budgets(docs, mixes)
    named = F.broadcast(mixes.select(source_name(F.col("source")).alias("source")).distinct())
    ranked = own.withColumn("k", k).join(F.broadcast(key_shares(own).join(named, "source")), "source")
    ranked = ranked.withColumn("range", F.least(F.floor(share_below(F.col("k"), F.col("shares")) * F.col("ranges")), F.col("ranges") - 1).cast("int")).drop("shares", "ranges")
    sums = ranked.groupBy("source", "range").agg(F.sum("tokens").alias("own"))
    before = sums.select("source", "range", (F.sum("own").over(Window.partitionBy("source").orderBy("range")) - F.col("own")).alias("before"))
    w = Window.partitionBy("source", "range").orderBy("k", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranked.withColumn("upto", F.sum("tokens").over(w)).join(before, ["source", "range"]).withColumn("upto", F.col("upto") + F.col("before"))
    x = summed.select("source", key, "tokens", "upto").join(F.broadcast(plan.select("mix_id", "source", "epochs", "fraction")), "source")
    extra = F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("fraction"), 1).otherwise(0)
    return x.select("mix_id", "source", key, (F.col("epochs") + extra).alias("copies"), "tokens").where("copies > 0")


def report(docs: DataFrame, mixes: DataFrame, drawn: DataFrame) -> DataFrame:
    """Target and actual share of each source in each mix, with the tokens and documents drawn."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    x = budgets(docs, mixes).join(got, ["mix_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("mix_id"))
    return x.select(
        "mix_id", "source", "share", "available", "budget", "epochs", "tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(whole > 0, F.col("tokens") / whole).alias("actual_share"),
    )
