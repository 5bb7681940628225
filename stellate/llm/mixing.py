"""Mixing sources so that each gives a target share of all tokens, small ones repeated up to a cap.

Tokens are added up by source; from them and the target weights follows how often a source's documents are used. A
document is emitted as often as the whole part of that rate says, and once more with the probability of its fraction,
drawn from a hash of its id, so that any run and any partitioning give the same mixture.

Defined results: sources compare without case and surrounding white space; documents of unlisted or null sources aren't
used; a text that is null or empty has no tokens; a source without tokens has the rate 0; weights that are null or
negative count as 0, and repeats that are null as 0; target rows alike in source add their weights under the first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import checkpoint, spread
from .bpe import token_count

_SEED = 20250101


def _all() -> WindowSpec:
    """Over all rows; only for the few rows of the targets, not for documents."""
    return Window.partitionBy(F.lit(1))


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def sized(docs: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, skey, tokens) of each document."""
    rows = spread(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", source_key(F.col("source")).alias("skey"), token_count(F.col("text"), name, folder).alias("tokens"))


def _targets(targets: DataFrame) -> DataFrame:
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = targets.where("source is not null").select(source_key(F.col("source")).alias("skey"), "source", weight.alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    return rows.groupBy("skey").agg(F.min("source").alias("source"), F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target source its own tokens, those wanted of it, and the rate of use: (skey, source, weight, max_repeats, own, wanted, rate)."""
    own = sizes.where("skey is not null").groupBy("skey").agg(F.sum("tokens").alias("own"))
    listed = _targets(targets).join(own, "skey", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    total, weights = F.sum("own").over(_all()), F.sum("weight").over(_all())
    wanted = F.when(weights > 0, total * F.col("weight") / weights).otherwise(0.0)
    rate = F.when(F.col("own") > 0, F.least(F.col("max_repeats").cast("double"), F.col("wanted") / F.col("own"))).otherwise(0.0)
    return listed.withColumn("wanted", wanted).withColumn("rate", rate)


def short_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The sources that can't give their share within their cap."""
    return plan(sizes, targets).where(F.col("max_repeats") * F.col("own") < F.col("wanted")).select("source")


def copies(doc_id: Column, rate: Column, seed: int = _SEED) -> Column:
    """How often a document is used: the rate's whole part and, by its fraction, one more."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("int")


def mix(docs: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """All columns of docs, and copy (in place of one of that name): a row for each use of a document, counted from 1."""
    rates = plan(sized(docs, name, folder), targets).select("skey", "rate")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "copy"]).alias("row"), source_key(F.col("source")).alias("skey"))
    # There are no more rates than targets; texts stay where they are, however many one source has.
    used = rows.join(F.broadcast(rates), "skey").withColumn("n", copies(F.col("row.doc_id"), F.col("rate"))).where("n > 0")
    return used.select("row.*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def shares(docs: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The share of all tokens wanted of each target source, and the one that the mixture reaches."""
    sizes = checkpoint(sized(docs, name, folder))  # three numbers a document, so that texts are encoded once
    rates = plan(sizes, targets)
    used = sizes.join(F.broadcast(rates.select("skey", "rate")), "skey").withColumn("n", copies(F.col("doc_id"), F.col("rate")))
    used = used.groupBy("skey").agg(F.sum(F.col("n") * F.col("tokens")).alias("used"), F.count_if(F.col("n") > 0).alias("documents"), F.max("n").alias("most_repeats"))
    rows = rates.join(used, "skey", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select("source", F.col("own").alias("own_tokens"), "rate", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.col("used").alias("used_tokens"), part(F.col("weight"), F.sum("weight").over(_all())).alias("target_share"), part(F.col("used"), F.sum("used").over(_all())).alias("reached_share"))
