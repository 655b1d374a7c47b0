"""Mix sources to target weights: repeat or thin each source so that its share of the words meets its target.

A source's rate is its target over its words. Each document comes floor(rate)
times, plus one more time with the probability of the rate's fraction.

The draws of a source's documents depend on each other, so that they add up to the
target: documents are taken in the order of their sizes (ties by a hash of their
keys), and the extra copies fall on those at which the running sum of the fraction,
from a start that is hashed from the source's name, passes a whole number. Each
document's probability is the fraction; the words that come differ from the target by
those of the largest document at most. A source of more documents than STRATUM is
dealt by hash into strata of about so many, each with its own start, so that no
source's documents meet in one task; the strata's misses are apart and of either sign.

Targets: the sources share the whole number of words by weight; a target stops
at ``most`` times the words of its source and the excess is shared again by
weight among the others, until none is above. That is a level to which all sources
are filled, weight by weight; sources sorted by the level of their caps show where it
lies, by running sums.

The digest shuffles sizes only; the mix itself sends each document once to its
stratum.

Defined cases: NULL text has size 0; NULL is a source of its own, the last;
sources without words have target 0 and rate 0; rows that are alike are
interchangeable; columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import u32
from tabloom.llm.batches import free_name, running_sums
from tabloom.sources.files import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents of a stratum, about.
STRATUM = 5_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, docs, target, rate) from rows (source, size)."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    table = running_sums(table, "source", {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = table.select("source", "source_size", "docs", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    table = running_sums(table.withColumn("brim", F.col("cap") / F.col("weight")), "brim", {"full": F.col("cap"), "lighter": F.col("weight")})
    table = materialise(table, "targets")
    total, weighs = table.agg(F.sum("source_size"), F.sum("weight")).first()
    # the sources below are full; the others share what these leave
    level = table.select("brim", ((F.lit(total or 0) - F.col("full")) / (F.lit(weighs or 0.0) - F.col("lighter"))).alias("level")).where("level <= brim")
    level = level.agg(F.min_by("level", "brim")).first()[0]
    target = F.least("cap", F.col("weight") * F.lit(level if level is not None else float("inf")))
    return table.select("source", "source_size", "docs", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def with_copies(df: DataFrame, targets: DataFrame, size: str, key: str = "doc_id", ties: Sequence[Column] = (), seed: str = "mix") -> tuple[DataFrame, dict[str, str]]:
    """The rows with the targets' columns and ``copies``, how often each comes; and the names of these columns."""
    names = {c: free_name(df, c if c in ("target", "rate") else f"mix_{c}") for c in ("source_size", "docs", "target", "rate", "source", "draw", "copies", "stratum", "hash")}
    name = lambda c: F.col(names[c])
    own = targets.select(*(F.col(c).alias(names[c]) for c in ("source", "source_size", "docs", "target", "rate")))
    out = df.join(own, df["source"].eqNullSafe(own[names["source"]]))
    # ties and strata by a digest, which other engines can repeat
    out = out.withColumn(names["hash"], u32(F.coalesce(F.col(key).cast("string"), F.lit("")), seed))
    strata = F.floor(name("docs") / STRATUM) + 1
    out = out.withColumn(names["stratum"], name("hash") % strata)
    order = Window.partitionBy(names["source"], names["stratum"]).orderBy(size, names["hash"], key, *ties)
    start = u32(F.concat_ws("/", F.coalesce(name("source"), F.lit("")), name("stratum").cast("string")), seed) / F.lit(4294967296.0)
    part = name("rate") - F.floor(name("rate"))
    out = out.withColumn(names["draw"], F.row_number().over(order))
    extra = F.floor(start + part * name("draw")) - F.floor(start + part * (name("draw") - 1))
    return out.withColumn(names["copies"], (F.floor(name("rate")) + extra).cast("long")), names


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it comes, with the columns of the input."""
    size = free_name(docs, "mix_size")
    sized = docs.withColumn(size, word_count(F.col("text")))
    targets = source_targets(sized.select("source", F.col(size).alias("size")), weights, most)
    out, names = with_copies(sized, targets, size, key, (F.xxhash64("text"),), seed)
    copies = F.col(names["copies"])
    return out.where(copies > 0).withColumn(free_name(out, "mix_copy"), F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The digest of the mix: what each document gives to it."""
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out, names = with_copies(sizes, source_targets(sizes), "size")
    taken = F.col(names["copies"]) * F.col("size")
    return out.select("doc_id", "size", F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), taken.alias("taken"), "source", F.col(names["rate"]).alias("rate"))
