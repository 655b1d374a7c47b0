"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised into 2**BITS cells of about equal numbers of rows, by
quantiles of the whole values of all rows; a row's cells give its place on the curve; rows in the order of that place are
cut into runs, the shards. Rows that are close in all dimensions share shards,
so the value ranges of each shard's files are narrow in every dimension and
filters on any of them skip files.

Runs are cut by the law ``rows``: numbers of rows differ by one at most. Ranks
come from counts by bucket (place on the curve, salt of key and tie columns), at most
2**(BITS * dimensions) * SALTS numbers whatever the input, plus a row number within
the bucket. The salt deals a hot cell out over SALTS tasks; rows that are alike in key
and tie columns share one, so tie columns should tell rows of a repeated key apart.

Defined cases: NULL in a dimension takes the lowest cell; rows alike in key and
tie columns are interchangeable; no rows give no rows; columns of the input
named hilbert, shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.batches import free_name
from tabloom.sources.files import discard, materialise

BITS = 4
SALTS = 64


def hilbert_distance(cells: Sequence[int], bits: int = BITS) -> int:
    """The place of a cell on the curve, from 0.

    From the top bit down, each level picks a sub-cube by the Gray code of the
    cell's bits there; the walk inside that sub-cube is the whole curve turned
    and mirrored, which (start corner, main axis) keep track of.
    """
    n = len(cells)
    mask = (1 << n) - 1
    rotate = lambda v, k: ((v >> (k % n)) | (v << (n - k % n))) & mask
    start, axis, out = 0, 0, 0
    for level in reversed(range(bits)):
        corner = sum(((c >> level) & 1) << i for i, c in enumerate(cells))
        local = rotate(corner ^ start, axis + 1)
        place = local
        for shift in range(1, n):
            place ^= local >> shift
        out = (out << n) | place
        low = lambda v: (~v & (v + 1)).bit_length() - 1  # noqa: E731  trailing ones
        entry = 0 if place == 0 else (e := 2 * ((place - 1) // 2)) ^ (e >> 1)
        turn = 0 if place == 0 else low(place - 1) if place % 2 == 0 else low(place)
        start ^= rotate(entry, n - (axis + 1) % n)
        axis = (axis + turn % n + 1) % n
    return out


def curve_table(dimensions: int, bits: int = BITS) -> list[int]:
    """The place of every cell; cells count with the first dimension as the highest digit."""
    side = 1 << bits
    return [hilbert_distance([(i // side**k) % side for k in reversed(range(dimensions))], bits) for i in range(side**dimensions)]


def boundaries(df: DataFrame, dimensions: Sequence[str], side: int) -> dict[str, list]:
    """For each dimension the values that cut it into ``side`` cells of about equal numbers of rows.

    They are quantiles of the whole values of all rows. The numbers of rows of the different values are dealt out by
    ranges of values; running sums within a range start from the sums of the ranges before it. A number for each range
    and ``side`` - 1 values come to the driver.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for d in dimensions:
        counts = df.groupBy(F.col(d).alias("value")).agg(F.count("*").alias("rows"))
        counts = materialise(counts.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()), "values")
        known = counts.where("value is not null")
        nulls, *_ = counts.where("value is null").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()
        starts, total = [], 0
        for r in sorted(known.groupBy("range").agg(F.sum("rows").alias("rows")).collect()):
            starts.append((r["range"], total))
            total += r["rows"]
        # NULLs fill the lowest cells
        places = [i for k in range(1, side) if 0 <= (i := (total + nulls) * k // side - nulls) < total]
        out[d] = []
        if places:
            start = F.element_at(F.create_map(*(F.lit(x).cast("long") for s in starts for x in s)), F.col("range").cast("long"))
            upto = F.sum("rows").over(Window.partitionBy("range").orderBy("value"))
            running = known.select("value", "rows", (start + upto).alias("upto"))
            held = sum((F.col("upto") - F.col("rows") <= i).cast("int") * (F.col("upto") > i).cast("int") for i in places)
            found = running.select("value", held.alias("held")).where("held > 0").collect()
            out[d] = [r["value"] for r in found for _ in range(r["held"])]
        discard(counts)
    return out


def with_hilbert(df: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> DataFrame:
    """The rows with ``hilbert``, the place of their cell on the curve."""
    side = 1 << bits
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cuts = boundaries(df, dimensions, side)
    code = F.lit(0)
    for d in dimensions:
        # the number of boundaries that the value reaches, after the cells that NULLs fill
        reached = sum((F.coalesce(F.col(d) >= F.lit(v).cast(kinds[d]), F.lit(False)).cast("int") for v in cuts[d]), F.lit(0))
        below = F.when(F.col(d).isNull(), 0).otherwise(side - 1 - len(cuts[d]))
        code = code * side + below + reached
    table = F.split(F.lit(",".join(map(str, curve_table(len(dimensions), bits)))), ",").cast("array<int>")
    return df.drop("hilbert").withColumn("hilbert", F.element_at(table, code + 1))


def hilbert_shards(df: DataFrame, n_shards: int, dimensions: Sequence[str] = ("lang", "source", "n_chars"), key: str = "doc_id", ties: Sequence[str] = ()) -> DataFrame:
    """The rows with ``hilbert``, ``shard`` in [0, n_shards) and ``slot``, their place in the shard from 0."""
    placed = with_hilbert(df.drop("shard", "slot"), dimensions)
    salt, row, start, total, rank = (free_name(placed, n) for n in ("salt", "row", "start", "total", "rank"))
    placed = placed.withColumn(salt, F.pmod(F.xxhash64(key, *ties), F.lit(SALTS)).cast("int"))
    every = Window.partitionBy()
    earlier = every.orderBy("hilbert", salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("hilbert", salt)
        .agg(F.count("*").alias(row))
        .select("hilbert", salt, F.coalesce(F.sum(row).over(earlier), F.lit(0)).alias(start), F.sum(row).over(every).alias(total))
    )
    own = Window.partitionBy("hilbert", salt).orderBy(key, *ties)
    ranked = placed.withColumn(row, F.row_number().over(own)).join(F.broadcast(starts), ["hilbert", salt])
    ranked = ranked.withColumn(rank, F.col(start) + F.col(row) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast({rank} * {n_shards} div {total} as int)"))
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    own_columns = [c for c in df.columns if c not in ("hilbert", "shard", "slot")]
    return ranked.withColumn("slot", F.col(rank) - first).select(*own_columns, "hilbert", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots."""
    ordered = sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """The digest of the shards of a documents table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return hilbert_shards(narrow, n_shards, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
