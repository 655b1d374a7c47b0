"""Connected components, of a table of links and of candidates in buckets.

``components`` alternates large-star and small-star rounds: each round hangs nodes under smaller ones until every node hangs right under the
smallest of its component; the number of rounds grows with the logarithm of the
graph's diameter. Rounds start from files in the shared folder, so the loss of
executors repeats one round at most, and nothing but two numbers a round comes
to the driver.

``bucket_components`` confirms candidate links bucket by bucket without making all
pairs of a bucket, and loses no link between components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.sources.files import discard, materialise


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v) but the smallest of each component, which is the component's name."""
    now = materialise(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(now)
    while state[0]:
        large = _large(now).distinct()
        after = materialise(_small(large).distinct(), "links")
        discard(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


#: Comparisons for each member of open buckets above which stars come first, as long as each round halves them.
DENSE = 1000
#: Comparisons of a bucket that are made in one place, about.
CELL = 2_000_000


def _others(members: DataFrame) -> list[Column]:
    return [F.col(c).alias(f"x_{c}") for c in members.columns if c not in ("key", "size")]


def bucket_components(members: DataFrame, near: Callable[[], Column], confirm: Callable[[DataFrame], DataFrame], enrich: Callable[[DataFrame], DataFrame] | None = None, dense: int = DENSE) -> DataFrame | None:
    """(node, component) as ``components`` gives them, from members of buckets (key, size, rep, ...).

    near: whether a row and another one (its columns have the prefix x_) may be
    linked; confirm: the true links of pairs (u, v); enrich: fills in columns of
    members that ``near`` can decide better with, once most are gone.

    Star rounds find for every member the heads of its buckets, dealt by a hash that
    is the same in all, and confirm it with one of them, and in buckets of two with the
    other one, so their pairs are as many as the members. What is linked becomes one part. Only
    members of other parts than their bucket's largest can have links that are
    still missing; in the end these are compared with all members of other parts,
    unless that would be many comparisons and rounds of stars still halve them by
    joining parts. Buckets whose comparisons are many are dealt out over cells, so
    no task gets them whole; a bucket of unlike members still costs comparisons in
    proportion to the square of its size.
    """
    members = materialise(members.withColumn("part", F.col("rep")).withColumn("keys", F.lit(None).cast("array<long>")), "members")
    if not members.head(1):
        return None
    links, turn, before = None, 0, 0.0
    while True:
        counts = members.groupBy("key", "part").agg(F.count("*").alias("m"))
        if turn:
            whole = counts.groupBy("key").agg(F.max_by("part", "m").alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("own"))
            whole = materialise(whole, "buckets")
            cost, rows = whole.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2), F.sum("all")).first()
            if not cost:
                return parts
        if turn and (cost <= dense * rows or cost > before / 2):
            # a large bucket's outsiders are dealt out over cells, and each cell gets all members
            cells = F.ceil((F.col("all") - F.col("most")) * F.col("all") / CELL).cast("int")
            rows = members.join(whole.select("key", "main", F.greatest(F.lit(1), cells).alias("cells")), "key").withColumn("out", F.col("part") != F.col("main"))
            heads, last = rows.where("out").select("key", F.pmod(F.xxhash64("rep"), "cells").cast("int").alias("cell"), *_others(members)), True
            dealt = rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("main", "cells")
        else:
            order = F.min_by(F.struct(*_others(members)), F.xxhash64("rep", F.lit(turn)))
            heads, last = members.groupBy("key").agg(order.alias("h")).select("key", "h.*"), False
        # a pair that shares several buckets comes from one of them
        here = F.col("keys").isNull() | (F.array_min(F.array_intersect("keys", "x_keys")) == F.col("key"))
        if last:
            most = whole.agg(F.sum("all")).first()[0]
            once = ~F.col("out") | (F.col("rep") < F.col("x_rep"))  # two outsiders meet twice
            pairs = dealt.join(heads, ["key", "cell"]).where(once & (F.col("part") != F.col("x_part")) & near() & here)
            pairs = pairs.select(F.greatest("rep", "x_rep").alias("u"), F.least("rep", "x_rep").alias("v"), F.greatest("part", "x_part").alias("p"), F.least("part", "x_part").alias("q"))
            return _by_parts(materialise(pairs.distinct(), "pairs"), most, links, confirm)
        else:
            pairs = members.join(heads, "key").where((F.col("part") != F.col("x_part")) & near())
            # the other heads that a member meets are mostly linked with the least one; what is of two is done after this round
            order = F.xxhash64("x_rep", F.lit(turn))
            met = F.collect_set(F.when(F.col("size") == 2, F.col("x_rep"))), F.min_by("x_rep", F.when(F.col("size") > 2, order))
            pairs = pairs.groupBy("rep").agg(F.array_compact(F.array_append(met[0], met[1])).alias("x_reps")).select("rep", F.explode("x_reps").alias("x_rep"))
        pairs = pairs.select(F.greatest("rep", "x_rep").alias("u"), F.least("rep", "x_rep").alias("v")).distinct()
        new = materialise(confirm(pairs), "confirmed")
        links = new if links is None else links.union(new)
        parts = components(links)
        before = cost if turn else float("inf")
        own = members.drop("part").where("size > 2")  # of two, both are done
        own = own.join(parts.select(F.col("node").alias("rep"), F.col("component").alias("_c")), "rep", "left")
        own = own.withColumn("part", F.coalesce("_c", "rep")).drop("_c")
        own = _open(own)
        if not turn and enrich is not None:
            own = enrich(own)
        own = own.drop("keys").join(own.groupBy("rep").agg(F.collect_list("key").alias("keys")), "rep")
        members = materialise(own.select(members.columns), "members")
        turn += 1


#: Pairs that are confirmed first, second and third: so many for each part, or for any two. The rest comes last.
PICKS = ((1, "p"), (4, "p"), (1, "p", "q"))


def _by_parts(pairs: DataFrame, most: int, links: DataFrame, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``components`` of the links and of the true ones of pairs (u, v) of the parts p and q.

    If the pairs are more than ``most``, a few of each part come first: once two are one part, their others needn't be confirmed.
    """
    for picks in (*PICKS, None) if pairs.count() > most else (None,):
        now = pairs.select("u", "v")
        if picks:
            n, *keys = picks
            one = F.min_by(F.struct("u", "v"), F.struct(F.xxhash64("q"), F.xxhash64("v", "u")))
            now = materialise(pairs.groupBy(*keys, F.pmod(F.xxhash64("u", "v"), F.lit(n)).alias("pick")).agg(one.alias("x")).select("x.u", "x.v"), "picked")
        links = links.union(materialise(confirm(now), "confirmed"))
        parts = components(links)
        if picks:
            to = lambda node: parts.select(F.col("node").alias(node), F.col("component").alias(f"{node}_part"))
            left = pairs.join(now, ["u", "v"], "left_anti").join(to("u"), "u", "left").join(to("v"), "v", "left")
            p, q = (F.coalesce(f"{node}_part", node) for node in "uv")
            pairs = materialise(left.where(p != q).select("u", "v", F.greatest(p, q).alias("p"), F.least(p, q).alias("q")), "pairs")
            if not pairs.head(1):
                break
    return parts


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one part."""
    keys = members.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("key")
    return members.join(keys, "key")
