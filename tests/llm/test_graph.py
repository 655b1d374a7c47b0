from pyspark.sql import functions as F

from tabloom.llm import graph


def found(spark, groups, near, true):
    """Components of one bucket by the group of each member, and how many pairs were confirmed."""
    rows = [(1, len(groups), i, g) for i, g in enumerate(groups)] + [(2, 2, i, g) for i, g in enumerate(groups[:2])]
    members, seen = spark.createDataFrame(rows, "key long, size long, rep long, g string"), []

    def confirm(pairs):
        seen.extend((x["u"], x["v"]) for x in pairs.select("u", "v").collect())
        return pairs.select("u", "v").where(F.udf(lambda u, v: true(groups[u], groups[v]), "boolean")("u", "v"))

    parts = {x["node"]: x["component"] for x in graph.bucket_components(members, near, confirm).collect()}
    return [parts.get(i, i) for i in range(len(groups))], seen


def test_pairs_of_one_part_are_not_all_confirmed(spark):
    groups = [str(i % 3) for i in range(60)]
    got, seen = found(spark, groups, lambda: F.col("g") == F.col("x_g"), lambda a, b: a == b)
    assert got == [i % 3 for i in range(60)]
    assert len(seen) < 150  # all pairs within the two groups without the head are 380


def test_no_link_between_parts_is_lost(spark):
    """Most candidates aren't true; what is left after the picks is confirmed as well."""
    groups = [str(i) for i in range(40)]
    true = lambda a, b: {int(a), int(b)} in ({3, 17}, {17, 38}, {5, 6}, {0, 1})
    got, seen = found(spark, groups, lambda: F.lit(True), true)
    assert {i: c for i, c in enumerate(got) if c != i} == {17: 3, 38: 3, 6: 5, 1: 0}
    assert len(seen) <= 40 * 39 // 2 + 41
