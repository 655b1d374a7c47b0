"""The catalogue: each query is (spark, folder of tables) -> DataFrame, over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import contract
from tabloom.operators import fold, generators, iterative, rowwise  # noqa: F401  (they register themselves)
from tabloom.plans import report, sqlapi
from tabloom.sources.files import read_csv, shared_folder, table, write_csv
from tabloom.streaming.jobs import windowed_label_count

NEEDLE = "data"
ORDER = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def passthrough(spark, d):
    return contract.get("identity")(table(spark, d, "lineitem"), a_col="l_orderkey")


def substring_filter(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.col("text").alias("word"))
    return contract.get("substring_filter")(words, needle=NEEDLE).select("doc_id", "word")


def substring_count(spark, d):
    words = table(spark, d, "documents").select(F.col("text").alias("word"))
    return contract.get("substring_filter")(words, needle=NEEDLE).agg(F.count("*").alias("n"))


def substring_ilike_count(spark, d):
    return table(spark, d, "documents").where(F.col("text").ilike(f"%{NEEDLE}%")).agg(F.count("*").alias("n"))


def label_count(spark, d):
    return contract.get("label_count")(table(spark, d, "events").select(F.col("event_type").alias("word")), label="error")


def _lists(spark, d) -> DataFrame:
    """Delimited lists from the line items, valid and invalid pieces among them."""
    odd = F.element_at(F.array(*map(F.lit, ("N/A", "", "-12", "nan"))), F.col("l_linenumber") % 4 + 1)
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.concat_ws(",", F.col("l_partkey").cast("string"), odd, F.col("l_suppkey").cast("string"), F.lit("007")).alias("values"))


def token_split(spark, d):
    return contract.get("token_split")(_lists(spark, d))


def _in_range(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").between(1000, 2000)).groupBy("name").agg(F.count("*").alias("n")).orderBy("name")


def token_range_count(spark, d):
    return _in_range(contract.get("token_split")(_lists(spark, d)))


def token_unnest_count(spark, d):
    """The pieces by a lateral view; what isn't a number falls out as NULL."""
    _lists(spark, d).createOrReplaceTempView("lists_unnest")
    return spark.sql(r"""
        select name, count(*) as n
        from lists_unnest lateral view explode(split(values, ',')) as piece
        where piece rlike '^[0-9]+\\z' and try_cast(piece as bigint) between 1000 and 2000
        group by name order by name
    """)


def token_recursive_count(spark, d):
    """Recursion counts the places 1, 2, ... up to the longest list; each list is then read at its places."""
    lists = _lists(spark, d)
    lists.createOrReplaceTempView("lists_recursive")
    longest = lists.agg(F.max(F.size(F.split("values", ",")))).first()[0] or 1
    return spark.sql(rf"""
        with recursive place(at) max recursion level {longest + 1} as (select 1 union all select at + 1 from place where at < {longest})
        select name, count_if(try_cast(piece as bigint) between 1000 and 2000) as n
        from (select name, split_part(values, ',', at) as piece from lists_recursive join place on at <= size(split(values, ',')))
        where piece rlike '^[0-9]+\\z' group by name having n > 0 order by name
    """)


def token_function_count(spark, d):
    sqlapi.register_functions(spark)
    _lists(spark, d).createOrReplaceTempView("lists_function")
    return spark.sql("""
        select name, count(*) as n from token_split(table(select name, values from lists_function))
        where value between 1000 and 2000 group by name order by name
    """)


def substring_function_count(spark, d):
    sqlapi.register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_function")
    return spark.sql(f"select count(*) as n from substring_filter(table(select text as word from documents_function), '{NEEDLE}')")


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


def linear_fit(spark, d):
    return _rounded(contract.get("linear_fit")(table(spark, d, "lineitem"), x_col="l_quantity", y_col="l_extendedprice"))


def quadratic_fit(spark, d):
    return _rounded(contract.get("quadratic_fit")(table(spark, d, "lineitem"), x_col="l_quantity", y_col="l_extendedprice"), 2)


def quadratic_fit_shifted(spark, d):
    """The fit where x lies far from 0: its curvature, and its slope in the middle."""
    far = table(spark, d, "lineitem").select((F.col("l_quantity") + 1_000_000).alias("x"), F.col("l_extendedprice").alias("y"))
    return _rounded(contract.get("quadratic_fit")(far).select("c", (F.col("b") + F.col("c") * 2_000_050).alias("slope")), 2)


def exact_curve_fit(spark, d):
    xy = table(spark, d, "events").selectExpr("value / 100 as x", "0.5 * (value / 100) * (value / 100) - 3 * (value / 100) + 2 as y")
    return _rounded(contract.get("quadratic_fit")(xy))


def polynomial_fit_1(spark, d):
    return _rounded(contract.get("polynomial_fit")(table(spark, d, "part"), degree=1, x_col="p_size", y_col="p_retailprice"))


def polynomial_fit_2(spark, d):
    return _rounded(contract.get("polynomial_fit")(table(spark, d, "lineitem"), degree=2, x_col="l_quantity", y_col="l_extendedprice"), 2)


def _points(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*ORDER, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def kmeans_sizes(spark, d):
    found = contract.get("kmeans")(_points(spark, d), order=ORDER)
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


def kmeans_assign(spark, d):
    return contract.get("kmeans")(_points(spark, d), order=ORDER, max_iter=0).select(*ORDER, "cluster_id")


def kmeans_random(spark, d):
    found = contract.get("kmeans")(_points(spark, d), init="random")
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


def kmeans_library(spark, d):
    found = contract.get("kmeans_library")(_points(spark, d))
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


def kmeans_view(spark, d):
    """k and features as parameters, the result under a view's name for SQL, with a case-sensitive column name."""
    points = _points(spark, d)
    contract.view("line_clusters", "kmeans", points, k=4, max_iter=2, features=("x", "y"), order=ORDER, cluster_col="clusterId")
    return spark.sql("select `clusterId` as `clusterId`, count(*) as n, round(max(x), 3) as most from line_clusters group by `clusterId`")


def fit_view(spark, d):
    """Operators that fold, applied in SQL over the views that hold their results."""
    lines = table(spark, d, "lineitem")
    contract.view("price_line", "linear_fit", lines, x_col="l_quantity", y_col="l_extendedprice")
    contract.view("flag_count", "label_count", lines.select(F.col("l_returnflag").alias("word")), label="R")
    return spark.sql("select word, word_count, round(intercept + slope * word_count, 1) as priced from flag_count, price_line")


def log_median(spark, d):
    return _rounded(report.medians(table(spark, d, "events"), ["event_type"], ["value"]), 6)


def log_unpivot(spark, d):
    wide = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v1"), (F.col("o_totalprice") * 2).alias("v2"))
    return wide.unpivot("o_orderkey", ["v1", "v2"], "run_id", "runtime")


def log_json(spark, d):
    events = table(spark, d, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def log_json_columns(spark, d):
    """A JSON column to columns; keys that are missing are NULL."""
    events = table(spark, d, "events").select("event_id", "props")
    return report.json_columns(events, "props", {"k": "long", "missing": "string"})


def log_recoded(spark, d):
    """Labels for codes (none for unlisted ones), and only round sizes."""
    sizes = report.round_sizes(table(spark, d, "part").select("p_partkey", "p_size", F.substring("p_brand", 1, 7).alias("kind")), "p_size", 5, most=40)
    return report.recode(sizes, "kind", {"Brand#1": "first", "Brand#3": "third"})


def log_split_name(spark, d):
    named = table(spark, d, "orders").select("o_orderkey", F.concat_ws("_", "o_orderpriority", F.lit("run"), F.col("o_custkey").cast("string")).alias("full_name"))
    name, number = report.split_name(F.col("full_name"))
    return named.select("o_orderkey", name.alias("name"), number.alias("data_size"))


def log_runs(spark, d):
    logs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.col("l_linenumber").cast("string"))), ", "), F.lit("]")).alias("runs"))
    return report.list_to_rows(logs, "runs")


def log_throughput(spark, d):
    """Frames with unlike columns bound by name, and rates by group."""
    events = table(spark, d, "events").select(F.lit("events").alias("system"), "event_type", F.abs("value").alias("runtime"), F.lit(2).alias("num_threads"), F.lit(0.5).alias("compilation_time"), F.lit(1000).alias("data_size"))
    orders = table(spark, d, "orders").select(F.lit("orders").alias("system"), F.col("o_totalprice").alias("runtime"), F.lit(1).alias("num_threads"), F.lit(0.0).alias("compilation_time"), F.lit(1000).alias("data_size"))
    rates = report.throughput(report.bind_rows([events, orders]))
    return _rounded(report.medians(rates, ["system", "event_type"], ["runtime_single_threaded", "runtime_with_compilation_single_threaded"]), 4)


def csv_roundtrip(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(orders, path)
    return read_csv(spark, path, orders.schema)


def window_label_count(spark, d):
    """The streaming fold on the same rows as a batch."""
    return windowed_label_count(table(spark, d, "events"), "error")


QUERIES = {
    f.__name__: f
    for f in (
        passthrough, substring_filter, substring_count, substring_ilike_count, substring_function_count, label_count,
        token_split, token_range_count, token_unnest_count, token_recursive_count, token_function_count,
        linear_fit, quadratic_fit, quadratic_fit_shifted, exact_curve_fit, polynomial_fit_1, polynomial_fit_2,
        kmeans_sizes, kmeans_assign, kmeans_random, kmeans_library, kmeans_view, fit_view,
        log_median, log_unpivot, log_json, log_json_columns, log_recoded, log_split_name, log_runs, log_throughput, csv_roundtrip, window_label_count,
    )
}


# --- The same in SQL for an independent engine -----------------------------------------------


_LISTS = """lists as (select l_returnflag as name, concat_ws(',', l_partkey::varchar,
    case l_linenumber % 4 when 0 then 'N/A' when 1 then '' when 2 then '-12' else 'nan' end, l_suppkey::varchar, '007') as vals from lineitem)"""
_TOKENS = "tokens as (select name, try_cast(piece as bigint) as value from (select name, unnest(string_split(vals, ',')) as piece from lists) where regexp_full_match(piece, '-?[0-9]+') and try_cast(piece as bigint) is not null)"
_COUNTED = "select name, count(*) as n from tokens where value between 1000 and 2000 group by name order by name"


def _quadratic(rows: str, x: str, y: str, digits: int) -> str:
    """The curve from covariances of u = x less its mean, u squared, and y; then taken back to x."""
    return f"""with p as (select ({x})::double as x, ({y})::double as y from {rows}), q as (select * from p where x is not null and y is not null),
    m as (select avg(x) as m from q), v as (select x - m as u, (x - m) * (x - m) as w, y, m from q, m),
    k as (select var_pop(u) as uu, var_pop(w) as ww, covar_pop(u, w) as uw, covar_pop(u, y) as uy, covar_pop(w, y) as wy, avg(y) as y, avg(w) as w, any_value(m) as m from v),
    c as (select *, (wy * uu - uy * uw) / (uu * ww - uw * uw) as c from k), b as (select *, (uy - c * uw) / uu as s from c)
    select round(y - c * w - s * m + c * m * m, {digits}) as a, round(s - 2 * c * m, {digits}) as b, round(c, {digits}) as c, s, m from b"""


def _kmeans(rounds: int, result: str, k: int = 8) -> str:
    near = "list_min(list_transform((select list(c order by i) from {c} c), lambda c: struct_pack(d := (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y), i := c.i))).i"
    order = ", ".join(ORDER)
    parts = [
        f"p as materialized (select {order}, l_quantity as x, l_extendedprice / 1000 as y from lineitem)",
        f"c0 as materialized (select (row_number() over (order by {order}) - 1)::integer as i, x, y from (select * from p order by {order} limit {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select p.*, {near.format(c=f'c{r}')} as i from p)")
        if r < rounds:
            parts.append(f"c{r + 1} as materialized (select c.i, coalesce(m.x, c.x) as x, coalesce(m.y, c.y) as y from c{r} c left join (select i, avg(x) x, avg(y) y from a{r} group by i) m on m.i = c.i)")
    return f"with {', '.join(parts)} {result.format(a=f'a{rounds}', order=order)}"


ORACLE = {
    "passthrough": "select l_orderkey as a from lineitem",
    "substring_filter": f"select doc_id, text as word from documents where text ilike '%{NEEDLE}%'",
    "substring_count": f"select count(*) as n from documents where text ilike '%{NEEDLE}%'",
    "label_count": "select 'error' as word, count(*) filter (where event_type = 'error') as word_count from events union all select 'other', count(*) filter (where event_type is distinct from 'error') from events",
    "token_split": f"with {_LISTS}, {_TOKENS} select name, value from tokens",
    "token_range_count": f"with {_LISTS}, {_TOKENS} {_COUNTED}",
    "linear_fit": "select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 3) as slope from lineitem",
    "quadratic_fit": f"select a, b, c from ({_quadratic('lineitem', 'l_quantity', 'l_extendedprice', 2)})",
    "quadratic_fit_shifted": f"select round(c, 2) as c, round(s + 2 * c * (1000025 - m), 2) as slope from ({_quadratic('lineitem', 'l_quantity + 1000000', 'l_extendedprice', 12)})",
    "exact_curve_fit": "select 2.0::double as a, -3.0::double as b, 0.5::double as c",
    "polynomial_fit_1": "select 0 as power, round(regr_intercept(p_retailprice, p_size), 3) as coefficient from part union all select 1, round(regr_slope(p_retailprice, p_size), 3) from part",
    "polynomial_fit_2": f"with f as ({_quadratic('lineitem', 'l_quantity', 'l_extendedprice', 2)}) select 0 as power, a as coefficient from f union all select 1, b from f union all select 2, c from f",
    "kmeans_sizes": _kmeans(10, "select i as cluster_id, count(*) as n from {a} group by i"),
    "kmeans_view": _kmeans(2, 'select i as "clusterId", count(*) as n, round(max(x), 3) as most from {a} group by i', 4),
    "fit_view": """with f as (select regr_intercept(l_extendedprice, l_quantity) as a, regr_slope(l_extendedprice, l_quantity) as b from lineitem),
        c as (select 'R' as word, count(*) filter (where l_returnflag = 'R') as word_count from lineitem union all select 'other', count(*) filter (where l_returnflag is distinct from 'R') from lineitem)
        select word, word_count, round(a + b * word_count, 1) as priced from c, f""",
    "kmeans_assign": _kmeans(0, "select {order}, i as cluster_id from {a}"),
    "log_median": "select event_type, round(median(value), 6) as value from events group by event_type",
    "log_unpivot": "select o_orderkey, 'v1' as run_id, o_totalprice as runtime from orders union all select o_orderkey, 'v2', o_totalprice * 2 from orders",
    "log_json": "select event_id, json_extract_string(props, '$.k')::bigint as k from events",
    "log_json_columns": "select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.missing') as missing from events",
    "log_recoded": "select p_partkey, p_size, case substr(p_brand, 1, 7) when 'Brand#1' then 'first' when 'Brand#3' then 'third' end as kind from part where p_size % 5 = 0 and p_size <= 40",
    "log_split_name": "select o_orderkey, o_orderpriority || '_run' as name, o_custkey as data_size from orders",
    "log_runs": "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber::varchar)::integer as run_id, l_linenumber::double as runtime from lineitem",
    "log_throughput": """with b as (select 'events' as system, event_type, abs(value) as r, 2 as t, 0.5 as c from events union all select 'orders', null, o_totalprice, 1, 0.0 from orders)
        select system, event_type, round(median(r * t), 4) as runtime_single_threaded, round(median(r * t + c), 4) as runtime_with_compilation_single_threaded from b group by system, event_type""",
    "csv_roundtrip": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
    "window_label_count": "select time_bucket(interval '1 hour', ts) as start, count(*) filter (where event_type = 'error') as label_rows, count(*) filter (where event_type is distinct from 'error') as other_rows from events group by 1",
}
ORACLE |= {other: ORACLE["substring_count"] for other in ("substring_ilike_count", "substring_function_count")}
ORACLE |= {other: ORACLE["token_range_count"] for other in ("token_unnest_count", "token_recursive_count", "token_function_count")}
