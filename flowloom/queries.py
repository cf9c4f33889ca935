"""One query for each operator over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.routines import DataOperation, Dates, Mathematical, Numeric, StringHandling, Text
from flowloom.operators import aggregate as agg
from flowloom.operators import code, extract, joins, messages, order, reshape, rows
from flowloom.operators.joins import Lookup, Output
from flowloom.plans.job import Job, Step
from flowloom.plans.schema import Field, enforce
from flowloom.shared import shared_folder
from flowloom.sources import files, sinks
from flowloom.sources.made import fixed_rows, generate_rows
from flowloom.sources.sinks import grouped_xml, positional_line

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: lineitem has no key; these columns together are one.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINE = ", ".join(LINE_ORDER)


@query("""
select r_name, n_name, sum(cast(o_totalprice as decimal(38,4)))::double total, count(*) orders_n, count(distinct o_custkey) customers, round(avg(o_totalprice), 4) mean_price
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where o_totalprice > 1000 group by r_name, n_name""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mapped over three lookups, filtered and aggregated."""
    mapped = joins.map_rows(
        _t(spark, sf_dir, "orders"), "o", main_filter="o.o_totalprice > 1000",
        lookups=[Lookup("c", _t(spark, sf_dir, "customer"), {"c_custkey": "o.o_custkey"}, inner=True, matching="ALL_MATCHES"), Lookup("n", _t(spark, sf_dir, "nation"), {"n_nationkey": "c.c_nationkey"}, inner=True, matching="ALL_MATCHES"), Lookup("r", _t(spark, sf_dir, "region"), {"r_regionkey": "n.n_regionkey"}, inner=True, matching="ALL_MATCHES")],
        outputs=[Output("out", {"r_name": "r.r_name", "n_name": "n.n_name", "price": "o.o_totalprice", "custkey": "o.o_custkey"})],
    )["out"]
    out = agg.aggregate(mapped, ["r_name", "n_name"], [
        {"output": "total", "function": "sum", "input": "price", "scale": 4}, {"output": "orders_n", "function": "count", "input": "price"},
        {"output": "customers", "function": "count_distinct", "input": "custkey"}, {"output": "mean_price", "function": "avg", "input": "price", "scale": None},
    ])
    return out.withColumns({"total": F.col("total").cast("double"), "mean_price": F.round("mean_price", 4)})


@query("select c_custkey, c_mktsegment, c_acctbal from customer")
def filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_columns(_t(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_acctbal"])


_CONDITIONS = [
    {"column": "p_size", "operator": ">=", "value": "10"}, {"column": "p_type", "operator": "!=", "value": "x"},
    {"column": "p_name", "operator": "CONTAINS", "value": "r", "function": "LOWER"}, {"column": "p_brand", "operator": "LENGTH_GT", "value": 3},
    {"column": "p_brand", "operator": "MATCHES", "value": r"[A-Z]\w+ ?#?\d+"}, {"column": "p_size", "operator": "IS_NOT_NULL"},
]
_KEEP = r"p_size >= 10 and coalesce(p_type <> 'x', true) and contains(lower(p_name), 'r') and length(p_brand) > 3 and regexp_full_match(p_brand, '[A-Z]\w+ ?#?\d+')"
_PART = "(select p_partkey, p_name, p_brand, case when p_size > 40 then null else p_type end p_type, p_size from part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.expr("case when p_size > 40 then null else p_type end").alias("p_type"), "p_size")


@query(f"select * from {_PART} where {_KEEP}")
def filter_rows_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(_parts(spark, sf_dir), _CONDITIONS)["main"]


@query(f"select p_partkey, p_type, 'reject' tag from {_PART} where not ({_KEEP})")
def filter_rows_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.filter_rows(_parts(spark, sf_dir), _CONDITIONS)["reject"].select("p_partkey", "p_type", F.lit("reject").alias("tag"))


@query("select o_orderkey from orders where o_orderstatus like 'F%' or o_totalprice < 5000 or upper(left(o_orderpriority, 1)) = '1'")
def filter_rows_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [{"column": "o_orderstatus", "operator": "STARTS_WITH", "value": "F"}, {"column": "o_totalprice", "operator": "<", "value": 5000}, {"column": "o_orderpriority", "operator": "==", "value": "1", "function": "UPPER_FIRST"}]
    return rows.filter_rows(_t(spark, sf_dir, "orders"), some, "||")["main"].select("o_orderkey")


_RAW = "(select c_custkey, case when c_custkey % 5 = 0 then 'x' || c_custkey when c_custkey % 7 = 0 then '' else cast(c_custkey * 3 as varchar) end code from customer)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", F.expr("case when c_custkey % 5 = 0 then concat('x', c_custkey) when c_custkey % 7 = 0 then '' else cast(c_custkey * 3 as string) end").alias("code"))


@query(f"select c_custkey, cast(nullif(code, '') as bigint) code from {_RAW} where code not like 'x%'")
def convert_type_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.convert_type(_raw(spark, sf_dir), {"code": "bigint"})["main"]


@query(f"select c_custkey, code, 'CONVERSION_ERROR' error_code from {_RAW} where code like 'x%'")
def convert_type_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.convert_type(_raw(spark, sf_dir), {"code": "bigint"})["reject"].drop("error_message")


@query("select c_custkey, case when lower(c_mktsegment) = 'building' then 'house' else c_mktsegment end c_mktsegment, regexp_replace(c_name, '#0*([0-9]+)', '-\\1', 'g') c_name from customer")
def replace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.replace(_t(spark, sf_dir, "customer"), [{"column": "c_mktsegment", "search": "building", "replacement": "house"}])
    out = rows.replace(out, [{"column": "c_name", "search": "#0*([0-9]+)", "replacement": r"-\1", "use_regex": True, "case_sensitive": True}], strict_match=False)
    return out.select("c_custkey", "c_mktsegment", "c_name")


@query(f"""select c_custkey, code, 8 as "errorCode", case when code like 'x%' then 'code:invalid type' || case when length(code) > 4 then ';code:exceed max length' else '' end
  when code = '' then 'code:cannot be null' else 'code:exceed max length' end as "errorMessage" from {_RAW} where code like 'x%' or code = '' or length(code) > 4""")
def schema_compliance_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.schema_compliance(_raw(spark, sf_dir), [{"column": "code", "type": "int", "nullable": False, "length": 4}])["reject"]


@query(f"select c_custkey, try_cast(nullif(code, '') as bigint) code, 0.0::double extra from {_RAW}")
def schema_enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enforce(_raw(spark, sf_dir), [Field("c_custkey", "int", nullable=False), Field("code", "int"), Field("extra", "float", nullable=False)])["main"]


@query("select c_custkey as key, c_name as name, c_acctbal as balance, null::varchar as note from customer union all select s_suppkey, s_name, s_acctbal, 'supplier' from supplier")
def unite_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    return rows.unite(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("note")))


def _keyed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_custkey % 700, 0)").alias("k"), "o_totalprice")


_OK = "(select o_orderkey, nullif(o_custkey % 700, 0) k, o_totalprice from orders)"
_BUILDING = "(select * from customer where c_mktsegment = 'BUILDING')"


@query(f"select o_orderkey, k, o_totalprice, c_name segment_name from {_OK} o left join {_BUILDING} on k = c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(_keyed_orders(spark, sf_dir), _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), {"k": "c_custkey"}, lookup_columns={"segment_name": "c_name"})["main"]


@query(f"""select o_orderkey, k, 'JOIN_REJECT' as "errorCode" from {_OK} o where not exists (select 1 from {_BUILDING} where k = c_custkey)""")
def join_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.join(_keyed_orders(spark, sf_dir), _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), {"k": "c_custkey"}, inner=True)["reject"].select("o_orderkey", "k", "errorCode")


def _matching(matching: str) -> str:
    side = "desc" if matching != "FIRST_MATCH" else "asc"
    return f"""select c_custkey, o_orderkey, o_orderpriority from customer left join
      (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate {side}, o_orderkey {side}) = 1) on c_custkey = o_custkey"""


def _map_matching(spark: SparkSession, sf_dir: str, matching: str) -> DataFrame:
    side = Lookup("o", _t(spark, sf_dir, "orders"), {"o_custkey": "c.c_custkey"}, matching=matching, order_by=["o_orderdate", "o_orderkey"])
    return joins.map_rows(_t(spark, sf_dir, "customer"), "c", [side], [Output("out", {"c_custkey": "c.c_custkey", "o_orderkey": "o.o_orderkey", "o_orderpriority": "o.o_orderpriority"})])["out"]


@query(_matching("FIRST_MATCH"))
def map_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_matching(spark, sf_dir, "FIRST_MATCH")


@query(_matching("UNIQUE_MATCH"))
def map_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_matching(spark, sf_dir, "UNIQUE_MATCH")


@query("select c_custkey, o_orderkey, o_orderpriority from customer left join orders on c_custkey = o_custkey")
def map_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_matching(spark, sf_dir, "ALL_MATCHES")


@query(f"select o_orderkey, cast(null as varchar) c_name, 'none' tag from {_OK} o where not exists (select 1 from {_BUILDING} where k = c_custkey) and o_totalprice > 1000")
def map_inner_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = Lookup("c", _t(spark, sf_dir, "customer"), {"c_custkey": "o.k"}, inner=True, filter="c.c_mktsegment = 'BUILDING'")
    made = {"o_orderkey": "o.o_orderkey", "c_name": "c.c_name", "tag": "'none'"}
    return joins.map_rows(_keyed_orders(spark, sf_dir), "o", [side], [Output("out", made), Output("rejects", made, filter="o.o_totalprice > 1000", inner_join_reject=True)])["rejects"]


@query("select s_suppkey, n_name, cast(s_acctbal * 2 as double) doubled from supplier join nation on n_nationkey < 5 and s_nationkey > n_nationkey + 15")
def map_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = Lookup("n", _t(spark, sf_dir, "nation"), inner=True, filter="n.n_nationkey < 5", condition="s.s_nationkey > n.n_nationkey + 15")
    return joins.map_rows(_t(spark, sf_dir, "supplier"), "s", [side], [Output("out", {"s_suppkey": "s.s_suppkey", "n_name": "n.n_name", "doubled": "Var.twice"})], variables={"twice": "s.s_acctbal * 2"})["out"]


@query("""select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > c_acctbal * 20
  qualify row_number() over (partition by c_custkey order by o_orderkey desc) = 1""")
def map_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = Lookup("o", _t(spark, sf_dir, "orders"), {"o_custkey": "c.c_custkey"}, condition="o.o_totalprice > c.c_acctbal * 20", order_by=["o_orderkey"])
    return joins.map_rows(_t(spark, sf_dir, "customer"), "c", [side], [Output("out", {"c_custkey": "c.c_custkey", "o_orderkey": "o.o_orderkey"})])["out"]


@query("""select o_orderkey, case when o_totalprice > 100000 then 'large' when o_orderstatus = 'F' then 'final' else 'rest' end route from orders where o_totalprice > 100000 or o_orderstatus <> 'F'
  union all select o_orderkey, 'final' from orders where o_orderstatus = 'F'""")
def map_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda tag: {"o_orderkey": "o.o_orderkey", "route": f"'{tag}'"}
    out = joins.map_rows(_t(spark, sf_dir, "orders"), "o", outputs=[Output("large", made("large"), "Var.price > 100000"), Output("final", made("final"), "o.o_orderstatus = 'F'"), Output("rest", made("rest"), is_reject=True)], variables={"price": "o.o_totalprice"})
    return rows.unite(out["large"], out["final"], out["rest"])


@query("""select o_orderkey, round(o_totalprice / (o_custkey % 7), 4) ratio, null::varchar "errorMessage" from orders where o_custkey % 7 <> 0
  union all select o_orderkey, null, case when o_custkey % 14 = 0 then 'no share' else 'no ratio' end from orders where o_custkey % 7 = 0""")
def map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = [Output("main", {"o_orderkey": "o.o_orderkey", "ratio": "round(Var.ratio, 4)"}), Output("caught", {"o_orderkey": "o.o_orderkey"}, catch_errors=True)]
    errors = {"no share": "o.o_custkey % 14 = 0", "no ratio": "o.o_custkey % 7 = 0"}
    out = joins.map_rows(_t(spark, sf_dir, "orders"), "o", outputs=outputs, variables={"ratio": "o.o_totalprice / (o.o_custkey % 7)"}, errors=errors)
    return out["main"].unionByName(out["caught"], allowMissingColumns=True)


@query("""select l_returnflag, l_linestatus, count(*) n, count(distinct l_suppkey) suppliers, sum(cast(l_extendedprice as decimal(38,4)))::double total, round(avg(l_quantity), 6) mean_quantity,
  min(l_shipdate) first_ship, max(l_shipdate) last_ship, round(stddev_samp(l_discount), 8) sd, round(stddev_pop(l_discount), 8) sd_pop, round(var_samp(l_tax), 8) variance, median(l_quantity) med
  from lineitem group by l_returnflag, l_linestatus""")
def aggregate_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [("n", "count", "l_orderkey"), ("suppliers", "count_distinct", "l_suppkey"), ("total", "sum", "l_extendedprice"), ("mean_quantity", "avg", "l_quantity"), ("first_ship", "min", "l_shipdate"), ("last_ship", "max", "l_shipdate"), ("sd", "std", "l_discount"), ("sd_pop", "population_std_dev", "l_discount"), ("variance", "variance", "l_tax"), ("med", "median", "l_quantity")]
    out = agg.aggregate(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [{"output": o, "function": f, "input": i, "scale": 4 if f == "sum" else None} for o, f, i in ops])
    return out.withColumns({"total": F.col("total").cast("double"), "mean_quantity": F.round("mean_quantity", 6), "sd": F.round("sd", 8), "sd_pop": F.round("sd_pop", 8), "variance": F.round("variance", 8)})


@query("""select o_custkey, arg_min(o_orderpriority, o_orderkey) first_priority, arg_max(o_orderpriority, o_orderkey) last_priority, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) all_keys,
  '[' || string_agg(o_orderstatus, ', ' order by o_orderkey) || ']' statuses, (select string_agg(x, ',' order by x) from (select unnest(list_distinct(list(o_orderpriority))) x)) priorities from orders group by o_custkey""")
def aggregate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [("first_priority", "first", "o_orderpriority"), ("last_priority", "last", "o_orderpriority"), ("all_keys", "list", "o_orderkey"), ("statuses", "list_object", "o_orderstatus"), ("priorities", "union", "o_orderpriority")]
    return agg.aggregate(_t(spark, sf_dir, "orders"), ["o_custkey"], [{"output": o, "function": f, "input": i} for o, f, i in ops], order_by=["o_orderkey"])


@query(f"""select p_type, count(p_type_2) n, case when count(p_type_2) = count(*) then sum(p_size)::bigint end strict_sum from (select p_type, p_size, case when p_size % 10 = 0 and p_type like '%A%' then null else p_size end p_type_2 from {_PART}) where p_type is not null group by p_type""")
def aggregate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _parts(spark, sf_dir).withColumn("v", F.expr("case when p_size % 10 = 0 and p_type like '%A%' then null else p_size end"))
    out = agg.aggregate(df, ["p_type"], [{"output": "n", "function": "count", "input": "v"}, {"output": "strict_sum", "function": "sum", "input": "v", "ignore_null": False, "scale": 0}])
    return out.withColumn("strict_sum", F.col("strict_sum").cast("bigint"))


@query(f"select {_LINE} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_LINE}) = 1")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.unique_rows(_t(spark, sf_dir, "lineitem").select(*LINE_ORDER), ["l_orderkey", "l_linenumber"], order_by=LINE_ORDER)["unique"]


@query(f"select {_LINE} from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {_LINE}) > 1")
def unique_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.unique_rows(_t(spark, sf_dir, "lineitem").select(*LINE_ORDER), ["l_orderkey", "l_linenumber"], order_by=LINE_ORDER)["duplicate"]


@query("select o_custkey, o_orderstatus, string_agg(o_orderpriority, '|' order by o_orderkey) o_orderpriority from orders group by o_custkey, o_orderstatus")
def denormalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.denormalize(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority"), [{"column": "o_orderpriority", "delimiter": "|"}], ["o_orderkey"])


@query("select p_partkey, trim(item) p_name from (select p_partkey, unnest(string_split(p_name || ', ' || p_type, ',')) item from part)")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", "p_name", "p_type").alias("p_name"))
    return reshape.normalize(df, "p_name", trim=True)


@query(f"""select p_partkey, 'p_brand' pivot_key, p_brand pivot_value from {_PART} union all select p_partkey, 'p_type', p_type from {_PART} where p_type is not null
  union all select p_partkey, 'p_size', cast(p_size as varchar) from {_PART}""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot(_parts(spark, sf_dir).drop("p_name"), ["p_partkey"], include_empty=False)


@query("""select c_nationkey, coalesce(cast(sum(c_custkey) filter (c_mktsegment = 'BUILDING') as varchar), '') "BUILDING", coalesce(cast(sum(c_custkey) filter (c_mktsegment = 'MACHINERY') as varchar), '') "MACHINERY" from customer group by c_nationkey""")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reshape.pivot(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey", order_by=["c_custkey"])
    return out.select("c_nationkey", "BUILDING", "MACHINERY")


@query("select s_name as name, 'balance' as what, cast(s_suppkey as varchar) as value from supplier union all select s_name, 'nation', cast(s_nationkey as varchar) from supplier")
def split_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.split_row(_t(spark, sf_dir, "supplier"), [{"name": "row1.s_name", "what": "'balance'", "value": "row1.s_suppkey"}, {"name": "row1.s_name", "what": '"nation"', "value": "row1.s_nationkey"}])


@query("select c_custkey, c_acctbal, rn from (select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) rn from customer) where rn = 1 or rn = 7 or rn between 20 and 40")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (-F.col("c_acctbal")).alias("down"))
    picked = order.sample_rows(df, "1, 7, 20..40", ["down", "c_custkey"])["main"]
    ranked = order.numbered(df, ["down", "c_custkey"], "rn").select("c_custkey", "rn")
    return picked.join(ranked, "c_custkey").select("c_custkey", "c_acctbal", "rn")


@query("select o_orderkey, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 100")
def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [{"column": "o_orderpriority"}, {"column": "o_totalprice", "type": "num", "order": "desc"}, {"column": "o_orderkey", "type": "num"}]
    return order.sort_rows(_t(spark, sf_dir, "orders"), keys).select("o_orderkey", "o_totalprice").limit(100)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) place from orders")
def sort_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their place in the sorted order."""
    df = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", (-F.col("o_totalprice")).alias("down"))
    return order.numbered(df, ["o_orderpriority", "down", "o_orderkey"], "place").select("o_orderkey", "o_totalprice", "place")


@query("""with r as (select o_custkey, o_orderkey, cast(round(o_totalprice, 2) as decimal(18,2)) amount, case when o_orderstatus = 'F' then 'D' else 'C' end flag,
    (row_number() over (partition by o_custkey order by cast(o_orderkey as varchar)) - 1) // 5 + 1 page from orders),
  p as (select o_custkey, page, sum(case when flag = 'D' then amount else 0 end) d, sum(case when flag = 'D' then 0 else amount end) c from r group by all),
  b as (select *, 100 + sum(c - d) over (partition by o_custkey order by page) closing from p)
  select r.o_custkey, o_orderkey, r.page, d::double page_debit, c::double page_credit, (closing - c + d)::double page_opening, closing::double page_closing from r join b on r.o_custkey = b.o_custkey and r.page = b.page""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.expr("case when o_orderstatus = 'F' then 'D' else 'C' end").alias("flag"), F.lit("100").alias("open"))
    out = order.paginate(df, "o_custkey", "amount", "flag", "open", ["o_orderkey"], page_size=5)
    return out.select("o_custkey", "o_orderkey", "page", *[F.col(c).cast("double").alias(c) for c in ("page_debit", "page_credit", "page_opening", "page_closing")])


@query("select c_custkey, 10 + (row_number() over (partition by c_nationkey order by c_custkey) - 1) * 5 as number from customer")
def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", order.sequence(10, 5, ["c_custkey"], ["c_nationkey"]).cast("bigint").alias("number"))


@query("select o_orderkey_0 v0, o_orderkey_1 v1 from (select max(o_orderkey) o_orderkey_0, (select o_orderkey from orders order by o_orderkey desc limit 1 offset 1) o_orderkey_1 from orders)")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order.last_rows(_t(spark, sf_dir, "orders").select("o_orderkey"), 2, ["o_orderkey"])
    return spark.createDataFrame([(cells["o_orderkey_0"], cells["o_orderkey_1"])], "v0 long, v1 long")


_JOINED = "concat_ws(';', c_custkey, c_mktsegment, case when c_custkey % 3 = 0 then null else c_nationkey end)"


@query("select c_custkey, cast(c_custkey as varchar) a, c_mktsegment b, case when c_custkey % 3 = 0 then null else cast(c_nationkey as varchar) end c from customer")
def extract_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_JOINED).alias("line"))
    return extract.extract_delimited(df, "line", ["a", "b", "c"])["main"].drop("line")


@query("""select c_custkey, 'FIELD_COUNT_MISMATCH' as "errorCode" from customer where c_custkey % 3 = 0""")
def extract_delimited_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_JOINED).alias("line"))
    return extract.extract_delimited(df, "line", ["a", "b", "c"], check_fields_num=True)["reject"].select("c_custkey", "errorCode")


@query(r"select p_partkey, regexp_extract(p_brand, '([A-Za-z]+)\D*(\d+)', 1) word, regexp_extract(p_brand, '([A-Za-z]+)\D*(\d+)', 2) digits from part")
def extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_regex(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", r"([A-Za-z]+)\D*(\d+)", ["word", "digits"])["main"].drop("p_brand")


@query("select o_orderkey, substr(o_orderpriority, 1, 1) rank, substr(o_orderpriority, 2, 4) rest from orders")
def extract_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_positional(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", [1, 4], ["rank", "rest"])["main"].drop("o_orderpriority")


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') k, '' missing from events")
def extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_json(_t(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": "$.k", "missing": "$.none"})["main"].drop("props")


@query("select c_custkey, cast(n as varchar) n from customer, (values (1), (2)) v(n)")
def extract_json_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.lit('{"rows": [{"n": 1}, {"n": 2}]}').alias("doc"))
    return extract.extract_json(df, "doc", {"n": "$.n"}, "$.rows[*]")["main"].drop("doc")


_XML = "concat('<d xmlns=\"u\"><n id=\"', {0}, '\"><name>', {1}, '</name></n><n id=\"x\"/></d>')"


@query("select s_suppkey, cast(s_suppkey as varchar) id, s_name as name from supplier union all select s_suppkey, 'x', '' from supplier")
def extract_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_XML.format("s_suppkey", "s_name")).alias("doc"))
    return extract.extract_xml(df, "doc", "/d/n", {"id": "@id", "name": "name"})["main"].drop("doc")


@query("select cast(s_suppkey as varchar) id, s_name as name from supplier")
def xml_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "supplier").select(F.expr(_XML.format("s_suppkey", "s_name")).alias("doc"))
    return extract.xml_map(df, "doc", "/d/n", {"id": "@id", "name": "name"}, "id <> 'x'")["main"]


@query("select cast(event_id as varchar) id, event_type as type from events")
def parse_record_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "events").select(F.to_json(F.array(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))).alias("set"))
    return extract.parse_record_set(df, "set", ["id", "type"])


@query("""select c_custkey, lower(c_name) down, length(c_name) len, strpos(c_name, '#') - 1 idx, right(c_name, 3) tail, case when length(c_mktsegment) >= 12 then c_mktsegment else rpad(c_mktsegment, 12, '*') end padded,
  length(c_mktsegment) - length(replace(c_mktsegment, 'I', '')) i_count, c_custkey % 7 as rest, c_custkey // 7 as whole, c_custkey & 12 bits, case c_nationkey when 1 then 'one' when 2 then 'two' else 'many' end spelled, to_hex(c_custkey) hexed from (select *, lower(to_hex(c_custkey)) h from customer)""".replace("to_hex(c_custkey) hexed from (select *, lower(to_hex(c_custkey)) h from customer)", "lower(to_hex(c_custkey)) hexed from customer"))
def routines_text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    S, M, name, seg, key = StringHandling, Mathematical, F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", S.DOWNCASE(name).alias("down"), S.LEN(name).alias("len"), S.INDEX(name, "#").alias("idx"), S.RIGHT(name, 3).alias("tail"), S.RPAD(seg, 12, "*").alias("padded"), S.COUNT(seg, "I").alias("i_count"),
        M.MOD(key, F.lit(7)).alias("rest"), M.DIV(key, F.lit(7)).alias("whole"), M.BITAND(key, F.lit(12)).alias("bits"), Text.DECODE(F.col("c_nationkey"), F.lit("many"), 1, F.lit("one"), 2, F.lit("two")).alias("spelled"), DataOperation.DTX(key).alias("hexed"),
    )


@query("""select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') shown, month(o_orderdate) - 1 as month0, dayofweek(o_orderdate) + 1 as weekday, strftime(o_orderdate + interval 40 day, '%Y-%m-%d') later,
  date_diff('day', timestamp '1992-01-01', o_orderdate) as day_count, strftime(last_day(o_orderdate), '%Y-%m-%d') month_end, case when o_orderdate < timestamp '1995-01-01' then -1 when o_orderdate > timestamp '1995-01-01' then 1 else 0 end cmp from orders""")
def routines_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, fixed = F.col("o_orderdate"), lambda s: F.lit(s).cast("timestamp_ntz")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", Dates.formatDate("dd/MM/yyyy", d).alias("shown"), Dates.getPartOfDate("MONTH", d).alias("month0"), Dates.getPartOfDate("DAY_OF_WEEK", d).alias("weekday"), F.date_format(Dates.addDate(d, 40, "dd"), "yyyy-MM-dd").alias("later"),
        Dates.diffDate(d, fixed("1992-01-01")).alias("day_count"), F.date_format(Dates.getLastDayOfMonth(d), "yyyy-MM-dd").alias("month_end"), Dates.compareDate(d, fixed("1995-01-01")).alias("cmp"),
    )


@query("select range id, range * 3 as triple, case when range % 2 = 0 then 'even' else 'odd' end parity from range(1000)")
def row_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_rows(spark, 1000, {"id": "id", "triple": "id * 3", "parity": "if(id % 2 = 0, 'even', 'odd')"})


@query("select * from (values (1::bigint, 'a'), (2, 'b'), (null, 'c')) t(n, s)")
def fixed_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_rows(spark, "n bigint, s string", content="1;a\n2;b\nx;c")


@query("select c_custkey, lpad(cast(c_custkey as varchar), 8, '0') || rpad(c_mktsegment, 12, ' ') as line from customer")
def positional_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer")
    return df.select("c_custkey", positional_line(df, [{"column": "c_custkey", "size": 8, "padding": "0", "align": "R"}, {"column": "c_mktsegment", "size": 12}]).alias("line"))


@query("""select n_regionkey, '<region n_regionkey="' || n_regionkey || '">' || string_agg('<nation><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name></nation>', '' order by n_nationkey) || '</region>' as xml from nation group by n_regionkey""")
def nested_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_xml(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_regionkey"], "region", "nation", ["n_nationkey"])


@query("select o_orderkey, '20' reference, cast(i - 1 as int) line_no, '2401' || case when i = 1 then '02' else '03' end || 'D' || o_orderkey || ',5' field61, case when i = 1 then 'paid by card' end field86 from orders, range(1, 3) t(i)")
def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('{1:F01BANK}{2:O940}{4:\\n:20:20\\n:61:240102D', o_orderkey, ',5\\n:86:paid\\nby card\\n:61:240103D', o_orderkey, ',5\\n-}{5:{CHK:1}}')"
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("message"))
    lines = messages.statement_lines(messages.parse_messages(df, "message"))
    return lines.select("o_orderkey", messages.message_field("20").alias("reference"), "line_no", "field61", "field86")


def _movements(orders: DataFrame) -> DataFrame:
    df = orders.select("o_orderkey", "o_orderstatus", F.expr("concat('240102D', o_orderkey, ',5NTRFref')").alias("line"))
    parts = messages.movement("line")
    df = df.select("o_orderkey", "o_orderstatus", parts["value_date"].cast("string").alias("value_date"), parts["mark"].alias("mark"), parts["amount"].cast("double").alias("amount"), parts["reference"].alias("reference"))
    df = messages.transform_messages(df, [{"name": "both", "type": "concatenate", "sources": ["reference", "o_orderkey"]}, {"name": "label", "type": "expression", "expression": "concat(both, '/', o_orderstatus)"}])
    return df.select("o_orderkey", "value_date", "mark", "amount", "label")


@query("select o_orderkey, '2024-01-02' value_date, 'D' mark, cast(o_orderkey + 0.5 as double) amount, 'ref' || o_orderkey || '/F' label from orders where o_orderstatus = 'F'")
def message_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _movements(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"))


@query("select o_orderkey, '2024-01-02' value_date, 'D' mark, cast(o_orderkey + 0.5 as double) amount, 'ref' || o_orderkey || '/' || o_orderstatus label from orders")
def message_transform_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _movements(_t(spark, sf_dir, "orders"))


def _row_code(row: dict) -> dict | None:
    if row["s_suppkey"] % 10 == 0:
        raise ValueError("tenth")
    return {"s_suppkey": row["s_suppkey"], "label": f"{row['s_name']}-{row['s_nationkey']}"}


@query("select s_suppkey, s_name || '-' || s_nationkey as label from supplier where s_suppkey % 10 <> 0")
def python_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_rows(_t(spark, sf_dir, "supplier"), _row_code, "s_suppkey long, label string")["main"]


@query("""select s_suppkey, 'ValueError: tenth' as "errorMessage" from supplier where s_suppkey % 10 = 0""")
def python_rows_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_rows(_t(spark, sf_dir, "supplier"), _row_code, "s_suppkey long, label string")["reject"].select("s_suppkey", "errorMessage")


def _group_code(x: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"s_nationkey": [x["s_nationkey"].iloc[0]], "n": [len(x)], "top": [int(x["s_suppkey"].max())]})


@query("select s_nationkey, count(*) n, max(s_suppkey) top from supplier group by s_nationkey")
def python_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.python_groups(_t(spark, sf_dir, "supplier"), ["s_nationkey"], _group_code, "s_nationkey int, n long, top long")


@query("select c_mktsegment, count(*) n from customer where c_acctbal > 100 group by c_mktsegment")
def job_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = Job(spark, {"least": 100})
    job.run([
        Step("read", lambda: _t(spark, sf_dir, "customer")), Step("keep", rows.filter_rows, ["read"], {"conditions": [{"column": "c_acctbal", "operator": ">", "value": "${context.least}"}]}),
        Step("never", rows.filter_columns, ["read"], run_if=lambda g: "x" in g), Step("sum", agg.aggregate, ["keep"], {"group_by": ["c_mktsegment"], "operations": [{"output": "n", "function": "count", "input": "c_custkey"}]}),
    ])
    return job.flows["sum.main"]


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


@query("select c_custkey, c_name, c_acctbal from customer")
def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_delimited(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, separator="||")
    return files.read_delimited(spark, path, [Field("c_custkey", "int"), Field("c_name"), Field("c_acctbal", "float")], separator="||", encoding="UTF-8")["main"]


@query("select o_orderkey, o_orderpriority from orders order by o_orderkey limit 1000")
def delimited_header_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in key order, each with a header; the limit is the reader's."""
    path = _folder(spark)
    ordered = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")
    sinks.write_delimited(ordered, path, header=True)
    return files.read_delimited(spark, path, [Field("o_orderkey", "int"), Field("o_orderpriority")], header=1, limit=1000, encoding="UTF-8")["main"]


@query("select cast(s_suppkey as varchar) line from supplier where s_suppkey not in (select s_suppkey from supplier order by s_suppkey limit 4)")
def full_rows_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of the few suppliers, the smallest keys last as its footer."""
    path = _folder(spark)
    sinks.write_delimited(_t(spark, sf_dir, "supplier").select("s_suppkey").repartition(1).sortWithinPartitions(F.desc("s_suppkey")), path)
    return files.read_full_rows(spark, path, "line", footer=4)


@query("select s_suppkey, s_name, s_acctbal from supplier")
def positional_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_positional(_t(spark, sf_dir, "supplier"), path, [{"column": "s_suppkey", "size": 12, "align": "R"}, {"column": "s_name", "size": 30}, {"column": "s_acctbal", "size": 20, "align": "R"}])
    return files.read_positional(spark, path, [Field("s_suppkey", "int"), Field("s_name"), Field("s_acctbal", "float")], [12, 30, 20])["main"]


@query("select cast(n_nationkey as varchar) n_nationkey, n_name from nation")
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_xml(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, row_tag="nation", root_tag="nations")
    return files.read_xml_rows(spark, path, "nation", ["n_nationkey", "n_name"])


@query("select count(*) n from events")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_delimited(_t(spark, sf_dir, "events").select("event_id", "event_type"), path)
    return spark.createDataFrame([(files.count_rows(spark, path),)], "n long")


@query(_matching("LAST_MATCH"))
def map_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map_matching(spark, sf_dir, "LAST_MATCH")


@query(f"select c_custkey, code from {_RAW} where code <> '' and code not like 'x%' and length(code) <= 4")
def schema_compliance_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.schema_compliance(_raw(spark, sf_dir), [{"column": "code", "type": "int", "nullable": False, "length": 4}])["main"]


@query("select r_name, n as copy from region, (values (0), (1), (2)) v(n)")
def replicate_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = rows.replicate(_t(spark, sf_dir, "region").select("r_name"), 2)
    return rows.unite(*[df.withColumn("copy", F.lit(i)) for i, df in enumerate(flows.values())])


@query("select o_orderkey, 100 + (row_number() over (order by o_totalprice, o_orderkey) - 1) * 2 as number from orders")
def number_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.number_rows(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "number", ["o_totalprice", "o_orderkey"], 100, 2).drop("o_totalprice")


@query("""select c_custkey, coalesce(list_filter(range(3, len(c_name) + 1), lambda i: substr(c_name, i, 1) = '0')[2], 0)::int third, coalesce(list_reverse(list_filter(range(1, len(c_name)), lambda i: substr(c_name, i, 1) = '0'))[1], 0)::int back,
  ltrim(c_name, 'Cust') cut, rtrim(c_mktsegment, 'GERY') short, c_custkey / 100.0 as implied, 0 as outside from customer""")
def routines_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, drawn = F.col("c_name"), Numeric.random(3, 9, 5)
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", StringHandling.INSTR(name, "0", 3, 2).alias("third"), StringHandling.INSTR(name, "0", -2, 1).alias("back"), StringHandling.LTRIM(name, "Cust").alias("cut"), StringHandling.RTRIM(F.col("c_mktsegment"), "GERY").alias("short"),
        Numeric.convertImpliedDecimalFormat("999V99", F.col("c_custkey").cast("string")).cast("double").alias("implied"), F.when(drawn.between(3, 9), 0).otherwise(1).alias("outside"),
    )


@query("""select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') shown, strftime(o_orderdate + interval 2 month, '%Y-%m-%d') later, strftime(o_orderdate - interval 36 hour, '%Y-%m-%d %H:%M') before,
  strftime(make_timestamp(year(o_orderdate), month(o_orderdate), 9, hour(o_orderdate), minute(o_orderdate), 0.0), '%Y-%m-%d %H:%M') ninth, datesub('month', timestamp '1995-06-17', o_orderdate) as months, trunc(datesub('month', timestamp '1995-06-17', o_orderdate) / 12.0)::bigint as years,
  strftime(o_orderdate, '%Y-%m-%d') again, null::varchar as blank from orders""")
def routines_more_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, fixed = F.col("o_orderdate"), F.lit("1995-06-17").cast("timestamp_ntz")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", Dates.TO_CHAR(d, "yyyy/MM/dd").alias("shown"), day(Dates.ADD_TO_DATE(d, "MONTH", 2)).alias("later"), F.date_format(Dates.ADD_TO_DATE(d, "HH", -36), "yyyy-MM-dd HH:mm").alias("before"),
        F.date_format(Dates.setDate(d, 9, "dd"), "yyyy-MM-dd HH:mm").alias("ninth"), Dates.diffDateFloor(d, fixed).alias("months"), Dates.diffDateFloor(d, fixed, "yyyy").alias("years"),
        day(Dates.TO_DATE(F.date_format(d, "MM/dd/yyyy HH:mm:ss.SSS"))).alias("again"), day(Dates.TO_DATE(F.lit(" "))).alias("blank"),
    )
