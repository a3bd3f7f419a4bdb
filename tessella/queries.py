"""The queries that the driver runs, each with SQL that must give the same rows.

Most are statements of the dialect over the generated tables; the rest use operators directly.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import facets, joins
from .operators.describe import is_clustered
from .sources.parquet import read_parquet

FLAT_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: name: (base table, statement of the dialect, SQL of the oracle; None where the statement serves as both)
_STATEMENTS: dict[str, tuple[str, str, str | None]] = {
    # filters and predicates
    "filter_cmp": ("lineitem", "select l_orderkey, l_linenumber, l_quantity from t where l_quantity >= 45 and l_discount < 0.03 and l_returnflag <> 'N' and not l_linenumber > 5", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_quantity from lineitem where l_quantity >= 45 and l_discount < 0.03 and l_returnflag <> 'N' and not l_linenumber > 5"),
    "filter_3vl_not": ("orders", "select count(*) as n from t where not (nullif(o_orderstatus, 'F') = 'O')", "select count(*) as n from orders where not (nullif(o_orderstatus, 'F') = 'O')"),
    "between": ("part", "select p_partkey, p_size from t where p_size between 10 and 12", "select p_partkey, cast(p_size as bigint) as p_size from part where p_size between 10 and 12"),
    "not_between": ("part", "select count(*) as n from t where p_retailprice not between 950 and 1500", "select count(*) as n from part where p_retailprice not between 950 and 1500"),
    "between_fn": ("part", "select count(*) as n from t where between(p_size, 3, 9)", "select count(*) as n from part where p_size between 3 and 9"),
    "in_list": ("lineitem", "select l_shipdate, l_returnflag from t where l_linenumber in (6, 7) and l_returnflag in ('A', 'R')", "select l_shipdate, l_returnflag from lineitem where l_linenumber in (6, 7) and l_returnflag in ('A', 'R')"),
    "not_in_null": ("part", "select count(*) as n from t where p_size not in (1, 2, null)", "select count(*) as n from part where p_size not in (1, 2, null)"),
    "in_list_long": ("orders", "select o_orderkey from t where o_orderkey in (" + ", ".join(str(i * 7) for i in range(60)) + ")", "select o_orderkey from orders where o_orderkey in (" + ", ".join(str(i * 7) for i in range(60)) + ")"),
    "row_value_in": ("lineitem", "select count(*) as n from t where (l_returnflag, l_linestatus) in (('A', 'F'), ('N', 'O')) and (l_linenumber, l_returnflag) not in ((1, 'A'))", "select count(*) as n from lineitem where ((l_returnflag = 'A' and l_linestatus = 'F') or (l_returnflag = 'N' and l_linestatus = 'O')) and not (l_linenumber = 1 and l_returnflag = 'A')"),
    "is_null": ("orders", "select count(*) as n from t where nullif(o_orderpriority, '1-URGENT') is null and o_custkey is not null", "select count(*) as n from orders where nullif(o_orderpriority, '1-URGENT') is null and o_custkey is not null"),
    "like_contains": ("part", "select p_partkey, p_name from t where p_name like '%E%g%'", "select p_partkey, p_name from part where p_name ilike '%E%g%'"),
    "like_prefix": ("customer", "select count(*) as n from t where c_mktsegment like 'b%'", "select count(*) as n from customer where c_mktsegment ilike 'b%'"),
    "like_suffix": ("customer", "select count(*) as n from t where c_name ilike '%9'", "select count(*) as n from customer where c_name ilike '%9'"),
    "like_underscore": ("part", "select count(*) as n from t where p_brand like 'brand__2'", "select count(*) as n from part where p_brand ilike 'brand__2'"),
    "not_like": ("part", "select count(*) as n from t where p_type not like '%E%' and not like(p_brand, 'x%')", "select count(*) as n from part where p_type not ilike '%E%' and not p_brand ilike 'x%'"),
    "case_when": ("orders", "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from t", "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders"),
    "case_no_else": ("orders", "select o_orderkey, case when o_orderstatus = 'F' then 1 end as f from t", "select o_orderkey, cast(case when o_orderstatus = 'F' then 1 end as bigint) as f from orders"),
    "if_fn": ("part", "select p_partkey, if(p_size > 25, 'big', 'small') as c from t", "select p_partkey, case when p_size > 25 then 'big' else 'small' end as c from part"),
    "in_fn": ("part", "select count(*) as n from t where in(p_size, 3, 5, 8)", "select count(*) as n from part where p_size in (3, 5, 8)"),
    "isnull_fn": ("part", "select count(*) as n from t where isnull(nullif(p_size, 3))", "select count(*) as n from part where nullif(p_size, 3) is null"),
    # arithmetic and casts
    "int_div": ("lineitem", "select l_orderkey, l_linenumber, (l_orderkey - 100) / 7 as d from t", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(trunc((l_orderkey - 100) / 7.0) as bigint) as d from lineitem"),
    "int_mod": ("lineitem", "select l_orderkey, l_linenumber, (l_orderkey - 100) % 7 as m from t", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast((l_orderkey - 100) % 7 as bigint) as m from lineitem"),
    "div_zero_null": ("part", "select p_partkey, p_size / (p_size - p_size) as a, p_size % 0 as b, p_retailprice / 0.0 as c from t", "select p_partkey, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as double) as c from part"),
    "float_arith": ("lineitem", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as v, -l_tax as neg from t", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice * (1 - l_discount) as v, -l_tax as neg from lineitem"),
    "cast_int": ("orders", "select o_orderkey, cast(o_totalprice as int) as a, int(substr(o_orderpriority, 1, 1)) as b, int(o_orderstatus) as c from t", "select o_orderkey, cast(trunc(o_totalprice) as bigint) as a, cast(substr(o_orderpriority, 1, 1) as bigint) as b, cast(null as bigint) as c from orders"),
    "cast_float": ("orders", "select o_orderkey, cast(o_custkey as float) as a, float('1.5') as b, float(o_orderstatus) as c, float(' 2e3 ') as d from t", "select o_orderkey, cast(o_custkey as double) as a, cast(1.5 as double) as b, cast(null as double) as c, cast(2000 as double) as d from orders"),
    "cast_text": ("lineitem", "select l_orderkey, l_linenumber, text(l_quantity) as a, cast(l_linenumber as text) as b, text(l_orderkey > 5) as c from t", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(cast(l_quantity as bigint) as varchar) as a, cast(l_linenumber as varchar) as b, case when l_orderkey > 5 then '1' else '0' end as c from lineitem"),
    # math
    "abs": ("customer", "select c_custkey, abs(c_acctbal) as a, abs(5 - c_custkey) as b from t", "select c_custkey, abs(c_acctbal) as a, abs(5 - c_custkey) as b from customer"),
    "round_digits": ("customer", "select c_custkey, round(c_acctbal) as a, round(c_acctbal, 1) as b, round(c_custkey) as c from t", "select c_custkey, round(c_acctbal) as a, round(c_acctbal * 10.0) / 10.0 as b, c_custkey as c from customer"),
    "floor_ceil": ("customer", "select c_custkey, floor(c_acctbal) as a, ceil(c_acctbal) as b, floor(c_custkey) as c from t", "select c_custkey, floor(c_acctbal) as a, ceil(c_acctbal) as b, c_custkey as c from customer"),
    "sign": ("customer", "select c_custkey, sign(c_acctbal) as s from t", "select c_custkey, cast(sign(c_acctbal) as bigint) as s from customer"),
    "sqrt_guard": ("customer", "select c_custkey, round(sqrt(c_acctbal), 6) as s from t", "select c_custkey, case when c_acctbal >= 0 then round(sqrt(c_acctbal) * 1000000.0) / 1000000.0 end as s from customer"),
    "exp_ln": ("part", "select p_partkey, round(exp(p_size / 10.0), 6) as e, round(ln(p_retailprice), 6) as l, ln(p_size - p_size) as z from t", "select p_partkey, round(exp(p_size / 10.0::double) * 1000000.0) / 1000000.0 as e, round(ln(p_retailprice) * 1000000.0) / 1000000.0 as l, cast(null as double) as z from part"),
    "pow": ("part", "select p_partkey, pow(p_size, 2) as a, power(-1.0, 0.5) as b from t", "select p_partkey, pow(cast(p_size as double), 2.0) as a, cast(null as double) as b from part"),
    # texts
    "upper_lower": ("part", "select p_partkey, upper(p_name) as u, lower(p_brand) as l from t", "select p_partkey, upper(p_name) as u, lower(p_brand) as l from part"),
    "length": ("part", "select p_partkey, length(p_name) as n from t", "select p_partkey, cast(length(p_name) as bigint) as n from part"),
    "length_unicode": ("documents", "select doc_id, length(text) as n, lower(text) as u from t", "select doc_id, cast(length(text) as bigint) as n, lower(text) as u from documents"),
    "substr": ("part", "select p_partkey, substr(p_name, 3) as a, substr(p_name, 2, 4) as b, substr(p_name, -3, 2) as c, substr(p_name, 2, -1) as d from t", "select p_partkey, substr(p_name, 3) as a, substr(p_name, 2, 4) as b, substr(p_name, -3, 2) as c, '' as d from part"),
    "concat_op": ("nation", "select n_name || '/' || text(n_regionkey) as a, concat(n_name, 1, 'x') as b from t", "select n_name || '/' || n_regionkey as a, n_name || '1x' as b from nation"),
    "trim_chars": ("part", "select p_partkey, trim(p_brand, 'Bd#1') as a, ltrim('  x ') as b, rtrim(p_brand, '0123456789') as c from t", "select p_partkey, trim(p_brand, 'Bd#1') as a, 'x ' as b, rtrim(p_brand, '0123456789') as c from part"),
    "replace": ("part", "select p_partkey, replace(p_type, 'E', '__') as r, replace(p_type, '', 'x') as s from t", "select p_partkey, replace(p_type, 'E', '__') as r, p_type as s from part"),
    "instr": ("part", "select p_partkey, instr(p_type, 'E') as a, instr(p_name, 'zzz') as b from t", "select p_partkey, cast(instr(p_type, 'E') as bigint) as a, cast(0 as bigint) as b from part"),
    "coalesce": ("orders", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderstatus, 'F'), 'none') as c from t", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderstatus, 'F'), 'none') as c from orders"),
    "nullif": ("orders", "select o_orderkey, nullif(o_orderstatus, 'P') as c from t", "select o_orderkey, nullif(o_orderstatus, 'P') as c from orders"),
    "ifnull": ("orders", "select o_orderkey, ifnull(nullif(o_orderstatus, 'P'), '?') as c from t", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') as c from orders"),
    # dates
    "ymd": ("orders", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from t", "select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(day(o_orderdate) as bigint) as d from orders"),
    "hms": ("events", "select event_id, hour(ts) as h, minute(ts) as m, second(ts) as s from t", "select event_id, cast(hour(ts) as bigint) as h, cast(minute(ts) as bigint) as m, cast(second(ts) as bigint) as s from events"),
    "date_ctor": ("orders", "select o_orderkey, date(o_orderdate) as a, date('2020-01-15') as b, date('2020-1-15') as c, date(o_orderkey) as d from t", "select o_orderkey, cast(o_orderdate as date) as a, date '2020-01-15' as b, cast(null as date) as c, date '1970-01-01' + cast(o_orderkey as integer) as d from orders"),
    "date_filter": ("lineitem", "select count(*) as n from t where l_shipdate >= timestamp('1995-01-01 00:00') and date(l_shipdate) < date('1996-01-01')", "select count(*) as n from lineitem where l_shipdate >= timestamp '1995-01-01 00:00:00' and cast(l_shipdate as date) < date '1996-01-01'"),
    "ts_ctor": ("events", "select event_id, timestamp('2021-03-04T05:06:07.5') as a, timestamp(event_id) as b, timestamp(date(ts)) as c, timestamp('nope') as d from t", "select event_id, timestamp '2021-03-04 05:06:07.5' as a, timestamp '1970-01-01 00:00:00' + to_milliseconds(event_id) as b, cast(cast(ts as date) as timestamp) as c, cast(null as timestamp) as d from events"),
    "strftime": ("events", "select event_id, strftime('%Y/%m/%d %H:%M:%S %%', ts) as a, strftime('%s', ts) as b from t", "select event_id, strftime(ts, '%Y/%m/%d %H:%M:%S %%') as a, cast(cast(floor(epoch(ts)) as bigint) as varchar) as b from events"),
    "date_diff_days": ("orders", "select o_orderkey, date(o_orderdate) - date('1995-01-01') as d, date(o_orderdate) + 1 as e from t", "select o_orderkey, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as d, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 1 as bigint) as e from orders"),
    "ts_diff_ms": ("events", "select event_id, ts - timestamp('2020-01-01 00:00') as d from t", "select event_id, cast(floor(epoch_us(ts) / 1000.0) as bigint) - 1577836800000 as d from events"),
    "date_trunc": ("events", "select event_id, date_trunc('month', ts) as m, date_trunc('week', ts) as w, date_trunc('quarter', ts) as q, date_trunc('hour', ts) as h, date_trunc('day', ts) as d, date_trunc('year', ts) as y from t", "select event_id, cast(date_trunc('month', ts) as timestamp) as m, cast(date_trunc('week', ts) as timestamp) as w, cast(date_trunc('quarter', ts) as timestamp) as q, cast(date_trunc('hour', ts) as timestamp) as h, cast(date_trunc('day', ts) as timestamp) as d, cast(date_trunc('year', ts) as timestamp) as y from events"),
    "date_add_month": ("orders", "select o_orderkey, date_add(date(o_orderdate), 1, 'month') as m, date_add(date(o_orderdate), -2, 'week') as w, date_add(date(o_orderdate), 1, 'year') as y, date_add(date(o_orderdate), 3, 'day') as d from t", "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as m, cast(o_orderdate as date) - 14 as w, cast(cast(o_orderdate as date) + interval 1 year as date) as y, cast(o_orderdate as date) + 3 as d from orders"),
    "weekday": ("orders", "select o_orderkey, weekday(o_orderdate) as w from t", "select o_orderkey, cast(isodow(o_orderdate) - 1 as bigint) as w from orders"),
    "quarter": ("orders", "select o_orderkey, quarter(o_orderdate) as q from t", "select o_orderkey, cast(quarter(o_orderdate) as bigint) as q from orders"),
    "to_tz": ("events", "select event_id, to_tz(ts, 'Asia/Tokyo') as j from t", "select event_id, strftime(ts + interval 9 hour, '%Y-%m-%d %H:%M:%S') as j from events"),
    # aggregates
    "count_star": ("lineitem", "select count(*) as n from t", "select count(*) as n from lineitem"),
    "count_col": ("lineitem", "select l_returnflag, count(nullif(l_linenumber, 1)) as n from t group by l_returnflag", "select l_returnflag, count(nullif(l_linenumber, 1)) as n from lineitem group by l_returnflag"),
    "count_distinct": ("lineitem", "select l_returnflag, count(distinct l_suppkey) as n, count(distinct coalesce(l_linestatus, '')) as m from t group by l_returnflag", "select l_returnflag, count(distinct l_suppkey) as n, count(distinct l_linestatus) as m from lineitem group by l_returnflag"),
    "sum_avg_min_max": ("lineitem", "select l_returnflag, round(sum(l_extendedprice), 2) as s, round(avg(l_quantity), 6) as a, min(l_shipdate) as lo, max(l_tax) as hi, sum(l_linenumber) as k from t group by l_returnflag", "select l_returnflag, round(sum(l_extendedprice) * 100.0) / 100.0 as s, round(avg(l_quantity) * 1000000.0) / 1000000.0 as a, min(l_shipdate) as lo, max(l_tax) as hi, cast(sum(l_linenumber) as bigint) as k from lineitem group by l_returnflag"),
    "minmax_text": ("part", "select p_brand, min(p_name) as lo, max(p_name) as hi from t group by p_brand", "select p_brand, min(p_name) as lo, max(p_name) as hi from part group by p_brand"),
    "median": ("lineitem", "select l_returnflag, median(l_extendedprice) as m from t group by l_returnflag", "select l_returnflag, median(l_extendedprice) as m from lineitem group by l_returnflag"),
    "stddev": ("lineitem", "select l_linestatus, round(stddev(l_quantity), 6) as s from t group by l_linestatus", "select l_linestatus, round(stddev_samp(l_quantity) * 1000000.0) / 1000000.0 as s from lineitem group by l_linestatus"),
    "group_concat": ("nation", "select n_regionkey, group_concat(n_name, '; ') as names, group_concat(nullif(n_name, n_name)) as none from t group by n_regionkey", "select cast(n_regionkey as bigint) as n_regionkey, string_agg(n_name, '; ' order by n_nationkey) as names, cast(null as varchar) as none from nation group by n_regionkey"),
    "expr_over_agg": ("orders", "select o_orderstatus, round(sum(o_totalprice) / count(*), 2) as a, max(o_totalprice) - min(o_totalprice) as r from t group by o_orderstatus", "select o_orderstatus, round(sum(o_totalprice) / count(*) * 100.0) / 100.0 as a, max(o_totalprice) - min(o_totalprice) as r from orders group by o_orderstatus"),
    "group_by_expr": ("orders", "select year(o_orderdate) as y, count(*) as n from t group by year(o_orderdate)", "select cast(year(o_orderdate) as bigint) as y, count(*) as n from orders group by 1"),
    "group_by_alias": ("orders", "select lower(o_orderstatus) as s, count(*) as n from t group by s", "select lower(o_orderstatus) as s, count(*) as n from orders group by 1"),
    "group_by_position": ("orders", "select o_orderpriority, o_orderstatus, count(*) as n from t group by 1, 2", "select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2"),
    "group_null": ("orders", "select nullif(o_orderstatus, 'O') as s, count(*) as n from t group by 1", "select nullif(o_orderstatus, 'O') as s, count(*) as n from orders group by 1"),
    "empty_aggregate": ("orders", "select count(*) as n, sum(o_totalprice) as s, min(o_orderstatus) as m from t where o_orderkey < 0", "select count(*) as n, sum(o_totalprice) as s, min(o_orderstatus) as m from orders where o_orderkey < 0"),
    "group_as_distinct": ("lineitem", "select l_returnflag, l_linestatus from t group by l_returnflag, l_linestatus", "select distinct l_returnflag, l_linestatus from lineitem"),
    "having_by_cte": ("lineitem", "with g as (select l_suppkey, count(*) as n from t group by l_suppkey) select l_suppkey, n from g where n > 30", "select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 30"),
    # joins
    "inner_dim": ("orders", "select o_orderkey, c.c_name, c_mktsegment from t join customer c on t.o_custkey = c.c_custkey where c.c_acctbal > 5000", "select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where c_acctbal > 5000"),
    "left_dim": ("customer", "select c_custkey, n_name from t left join (select n_nationkey, n_name from nation where n_regionkey = 1) n on n.n_nationkey = t.c_nationkey", "select c_custkey, n_name from customer left join (select * from nation where n_regionkey = 1) on n_nationkey = c_nationkey"),
    "using_key": ("orders", "with c as (select c_custkey as o_custkey, c_name from customer) select o_orderkey, o_custkey, c_name from t join c using (o_custkey)", "select o_orderkey, o_custkey, c_name from orders join customer on c_custkey = o_custkey"),
    "chained_joins": ("orders", "select r.r_name, count(*) as n, round(sum(o_totalprice), 2) as s from t join customer c on c.c_custkey = o_custkey join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey group by r.r_name", "select r_name, count(*) as n, round(sum(o_totalprice) * 100.0) / 100.0 as s from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name"),
    "join_cte": ("lineitem", "with s as (select s_suppkey, s_nationkey from supplier where s_acctbal > 0) select s_nationkey, count(*) as n from t join s on l_suppkey = s_suppkey group by s_nationkey", "select cast(s_nationkey as bigint) as s_nationkey, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey where s_acctbal > 0 group by s_nationkey"),
    "join_subquery": ("customer", "select c_custkey, o.n from t join (select o_custkey, count(*) as n from orders group by o_custkey) o on o.o_custkey = t.c_custkey", "select c_custkey, n from customer join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey"),
    "anti_join_left": ("customer", "select c_custkey from t left join (select o_custkey from orders where o_totalprice > 400000 group by o_custkey) o on o.o_custkey = c_custkey where o.o_custkey is null", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)"),
    "clash_rename": ("nation", "select * from t join (select r_regionkey, r_name as n_name, 'x' as a from region) r on r.r_regionkey = n_regionkey", "select cast(n_nationkey as bigint) as n_nationkey, n.n_name, cast(n_regionkey as bigint) as n_regionkey, 'x' as a, r_name as r_n_name from nation n join region on r_regionkey = n_regionkey"),
    "self_join": ("nation", "select t.n_name, b.n_name as other from t join nation b on b.n_nationkey = t.n_regionkey", "select a.n_name, b.n_name as other from nation a join nation b on b.n_nationkey = a.n_regionkey"),
    # subqueries
    "in_subquery": ("orders", "select o_orderkey from t where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')"),
    "in_subquery_expr": ("orders", "select count(*) as n from t where o_custkey % 10 in (select n_nationkey from nation where n_regionkey = 0)", "select count(*) as n from orders where o_custkey % 10 in (select n_nationkey from nation where n_regionkey = 0)"),
    "not_in_subquery": ("customer", "select c_custkey from t where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
    "not_in_subquery_null": ("customer", "select count(*) as n from t where c_custkey not in (select nullif(o_custkey, 1) from orders)", "select count(*) as n from customer where c_custkey not in (select nullif(o_custkey, 1) from orders)"),
    "not_in_subquery_empty": ("customer", "select count(*) as n from t where nullif(c_custkey, 1) not in (select o_custkey from orders where o_orderkey < 0)", "select count(*) as n from customer"),
    "not_in_rows_null": ("lineitem", "select count(*) as n, sum(l_linenumber) as m from t where (nullif(l_linenumber, 3), l_returnflag) not in (select nullif(l_linenumber, 1), nullif(l_returnflag, 'A') from lineitem where l_quantity = 50 and l_linenumber in (1, 4) and l_returnflag <> 'N')", "with k as (select distinct nullif(l_linenumber, 1) as a, nullif(l_returnflag, 'A') as b from lineitem where l_quantity = 50 and l_linenumber in (1, 4) and l_returnflag <> 'N') select count(*) as n, cast(sum(l_linenumber) as bigint) as m from lineitem where not exists (select 1 from k where coalesce(a = nullif(l_linenumber, 3), true) and coalesce(b = l_returnflag, true))"),
    "in_subquery_rows": ("lineitem", "select count(*) as n from t where (l_orderkey, l_linenumber) in (select l_orderkey, max(l_linenumber) from lineitem group by l_orderkey)", "select count(*) as n from lineitem l join (select l_orderkey as k, max(l_linenumber) as m from lineitem group by 1) on k = l_orderkey and m = l_linenumber"),
    "exists_corr": ("customer", "select c_custkey from t where exists (select 1 from orders o where o.o_custkey = t.c_custkey and o_orderstatus = 'P')", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "not_exists_corr": ("supplier", "select s_suppkey from t where not exists (select 1 from lineitem l where l.l_suppkey = t.s_suppkey and l_quantity > 49 and l_linenumber = 7 and l_discount > 0.08)", "select s_suppkey from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49 and l_linenumber = 7 and l_discount > 0.08)"),
    "exists_two_keys": ("nation", "select n_name from t where exists (select 1 from nation b where b.n_regionkey = t.n_nationkey and b.n_nationkey = t.n_regionkey)", "select n_name from nation a where exists (select 1 from nation b where b.n_regionkey = a.n_nationkey and b.n_nationkey = a.n_regionkey)"),
    "exists_uncorrelated": ("nation", "select count(*) as n from t where exists (select 1 from orders where o_totalprice > 0) and not exists (select 1 from orders where o_totalprice < 0)", "select count(*) as n from nation where exists (select 1 from orders where o_totalprice > 0) and not exists (select 1 from orders where o_totalprice < 0)"),
    "in_or_in": ("orders", "select count(*) as n from t where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_orderkey in (select l_orderkey from lineitem where l_quantity = 50) or o_orderstatus = 'P'", "select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_orderkey in (select l_orderkey from lineitem where l_quantity = 50) or o_orderstatus = 'P'"),
    "not_in_or": ("customer", "select count(*) as n from t where c_custkey not in (select nullif(o_custkey, 4) from orders) or c_nationkey = 3", "select count(*) as n from customer where c_custkey not in (select nullif(o_custkey, 4) from orders) or c_nationkey = 3"),
    "cte_chain": ("lineitem", "with a as (select l_orderkey as k, sum(l_quantity) as q from t group by l_orderkey), b as (select k, q from a where q > 200) select count(*) as n, max(q) as m from b", "with a as (select l_orderkey as k, sum(l_quantity) as q from lineitem group by 1) select count(*) as n, max(q) as m from a where q > 200"),
    "cte_shadow": ("orders", "with orders as (select o_orderkey, o_totalprice from orders where o_orderstatus = 'F') select count(*) as n, min(o_totalprice) as m from orders", "select count(*) as n, min(o_totalprice) as m from orders where o_orderstatus = 'F'"),
    "from_subquery": ("orders", "select s, n from (select o_orderstatus as s, count(*) as n from t group by 1) x where n > 10", "select o_orderstatus as s, count(*) as n from orders group by 1 having count(*) > 10"),
    # order and limits
    "order_multi": ("orders", "select o_orderkey, o_orderstatus, o_totalprice from t order by o_orderstatus desc, o_totalprice, o_orderkey limit 40", "select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderstatus desc, o_totalprice, o_orderkey limit 40"),
    "order_alias_pos": ("orders", "select o_custkey as c, count(*) as n from t group by o_custkey order by n desc, 1 limit 25", "select o_custkey as c, count(*) as n from orders group by 1 order by n desc, 1 limit 25"),
    "order_by_agg": ("orders", "select o_custkey from t group by o_custkey order by max(o_totalprice) desc, o_custkey limit 15", "select o_custkey from orders group by o_custkey order by max(o_totalprice) desc, o_custkey limit 15"),
    "order_nulls": ("part", "select p_partkey, nullif(p_size, 1) as s from t order by nullif(p_size, 1), p_partkey limit 30", "select p_partkey, cast(nullif(p_size, 1) as bigint) as s from part order by nullif(p_size, 1) asc nulls first, p_partkey limit 30"),
    "topk": ("lineitem", "select l_orderkey, l_linenumber, l_extendedprice from t order by l_extendedprice desc, l_orderkey, l_linenumber limit 100", "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100"),
    "order_all": ("orders", "select o_orderkey, o_totalprice from t order by o_orderstatus, o_totalprice desc, o_orderkey", "select o_orderkey, o_totalprice from orders order by o_orderstatus, o_totalprice desc, o_orderkey"),
    "limit_offset": ("orders", "select o_orderkey from t order by o_orderkey limit 20 offset 35", "select o_orderkey from orders order by o_orderkey limit 20 offset 35"),
    "star_expand": ("region", "select *, upper(r_name) as u from t", "select cast(r_regionkey as bigint) as r_regionkey, r_name, upper(r_name) as u from region"),
    "pivot_case": ("lineitem", "select l_returnflag, sum(case when l_linestatus = 'O' then l_quantity else 0 end) as o, sum(if(l_linestatus = 'F', 1, 0)) as f from t group by l_returnflag", "select l_returnflag, sum(case when l_linestatus = 'O' then l_quantity else 0 end) as o, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as f from lineitem group by l_returnflag"),
    # the function library
    "regexp": ("part", "select p_partkey from t where regexp(p_name, '[aeiou]{2}') and regexp(p_type, 'eco|std', 'i')", "select p_partkey from part where regexp_matches(p_name, '[aeiou]{2}') and regexp_matches(lower(p_type), 'eco|std')"),
    "regexp_extract": ("part", "select p_partkey, regexp_extract(p_brand, '([a-z]+)#([0-9])', 2) as g, regexp_extract(p_brand, 'zz') as z, regexp_extract(p_brand, '[0-9]+') as w from t", "select p_partkey, nullif(regexp_extract(p_brand, '([a-z]+)#([0-9])', 2), '') as g, cast(null as varchar) as z, nullif(regexp_extract(p_brand, '[0-9]+'), '') as w from part"),
    "regexp_replace": ("part", "select p_partkey, regexp_replace(p_name, '([aeiou])', '<$1>') as r from t", "select p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') as r from part"),
    "json_extract": ("events", "select event_id, int(json_extract(props, '$.k')) as k, json_extract(props, '$.none') as z from t", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(null as varchar) as z from events"),
    "url_host": ("pages", "select page_id, url_host(url) as h from t", "select page_id, regexp_extract(url, '://([^/?#]*)', 1) as h from pages"),
    "unaccent": ("documents", "select doc_id, unaccent(text) as u, unaccent('שָׁלוֹם हिन्दी ǘ ﬁ' || lang) as v from t", "select doc_id, strip_accents(text) as u, strip_accents('שָׁלוֹם हिन्दी ǘ ﬁ' || lang) as v from documents"),
    "geo_distance": ("customer", "select c_custkey, round(geo_distance(c_nationkey, 0, 10, c_nationkey * 2), 3) as d from t", "select c_custkey, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(10 - c_nationkey) / 2), 2) + cos(radians(c_nationkey)) * cos(radians(10)) * pow(sin(radians(c_nationkey * 2) / 2), 2)))) * 1000.0) / 1000.0 as d from customer"),
    "country_name": ("nation", "select n_nationkey, country_name(substr('dzarbrcaegetfrdeinidiriqjpjokemamzpecnrosavnrugbnp', n_nationkey * 2 + 1, 2)) as a, country_name(substr('DZARBRCAEGETFRDEINIDIRIQJPJOKEMAMZPECNROSAVNRUGBNP', n_nationkey * 2 + 1, 2), 'fr') as b, country_name(n_name) as c, country_name('qq') as d from t where n_nationkey < 25", "select cast(n_nationkey as bigint) as n_nationkey, (string_split('Algeria,Argentina,Brazil,Canada,Egypt,Ethiopia,France,Germany,India,Indonesia,Iran,Iraq,Japan,Jordan,Kenya,Morocco,Mozambique,Peru,China,Romania,Saudi Arabia,Vietnam,Russia,United Kingdom,Nepal', ','))[n_nationkey + 1] as a, (string_split('Algérie,Argentine,Brésil,Canada,Égypte,Éthiopie,France,Allemagne,Inde,Indonésie,Iran,Irak,Japon,Jordanie,Kenya,Maroc,Mozambique,Pérou,Chine,Roumanie,Arabie saoudite,Viêt Nam,Russie,Royaume-Uni,Népal', ','))[n_nationkey + 1] as b, cast(null as varchar) as c, 'QQ' as d from nation where n_nationkey < 25"),
    "format_number": ("customer", "select c_custkey, format_number(c_acctbal, 'en-US') as a, format_number(c_acctbal * 1000, 'de-DE') as b, format_number(c_custkey * 12345, 'en-US:compact') as c, format_number(c_acctbal, 'en-US:compact') as d from t", "with v as (select c_custkey, round(cast(c_acctbal as decimal(18, 2)), 1) as a, cast(round(c_acctbal * 1000) as bigint) as b, c_custkey * 12345 as k from customer), w as (select *, case when k >= 999950 then round(k / 1000000.0::decimal(18, 1), 1) when k >= 1000 then round(k / 1000.0::decimal(18, 1), 1) else k end as x, case when abs(a) >= 1000 then round(a0 / 1000, 1) else a end as y from (select *, (select cast(c_acctbal as decimal(18, 2)) from customer i where i.c_custkey = v.c_custkey) as a0 from v)) select c_custkey, regexp_replace(format('{:,.1f}', cast(a as double)), '\\.0$', '') as a, replace(format('{:,}', b), ',', '.') as b, regexp_replace(format('{:.1f}', cast(x as double)), '\\.0$', '') || case when k >= 999950000 then 'B' when k >= 999950 then 'M' when k >= 1000 then 'K' else '' end as c, regexp_replace(format('{:.1f}', cast(y as double)), '\\.0$', '') || case when abs(a) >= 1000 then 'K' else '' end as d from w"),
}


def _statement(base: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return opened(spark, sf_dir, base, named_in(sql)).query(sql, base)

    return run


def named_in(*statements: str) -> tuple[str, ...]:
    """The tables that statements name; opening a table reads its footer."""
    words = {w for sql in statements for w in re.findall(r"\w+", sql)}
    return tuple(t for t in FLAT_TABLES if t in words)


def opened(spark: SparkSession, sf_dir: str, base: str, names: tuple[str, ...] = ()) -> Engine:
    engine = Engine(spark)
    for name in dict.fromkeys((*names, base)):
        engine.load_parquet(name, f"{sf_dir}/{name}.parquet")
    return engine


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet")


_DIMS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_SELECTED = {"l_returnflag": ["A", "R"], "l_linenumber": [1, 2, 3]}


def facet_counts_except_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_refresh(_lineitem(spark, sf_dir), _DIMS, _SELECTED).counts


def facet_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = facets.facet_refresh(_lineitem(spark, sf_dir), _DIMS, _SELECTED, "l_extendedprice").totals
    return totals.select("pass_count", (F.round(F.col("total") * 100.0) / 100.0).alias("total"))


def facet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facets.facet_refresh(facets.with_position(_lineitem(spark, sf_dir)), _DIMS, _SELECTED).rows
    return facets.sort_topk(rows, "l_extendedprice", 50, "_pos").select("l_orderkey", "l_extendedprice")


def gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = facets.with_position(read_parquet(spark, f"{sf_dir}/orders.parquet"))
    return facets.gather(orders, [7, 3, 900, 3], ["o_orderkey", "_pos"])


_BATCH = (
    "select l_returnflag as v, count(*) as n from t where l_linenumber in (1, 2) group by l_returnflag",
    "select l_linestatus as v, count(*) as n from t where l_returnflag = 'A' group by l_linestatus",
    "select text(l_linenumber) as v, count(*) as n from t where l_quantity > 25 group by l_linenumber",
    "select 'total' as v, count(*) as n from t",
    "select p_brand as v, count(*) as n from part group by p_brand order by n desc, v limit 5",
)


def batch_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for i, df in enumerate(opened(spark, sf_dir, "lineitem", named_in(*_BATCH)).query(list(_BATCH), "lineitem")):
        part = df.select(F.lit(i).cast("long").alias("statement"), "v", "n")
        out = part if out is None else out.unionByName(part)
    return out


def matched_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    rich = read_parquet(spark, f"{sf_dir}/customer.parquet").where("c_acctbal > 5000").select("c_custkey", "c_name")
    return joins.dimension_join(orders, rich, [("o_custkey", "c_custkey")]).withColumn("matched", F.col("matched").cast("long"))


def describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = opened(spark, sf_dir, "lineitem").describe("lineitem")
    rows = [(c["name"], c["kind"], found["rows"], c["nulls"]) for c in found["columns"]]
    return spark.createDataFrame(rows, "name string, kind string, n bigint, nulls bigint")


def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir, "orders")
    engine.materialize("by_status", "select o_orderstatus as s, count(*) as n, count(*) > 100 as many from t group by 1", "orders")
    return engine.query("select s, n, many from by_status where n > 0")


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = opened(spark, sf_dir, "part")
    engine.register_function("plus_one", lambda n: n + 1, ["int"], "int")
    engine.register_function("tag", lambda s, n: f"{s}:{n}", ["text", "int"], "text", per_row=True)
    return engine.query("select p_partkey, plus_one(nullif(p_size, 1)) as n, tag(p_brand, p_size) as g from t", "part")


def user_function_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that take and give floats, dates, timestamps and booleans, over Arrow batches and row by row."""
    engine = opened(spark, sf_dir, "orders")
    engine.register_function("half", lambda x: x / 2, ["float"], "float")
    engine.register_function("next_day", lambda d: d + dt.timedelta(days=1), ["date"], "date", per_row=True)
    engine.register_function("an_hour_on", lambda t: t + dt.timedelta(hours=1), ["timestamp"], "timestamp", per_row=True)
    engine.register_function("is_large", lambda x: x > 200000, ["float"], "bool")
    return engine.query("select o_orderkey, half(o_totalprice) as h, text(next_day(date(o_orderdate))) as d, text(an_hour_on(o_orderdate)) as t, is_large(o_totalprice) as l from t", "orders")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back with sniffed types: the kinds of the columns come from the text alone."""
    path = _folder(spark)
    read_parquet(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", F.lit("2024-02-03").alias("day"), F.lit("say \"a, b\"\nor c").alias("note")).write.option("header", True).option("escape", '"').csv(path)
    engine = Engine(spark)
    engine.load_csv("t", path)
    return engine.query("select c_custkey + 1 as k, c_name, c_acctbal * 2 as a, year(day) as y, note from t", "t")


def clustered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a column's values are each one run of rows."""
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet")
    return spark.createDataFrame([(c, is_clustered(orders, c)) for c in ("o_orderkey", "o_orderstatus", "o_custkey")], "name string, clustered boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts of three dimensions, each under all filters but its own, in one scan."""
    return facet_counts_except_own(spark, sf_dir)


_DIRECT: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "facet_counts_except_own": (
        facet_counts_except_own,
        "select 'l_returnflag' as dimension, l_returnflag as value, count(*) as count from lineitem where l_linenumber in (1, 2, 3) group by 2 union all select 'l_linestatus', l_linestatus, count(*) from lineitem where l_linenumber in (1, 2, 3) and l_returnflag in ('A', 'R') group by 2 union all select 'l_linenumber', cast(l_linenumber as varchar), count(*) from lineitem where l_returnflag in ('A', 'R') group by 2",
    ),
    "facet_totals": (facet_totals, "select count(*) as pass_count, round(sum(l_extendedprice) * 100.0) / 100.0 as total from lineitem where l_returnflag in ('A', 'R') and l_linenumber in (1, 2, 3)"),
    "facet_topk": (facet_topk, "select l_orderkey, l_extendedprice from lineitem where l_returnflag in ('A', 'R') and l_linenumber in (1, 2, 3) order by l_extendedprice desc, l_orderkey limit 50"),
    "gather": (gather_rows, "with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as _pos from orders) select o_orderkey, _pos from o where _pos in (3, 7, 900) union all select o_orderkey, _pos from o where _pos = 3"),
    "batch_facets": (
        batch_facets,
        "select cast(0 as bigint) as statement, l_returnflag as v, count(*) as n from lineitem where l_linenumber in (1, 2) group by 2 union all select 1, l_linestatus, count(*) from lineitem where l_returnflag = 'A' group by 2 union all select 2, cast(l_linenumber as varchar), count(*) from lineitem where l_quantity > 25 group by 2 union all select 3, 'total', count(*) from lineitem union all select 4, v, n from (select p_brand as v, count(*) as n from part group by 1 order by n desc, v limit 5)",
    ),
    "matched_flag": (matched_flag, "select o_orderkey, o_custkey, c_name, cast(c_name is not null as bigint) as matched from orders left join (select * from customer where c_acctbal > 5000) on c_custkey = o_custkey"),
    "describe": (
        describe_lineitem,
        "select c.name, c.kind, n, cast(0 as bigint) as nulls from (select count(*) as n from lineitem), (values ('l_orderkey', 'int'), ('l_partkey', 'int'), ('l_suppkey', 'int'), ('l_linenumber', 'int'), ('l_quantity', 'float'), ('l_extendedprice', 'float'), ('l_discount', 'float'), ('l_tax', 'float'), ('l_returnflag', 'text'), ('l_linestatus', 'text'), ('l_shipdate', 'timestamp')) as c(name, kind)",
    ),
    "materialize": (materialized, "select o_orderstatus as s, count(*) as n, cast(count(*) > 100 as bigint) as many from orders group by 1"),
    "user_function_kinds": (
        user_function_kinds,
        "select o_orderkey, o_totalprice / 2 as h, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as d, strftime(o_orderdate + interval 1 hour, '%Y-%m-%d %H:%M:%S') as t, o_totalprice > 200000 as l from orders",
    ),
    "csv": (csv_table, "select c_custkey + 1 as k, c_name, c_acctbal * 2 as a, cast(2024 as bigint) as y, 'say \"a, b\"' || chr(10) || 'or c' as note from customer"),
    "clustered": (
        clustered_columns,
        "with r as (select o_orderkey as a, lag(o_orderkey) over () as a0, o_orderstatus as b, lag(o_orderstatus) over () as b0, o_custkey as c, lag(o_custkey) over () as c0 from orders), n as (select sum(cast(a is distinct from a0 as int)) as x, count(distinct a) as x0, sum(cast(b is distinct from b0 as int)) as y, count(distinct b) as y0, sum(cast(c is distinct from c0 as int)) as z, count(distinct c) as z0 from r) select 'o_orderkey' as name, x = x0 as clustered from n union all select 'o_orderstatus', y = y0 from n union all select 'o_custkey', z = z0 from n",
    ),
    "user_function": (user_function, "select p_partkey, cast(nullif(p_size, 1) + 1 as bigint) as n, p_brand || ':' || p_size as g from part"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _statement(base, sql) for name, (base, sql, _) in _STATEMENTS.items()} | {name: f for name, (f, _) in _DIRECT.items()}
SQL: dict[str, str] = {name: oracle or sql for name, (_, sql, oracle) in _STATEMENTS.items()} | {name: sql for name, (_, sql) in _DIRECT.items() if sql}
