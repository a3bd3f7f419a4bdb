"""Statements on small tables whose answers are written out."""

import datetime as dt

import pytest

from tessella import Engine
from tessella.plans.diagnostics import SqlError

HIRES = [("harbour", 12.5, 3), ("mill", None, 1), ("harbour", 40.0, 7), (None, 3.25, 2), ("station", 18.0, 3), ("mill", 7.75, 14), ("station", 18.0, None), ("harbour", -2.0, 1)]
SIGNS = ["Mind the gap", "MIND your head", "no exit", None, "Exit only", "gap year", "100% wool", "a_b", ""]
FACTS = [("eu", 10, 1.0), ("us", 20, 2.0), ("eu", 10, 3.0), ("asia", 30, 4.0), ("us", 99, 5.0), ("asia", 30, 6.0), (None, 20, 7.0), ("us", 20, 8.0)]
DIMS = [("eu", 10, "A", 0.5), ("us", 20, "B", 0.25), ("asia", 30, "C", 0.125)]

@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    day = dt.date.fromisoformat
    days = [day("2020-01-15"), day("2020-03-01"), day("2021-12-31"), None, day("2021-01-01"), day("2020-01-15")]
    at = [dt.datetime.combine(d or day("1970-01-01"), dt.time()) + dt.timedelta(seconds=3661 * i) for i, d in enumerate(days)]
    e.load("temporal", spark.createDataFrame([(d, t, i + 1) for i, (d, t) in enumerate(zip(days, at))], "d date, ts timestamp_ntz, n int"))
    e.load("signs", spark.createDataFrame([(s, i) for i, s in enumerate(SIGNS)], "said string, id byte"))
    e.load("facts", spark.createDataFrame(FACTS, "cat string, id int, v double"))
    e.load("d", spark.createDataFrame(DIMS, "cat string, id int, label string, v double"))
    e.load("dn", spark.createDataFrame([*DIMS, (None, 40, "D", 1.0)], "cat string, id int, label string, v double"))
    e.load("hires", spark.createDataFrame(HIRES, "depot string, km double, days short"))
    return e


def rows(engine, sql, table="hires"):
    return [tuple(r) for r in engine.query(sql, table).collect()]


KM = [k for _, k, _ in HIRES if k is not None]


def by_depot(value):
    """A value of each depot's rows, depots in order, NULL first."""
    order = sorted({d for d, *_ in HIRES}, key=lambda d: (d is not None, d or ""))
    return [(d, *value([r for r in HIRES if r[0] == d])) for d in order]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select depot, count(*) a, count(km) b, sum(days) c from t group by depot order by depot", by_depot(lambda r: (len(r), sum(x[1] is not None for x in r), sum(x[2] or 0 for x in r)))),
        ("select depot, max(km), min(km) from t group by 1 order by 1", by_depot(lambda r: (max(k for _, k, _ in r if k is not None), min(k for _, k, _ in r if k is not None)))),
        ("select sum(km), avg(km), max(depot), min(days) from t", [(sum(KM), sum(KM) / len(KM), "station", 1)]),
        ("select median(km), count(distinct depot), count(distinct km) from t", [(12.5, 3, len(set(KM)))]),
        ("select sum(days) / count(days) from t order by sum(days)", [(31 // 7,)]),
        ("select count(*), sum(km) from t where days > 100", [(0, None)]),
        ("select depot from t where km is null", [("mill",)]),
        ("select count(*) from t where not km > 10", [(sum(not k > 10 for k in KM),)]),
        ("select count(*) from t where km < 0 or depot is null or km is null", [(3,)]),
        ("select count(*) from t where null", [(0,)]),
        ("select depot d from t group by depot order by 1 desc limit 2", [("station",), ("mill",)]),
        ("select group_concat(days) from t where km > 10", [("3,7,3",)]),
        ("select depot, group_concat(km, ' + ') from t where depot <> 'mill' group by depot order by depot", [("harbour", "12.5 + 40 + -2"), ("station", "18 + 18")]),
        ("select group_concat(km) from t where km is null", [(None,)]),
        ("select days, km from t order by days, km desc limit 3", [(None, 18.0), (1, -2.0), (1, None)]),
        ("select km from t order by km desc limit 3 offset 5", [(3.25,), (-2.0,), (None,)]),
        ("select km from t order by km", [(None,), *((k,) for k in sorted(KM))]),
        ("select case when km >= 18 then 'far' when km > 0 then 'near' end c, count(*) from t group by 1 order by 1", [(None, 2), ("far", 3), ("near", 3)]),
        ("select case when days > 10 then days else 0.5 end from t order by days desc limit 2", [(14.0,), (0.5,)]),
        ("select 17 / 5, 17 % 5, -17 / 5, 3 / 0, 2.5 / 0, 3 % 0, 9 / 2.0 from t limit 1", [(3, 2, -3, None, None, None, 4.5)]),
        ("select coalesce(km, days, 9), ifnull(depot, '-'), nullif(days, 1), nullif(null, 2) from t where km is null", [(1.0, "mill", None, None)]),
        ("select length('naïve'), upper('straße'), substr('harbour', 4, 2), substr('harbour', 8), substr('harbour', 1, -3), substr('harbour', -3, 2), lower('ÀB') from t limit 1", [(5, "STRASSE", "bo", "", "", "ou", "àb")]),
        ("select trim(' km\t'), ltrim('00420', '0'), rtrim('1.500', '0'), trim('--x-', '-'), replace('mill', 'l', 'nn'), replace('mill', '', 'x'), instr('station', 'ti'), instr('station', 'q') from t limit 1", [(" km\t".strip(" "), "420", "1.5", "x", "minnnn", "mill", 4, 0)]),
        ("select text(40.0), text(2.25), text(days), int(' 31'), int('4x'), int(-8.7), float('4e2'), float('4,2'), int('km') from t where km = 40", [("40", "2.25", "7", 31, None, -8, 400.0, None, None)]),
        ("select round(4.5), round(-4.5), round(18.126, 2), floor(-0.5), ceil(-0.5), abs(-9), sign(0 - 3), sqrt(-4), ln(-1), power(3, 4) from t limit 1", [(5.0, -5.0, 18.13, -1.0, 0.0, 9, -1, None, None, 81)]),
        ("select depot || '/' || text(days), concat(depot, ':', km), depot || null from t where km = 7.75", [("mill/14", "mill:7.75", None)]),
        ("select km from t where (depot, days) in (('station', 3), ('mill', 14), ('mill', 2)) order by km", [(7.75,), (18.0,)]),
        ('select "depot" as "The Depot" from t -- where it began\nlimit 1', [("harbour",)]),
        ("select d, n from (select depot d, count(*) n from t group by depot) q where n = 2 order by d", [("mill", 2), ("station", 2)]),
        ("with far as (select depot, km from t where km > 5), best as (select depot, max(km) top from far group by depot) select * from best where top < 30 order by top", [("mill", 7.75), ("station", 18.0)]),
        ("with t as (select days from t where depot = 'harbour') select sum(days), count(*) from t", [(11, 3)]),
        ("select between(days, 2, 5), in(depot, 'mill', 'pier'), if(km > 10, 'far', 'near'), isnull(depot) from t where km = 3.25", [(True, None, "near", True)]),
        ("select 2e2, .25e1, 0017 from t limit 1", [(200.0, 2.5, 17)]),
        ("select upper(depot) as depot, count(*) from t where depot is not null group by depot order by 2 desc, 1 limit 2", [("HARBOUR", 3), ("MILL", 2)]),
    ],
)
def test_base(engine, sql, want):
    assert rows(engine, sql) == want


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select year(d), month(d), day(d) from t where n in (2, 4) order by n", [(2020, 3, 1), (None, None, None)]),
        ("select hour(ts), minute(ts), second(ts) from t where n = 3", [(2, 2, 2)]),
        ("select n from t where d >= date('2021-01-01') order by n", [(3,), (5,)]),
        ("select date('2020-01-15') + 1, date('2020-01-15') - date('2020-01-01'), timestamp('1970-01-01 00:00:01') - 5 from t limit 1", [(18277, 14, 995)]),
        ("select date('2020-1-5'), date('2020-02-31'), date(18276), date(ts), timestamp('2020-01-01T10:20'), timestamp('x'), timestamp(1500), timestamp(d) from t limit 1", [(None, None, dt.date(2020, 1, 15), dt.date(2020, 1, 15), dt.datetime(2020, 1, 1, 10, 20), None, dt.datetime(1970, 1, 1, 0, 0, 1, 500000), dt.datetime(2020, 1, 15))]),
        ("select strftime('%Y/%m/%d at %H:%M:%S %% %q', ts), strftime('%s', d) from t where n = 2", [("2020/03/01 at 01:01:01 % %q", "1583020800")]),
        ("select min(d), max(d), count(distinct d) from t", [(dt.date(2020, 1, 15), dt.date(2021, 12, 31), 4)]),
        ("select sum(d), avg(d) from t where n <= 2", [(18276 + 18322, (18276 + 18322) / 2)]),
        ("select date_trunc('week', ts), weekday(d), quarter(d), date_add(d, 1, 'month'), to_tz(ts, 'Europe/Paris') from t where n = 2", [(dt.datetime(2020, 2, 24), 6, 1, dt.date(2020, 4, 1), "2020-03-01 02:01:01")]),
        ("select date_add(date('2020-01-31'), 1, 'month'), date_add(date('2020-02-29'), 1, 'year'), date_trunc('hour', ts) from t where n = 1", [(dt.date(2020, 2, 29), dt.date(2021, 2, 28), dt.datetime(2020, 1, 15))]),
    ],
)
def test_dates(engine, sql, want):
    assert rows(engine, sql, "temporal") == want


def matches(pattern, text):
    """LIKE by its definition, one letter at a time."""
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(matches(pattern[1:], text[i:]) for i in range(len(text) + 1))
    return bool(text) and (pattern[0] == "_" or pattern[0].lower() == text[0].lower()) and matches(pattern[1:], text[1:])


@pytest.mark.parametrize("pattern", ["%gap%", "mind%", "%T", "no exit", "%", "", "_o %", "%i_d%", "%e%t%", "m%d _our%", "100%", "a_b", "____", "%%a%%"])
def test_like(engine, pattern):
    want = [i for i, s in enumerate(SIGNS) if s is not None and matches(pattern, s)]
    assert [r[0] for r in rows(engine, f"select id from t where said like '{pattern}' order by id", "signs")] == want
    assert [r[0] for r in rows(engine, f"select id from t where said not ilike '{pattern}' order by id", "signs")] == [i for i, s in enumerate(SIGNS) if s is not None and i not in want]


def test_like_is_unicode_aware_but_keeps_ascii_apart(engine):
    one = lambda sql: rows(engine, f"select {sql} from t limit 1")[0]
    assert one("'Ö' like 'ö', 'ДА' ilike 'да', '\u212a' like 'k', '\u0130' like 'i', 'c\\d' like 'c\\d', null like 'x'") == (True, True, False, False, True, None)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select t.id, label from t join d on t.cat = d.cat and t.id = d.id order by t.v", [(10, "A"), (20, "B"), (10, "A"), (30, "C"), (30, "C"), (20, "B")]),
        ("select t.v, label from t left join d on t.cat = d.cat order by t.v", [(1.0, "A"), (2.0, "B"), (3.0, "A"), (4.0, "C"), (5.0, "B"), (6.0, "C"), (7.0, None), (8.0, "B")]),
        ("select * from t join d using (cat) where t.v = 1", [("eu", 10, 1.0, 10, "A", 0.5)]),
        ("select sum(v), sum(d_v), sum(d.v) from t join d using (cat)", [(29.0, 2.0, 2.0)]),
        ("select t.v from t left join d on t.cat = d.cat where d.cat is null", [(7.0,)]),
        ("select x.label, count(*) from t join d x on x.id = t.id group by x.label order by 1", [("A", 2), ("B", 3), ("C", 2)]),
        ("select v from t where cat in (select cat from d where id < 25) order by v", [(1.0,), (2.0,), (3.0,), (5.0,), (8.0,)]),
        ("select v from t where cat not in (select cat from d where id < 25) order by v", [(4.0,), (6.0,)]),
        ("select v from t where cat not in (select cat from dn)", []),
        ("select count(*) from t where cat not in (select cat from d where id > 100)", [(8,)]),
        ("select v from t where (cat, id) in (select cat, id from d) order by v", [(1.0,), (2.0,), (3.0,), (4.0,), (6.0,), (8.0,)]),
        ("select v from t where (cat, id) not in (select cat, id from d) order by v", [(5.0,)]),
        ("select v from t where (cat, id) not in (select cat, id from dn where id > 25) order by v", [(1.0,), (2.0,), (3.0,), (5.0,), (7.0,), (8.0,)]),
        ("select v from t where exists (select 1 from d where d.cat = t.cat and d.id = t.id and label <> 'A') order by v", [(2.0,), (4.0,), (6.0,), (8.0,)]),
        ("select v from t where not exists (select 1 from d where d.cat = t.cat) order by v", [(7.0,)]),
        ("select count(*) from t where exists (select 1 from d where label = 'Z')", [(0,)]),
        ("select v from t where cat in (select cat from d where id = 10) or v > 7 order by v", [(1.0,), (3.0,), (8.0,)]),
        ("select v from t where not (cat in (select cat from d where id = 10) and v > 2) order by v", [(1.0,), (2.0,), (4.0,), (5.0,), (6.0,), (8.0,)]),
        ("select cat in ('eu', null) from t where v in (1, 2) order by v", [(True,), (None,)]),
    ],
)
def test_joins_and_sets(engine, sql, want):
    assert rows(engine, sql, "facts") == want


@pytest.mark.parametrize(
    ("sql", "marked", "hint"),
    [
        ("select dept from t", "dept", "depot"),
        ("select depot\nfrom t\n where dayz = 3", "dayz", "days"),
        ("select medain(km) from t", "medain(km)", "median"),
        ("select nullif(km) from t", "nullif(km)", ""),
        ("select avg(depot) from t", "depot", ""),
        ("select km + depot from t", "depot", "||"),
        ("select 1 from t where days", "days", "comparison"),
        ("select depot from t where max(km) > 3", "max(km)", "WITH"),
        ("select depot, km from t group by 1", "km", "GROUP BY"),
        ("select max(min(km)) from t", "min(km)", ""),
        ("select depot, sum(km) as far from t group by far", "far", ""),
        ("select depot, sum(km) from t group by 7", "7", "2"),
        ("select days as depot, count(*) from t group by depot", "days", "GROUP BY"),
        ("select max(km from t", "from", ""),
        ("select 'harbour from t", "'harbour from t", "two quotes"),
        ("select depot from t where km between 3, 9", ",", "between"),
        ("select depot km days from t", "days", ""),
        ("select depot from t where km is 3", "3", "="),
        ("select max(distinct km) from t", "distinct", ""),
        ("select depot from t where km ? 3", "?", ""),
        ("select depot from t where depot > 3", "depot > 3", ""),
        ("select 1 from t join d on t.depot < d.cat", "t.depot < d.cat", "WHERE"),
        ("select 1 from t where (depot, days) in (('mill', 1, 2))", "('mill', 1, 2)", ""),
        ("select cast(km as interger) from t", "interger", "integer"),
        ("select minute(depot) from t", "depot", ""),
        ("select distinct depot from t", "distinct", "GROUP BY"),
        ("select exists_set(depot) from t", "exists_set(depot)", ""),
        ("select depot from t having km > 3", "having", "WITH"),
        ("select depot from t limit 2.5", "2.5", ""),
        ("select case km when 3 then 1 end from t", "km", "condition"),
        ("select depot from t; select", "select", ""),
        ("select (select 1 from t) from t", "select", "IN"),
        ("select select from t", "select", ""),
        ("select 1 from t join d on days = d.nothing", "d.nothing", ""),
    ],
)
def test_errors_mark_the_place(engine, sql, marked, hint):
    with pytest.raises(SqlError) as e:
        engine.query(sql, "hires")
    told, line = str(e.value).split("\n")
    assert f"⟦{marked}⟧" in line and line.replace("⟦", "").replace("⟧", "") in sql.split("\n")
    number, column, rest = told.split(":", 2)
    assert sql.split("\n")[int(number) - 1][int(column) - 1 :].startswith(marked)
    assert hint in (e.value.hint or "") and bool(hint) == bool(e.value.hint) and e.value.message in rest


def test_dates_do_not_compare_with_texts(engine):
    with pytest.raises(SqlError) as e:
        engine.query("select * from t where d < '2024-02-01'", "temporal")
    assert "date()" in e.value.hint


def test_rows_that_several_columns_may_hold(engine, spark):
    """NOT IN over columns with NULLs, against its definition."""
    outer = [(a, b) for a in (1, 2, None) for b in ("x", "y", None)]
    engine.load("outer_rows", spark.createDataFrame(outer, "a int, b string"))
    equal = lambda x, y: None if None in (x, y) else x == y
    for inner in ([(1, "x")], [(1, None)], [(None, None)], [(None, "y"), (2, "x")], []):
        engine.load("inner_rows", spark.createDataFrame(inner, "a int, b string"))
        want = [o for o in outer if all(False in (equal(o[0], i[0]), equal(o[1], i[1])) for i in inner)]
        out = engine.query("select a, b from t where (a, b) not in (select a, b from inner_rows)", "outer_rows")
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    engine.remove("outer_rows")
    engine.remove("inner_rows")


def test_joined_keys_are_unique(engine, spark):
    engine.load("twice", spark.createDataFrame([("eu", 1), ("eu", 2), (None, 3), (None, 4)], "cat string, w int"))
    with pytest.raises(SqlError, match="several rows of one key"):
        engine.query("select * from t join twice on t.cat = twice.cat", "facts")
    with pytest.raises(SqlError, match="do not make a key"):
        engine.query("select * from t join d on t.v = d.v", "facts")
    engine.remove("twice")
