"""Tables, caches, functions, batches, facets, sources and the command line."""

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import Engine
from tessella.cli import main
from tessella.operators import facets
from tessella.operators.describe import describe, is_clustered
from tessella.operators.joins import JoinError, dimension_join
from tessella.plans.diagnostics import SqlError
from tessella.sources.csv import read_csv, sniff
from tessella.sources.parquet import read_parquet

UDF_ROWS = [("Alder Row", 3, 1.25), ("Quay Side", 8, 0.75), ("Mill Lane", None, 4.0), ("Orchard", 1, 2.5), (None, 7, 3.5), ("Quay Side", 2, 6.25)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.load("t", spark.createDataFrame(UDF_ROWS, "name string, n int, x double"))
    yield e
    e.close()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_user_functions(engine):
    engine.register_function("plus", lambda a, b: a + b, ["int", "int"], "int")
    engine.register_function("shout", lambda s: s.upper() + "!", ["text"], "text", per_row=True)
    engine.register_function("or_none", lambda s: s.fillna("none"), ["text"], "text", strict=False)
    engine.register_function("total", lambda *xs: sum(xs), ["float"], "float", variadic=True)
    assert rows(engine.query("select plus(n, 1), shout(name), or_none(name), total(x, x, 1) from t")) == [((n + 1) if n else None, s and s.upper() + "!", s or "none", 2 * x + 1) for s, n, x in UDF_ROWS]
    assert rows(engine.query("select plus(max(n), 1) m, max(plus(n, n)) k from t where regexp(name, '^[QM]')")) == [(9, 16)]
    assert rows(engine.query("select plus(null, 1) from t limit 1")) == [(None,)]
    for sql, part in (("select plus(name, 1) from t", "plus() needs int"), ("select plus(n) from t", "takes 2 argument(s), got 1"), ("select pluss(n, 1) from t", "(closest: plus)")):
        with pytest.raises(SqlError) as e:
            engine.query(sql)
        assert part in str(e.value)
    with pytest.raises(ValueError, match="built-in"):
        engine.register_function("sum", len, ["any"], "int")
    assert engine.unregister_function("plus") and not engine.unregister_function("plus")


def test_failing_function_fails_the_query(engine):
    engine.register_function("bad", lambda s: 1 / 0, ["int"], "int", per_row=True)
    with pytest.raises(Exception, match="ZeroDivisionError|division by zero"):
        engine.query("select bad(n) from t").collect()


def test_library(engine):
    assert rows(engine.query("select regexp_extract('ab12', '([a-z]+)([0-9]+)', 2), regexp_extract('ab12', '(?<l>[a-z]+)', 'l'), regexp_extract('x', 'y'), regexp_replace('a-b', '([ab])', '<$1>'), regexp('ABC', 'b', 'i') from t limit 1")) == [("12", "ab", None, "<a>-<b>", True)]
    assert rows(engine.query("""select json_extract('{"a": {"b": [1, {"c": "x"}]}}', '$.a.b[1].c'), json_extract('no', '$.a'), unaccent('Éàñ'), url_host('https://a.b.example/x?y'), url_host('no url'), country_name('jp'), format_number(1234567.891, 'de-DE'), format_number(1234567, 'en-US:compact') from t limit 1""")) == [("x", None, "Ean", "a.b.example", None, "Japan", "1.234.567,9", "1.2M")]
    assert round(rows(engine.query("select geo_distance(52.5, 13.4, 48.85, 2.35) from t limit 1"))[0][0] / 1000) == 877


def test_derived_tables_are_reused(engine, tmp_path):
    engine.materialize("p", "select * from t", "t", persist=str(tmp_path / "p"))  # files have a known size
    sql = "with a as (select name, sum(n) s from p group by name) select count(*) from a where s > 1"
    for _ in range(3):
        assert rows(engine.query(sql)) == [(3,)]
    stats = engine.cache_stats()
    assert stats.hits == 2 and stats.misses == 1 and stats.entries == 1
    engine.set_cache_budget(0)
    assert engine.cache_stats().entries == 0 and rows(engine.query(sql)) == [(3,)]


def test_joins_are_reused_for_other_columns(engine, spark, tmp_path):
    engine.materialize("p", "select * from t", "t", persist=str(tmp_path / "p"))
    engine.materialize("d", "select n, name || '!' as label from t where n is not null", "t", persist=str(tmp_path / "d"))
    for columns, want in (("count(label)", 4), ("max(x)", 6.25), ("max(d.n)", 8)):
        assert rows(engine.query(f"select {columns} from p left join d on p.n = d.n")) == [(want,)]
    assert engine.cache_stats().hits == 2 and engine.cache_stats().entries == 1


def test_materialize(engine, tmp_path):
    assert engine.materialize("m", "select name, n > 1 as many from t order by n")["rows"] == 6
    assert rows(engine.query("select sum(many) from m")) == [(4,)]
    assert engine.materialize("p", "select n from t", "t", persist=str(tmp_path / "p"))["rows"] == 6
    assert rows(engine.query("select max(n) from t", "p")) == [(8,)]
    with pytest.raises(ValueError, match="two result columns"):
        engine.materialize("q", "select n, n from t", "t")
    assert engine.tables() == ["t", "m", "p"]
    with pytest.raises(KeyError, match="closest: p"):
        engine.query("select 1 from t", "pp")


def test_results_as_columns(engine):
    table = engine.columns(engine.query("select name, n from t", "t"), dict_text="all")
    assert pa.types.is_dictionary(table.schema.field("name").type) and table["n"].to_pylist() == [3, 8, None, 1, 7, 2]
    assert engine.rows(engine.query("select n from t where x > 5", "t")) == [{"n": 2}]
    assert engine.warm(["n"], "t") == 6 and engine.memory_stats()["tables"] == 1


def test_names_keep_their_case(spark):
    e = Engine(spark)
    e.load("t", spark.createDataFrame([(1, 2)], "`A b.c` int, a int"))
    assert rows(e.query('select "A b.c", a from t')) == [(1, 2)]
    with pytest.raises(SqlError, match="there is no column"):
        e.query('select "A" from t')
    with pytest.raises(TypeError, match="not supported"):
        e.load("u", spark.createDataFrame([([1],)], "x array<int>"))


BATCH = [
    "select region, count(*) n, sum(capacity) s from t where year > 2000 group by region order by n desc, region",
    "select year, count(capacity) c, min(capacity) lo, max(region) hi from t group by year order by year limit 3 offset 1",
    "select count(*) n, sum(year) y, max(capacity) m from t where region = 'nowhere'",
    "select count(*) n from t where capacity > 3",
    "select median(capacity) from t",
    "select region from t group by region order by region",
]


def test_batch_equals_single_runs(spark):
    e = Engine(spark)
    data = [("eu", 1.0, 2000), ("us", 2.0, 2001), ("eu", 3.0, 2002), ("asia", 4.0, 2003), ("us", None, 2004), ("eu", 6.0, 2000), ("us", 7.0, 2001), (None, 8.0, 2002), ("asia", 9.0, 2003), ("eu", 10.0, 2004)]
    e.load("t", spark.createDataFrame(data, "region string, capacity double, year int"))
    assert [rows(x) for x in e.query(BATCH)] == [rows(e.query(s)) for s in BATCH]
    assert [x.columns for x in e.query(BATCH)] == [e.query(s).columns for s in BATCH]
    with pytest.raises(SqlError, match="statement 2: there is no column"):
        e.query([BATCH[0], "select nope from t"])


def test_facets_equal_a_plain_recount(spark):
    rng = random.Random(5)
    data = [(rng.choice(["eu", "us", "asia", None]), rng.choice(["open", "closed"]), rng.choice([1, 2, 3, None]), rng.random() * 10) for _ in range(300)]
    df = facets.with_position(spark.createDataFrame(data, "region string, status string, size int, amount double"))
    dims = ["region", "status", "size"]
    for selected in ({}, {"region": ["eu"]}, {"region": ["eu", None], "size": [1, 2]}, {"status": ["none"]}):
        ok = lambda r, d: not selected.get(d) or r[dims.index(d)] in selected[d]  # noqa: B023, E731
        want = {}
        for d in dims:
            for r in data:
                if all(ok(r, o) for o in dims if o != d):
                    v = r[dims.index(d)]
                    want[d, None if v is None else str(v)] = want.get((d, None if v is None else str(v)), 0) + 1
        found = facets.facet_refresh(df, dims, selected, "amount")
        assert {(d, v): n for d, v, n in rows(found.counts)} == want
        passing = [r for r in data if all(ok(r, d) for d in dims)]
        n, total = found.totals.first()
        assert n == len(passing) == found.rows.count() and (total or 0) == pytest.approx(sum(r[3] for r in passing))
    top = facets.sort_topk(df, "amount", 5, "_pos")
    assert [r["_pos"] for r in top.collect()] == sorted(range(300), key=lambda i: -data[i][3])[:5]
    assert [tuple(r) for r in facets.gather(df, [5, 0, 299, 5, 1000], ["region", "amount"]).collect()] == [(data[i][0], data[i][3]) for i in (5, 0, 299, 5)]


def test_dimension_join(spark):
    facts = spark.createDataFrame([("eu", 1), ("xx", 2), (None, 3)], "cat string, v int")
    dims = spark.createDataFrame([("eu", "A"), ("us", "B")], "k string, label string")
    assert sorted(rows(dimension_join(facts, dims, [("cat", "k")])), key=lambda r: r[1]) == [("eu", 1, "A", 1), ("xx", 2, None, 0), (None, 3, None, 0)]
    assert rows(dimension_join(facts, dims, [("cat", "k")], "inner")) == [("eu", 1, "A")]
    with pytest.raises(JoinError, match="not unique"):
        dimension_join(facts, dims.union(dims), [("cat", "k")])
    with pytest.raises(JoinError, match="both sides"):
        dimension_join(facts, dims.withColumnRenamed("label", "v"), [("cat", "k")])
    with pytest.raises(JoinError, match="cannot join"):
        dimension_join(facts, dims, [("v", "k")])


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('\ufeffname,n,x,d,at,note\n"a, ""b""",1,1.5,2020-01-02,2020-01-02 03:04:05,\r\nc,,2,,2020-01-02T03:04,"two\nlines"\nd,-3,,2021-05-06,,x\n', encoding="utf-8")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "date", "timestamp_ntz", "string"]
    got = df.collect()
    assert got[0]["name"] == 'a, "b"' and got[0]["note"] == "" and got[1]["n"] is None and got[1]["note"] == "two\nlines" and str(got[2]["d"]) == "2021-05-06"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_csv(spark, str(tmp_path / "bad.csv")).collect()
    assert {k: v.value for k, v in sniff(spark.createDataFrame([("true", None), ("false", None)], "a string, b string")).items()} == {"a": "text", "b": "text"}


def test_command_line(spark, tmp_path):
    (tmp_path / "f.csv").write_text("cat,v\neu,1\nus,2\neu,3\n")
    (tmp_path / "d.csv").write_text("cat,label\neu,A\nus,B\n")
    f, d, run = str(tmp_path / "f.csv"), str(tmp_path / "d.csv"), lambda *a: (main(list(a), spark, out := io.StringIO()), out.getvalue())
    assert run("convert", f, str(tmp_path / "f.parquet")) == (0, "3 rows\n")
    assert "v  kind int  nulls 0  min 1  max 3" in run("inspect", str(tmp_path / "f.parquet"))[1]
    code, text = run("query", f, "select cat, sum(v) s from t group by cat order by cat", "--bench", "1")
    assert code == 0 and "eu 4" in " ".join(text.split()) and "median" in text
    assert "B" in run("query", f, "select label from t join d using (cat) where v = 2", "--table", f"d={d}")[1]
    assert run("materialize", f, "select v from t where v > 1", str(tmp_path / "m.parquet")) == (0, "2 rows\n")
    assert run("join", f, d, str(tmp_path / "j.parquet"), "--on", "cat") [0] in (0, 1)
    code, text = run("query", f, "select nope from t")
    assert code == 1 and "there is no column nope" in text


def test_describe(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (3, "b")], "n int, s string").coalesce(1)
    assert describe(df) == {"rows": 3, "partitions": 1, "columns": [{"name": "n", "kind": "int", "nulls": 1, "min": 1, "max": 3}, {"name": "s", "kind": "text", "nulls": 0}]}
    assert is_clustered(df, "s") and not is_clustered(df.unionByName(df), "s")
    for values in ([], [None], [1, 1, None, 2, None], [1, None, 1], [3, 3, 1, 1, 1, 2], [1, 2, 2, 1]):
        runs = [v for i, v in enumerate(values) if v is not None and (not i or values[i - 1] != v)]
        one = spark.createDataFrame([(v,) for v in values], "v int")
        assert is_clustered(one.repartition(1) if not values else one.coalesce(1), "v") == (len(runs) == len(set(runs)))
        assert is_clustered(spark.sparkContext.parallelize([(v,) for v in values], 3).toDF("v int"), "v") == (len(runs) == len(set(runs)))


def test_describe_tells_files_and_order(engine, tmp_path):
    engine.materialize("sorted", "select n + 1 as m, n % 2 as o from t order by o, m desc, 1", "t", persist=str(tmp_path / "sorted"))
    found = engine.describe("sorted", clustered=True)
    assert found["sorted_by"] == ["o"] and found["files"] >= 1 and found["bytes"] > 0 and "o" in found["clustered"]


def test_one_bad_statement_of_a_batch_leaves_the_others(engine):
    found = engine.query_each(["select count(*) n from t", "select nope from t", "select n + 1 from t limit 1", "select from"], "t")
    assert [isinstance(x, SqlError) for x in found] == [False, True, False, True] and found[0].first()[0] > 0
    with pytest.raises(SqlError, match="statement 2"):
        engine.query(["select count(*) n from t", "select nope from t"], "t")


def test_statements_of_several_lines():
    from tessella.cli import _statements

    assert list(_statements(["select 1\n", "from t;\n", "\n", "select 2 from t\n", "\n", "select 3\n", "from t"])) == ["select 1\nfrom t;\n", "select 2 from t\n", "select 3\nfrom t"]


def test_numbers_and_countries_by_locale(engine):
    one = lambda sql: rows(engine.query(f"select {sql} from t limit 1"))[0]
    assert one("format_number(1234567.89, 'en-US'), format_number(-0.25, 'en-US'), format_number(1234567.25, 'de-CH'), format_number(null, 'en-US')") == ("1,234,567.9", "-0.3", "1’234’567.3", None)
    assert one("format_number(999949, 'en-US:compact'), format_number(999950, 'en-US:compact'), format_number(-1500000000, 'en-US:compact'), format_number(12, 'en-US:compact')") == ("999.9K", "1M", "-1.5B", "12")
    assert one("country_name('usa'), country_name('NP'), country_name('de', 'fr'), country_name('qq'), country_name(''), country_name(null)") == (None, "Nepal", "Allemagne", "QQ", None, None)
    assert one("unaccent('שָׁלוֹם'), unaccent('हिन्दी'), unaccent('Zürich')") == ("שלום", "हनद", "Zurich")


def test_scans_are_pruned_and_pushed_down(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 7).cast("int").alias("b"), F.lit("x").alias("c")).write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.load("t", read_parquet(spark, str(tmp_path / "t")))
    plan = e.query("select sum(a) s from t where b = 3 and a > 10")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(b,3)" in plan and "GreaterThan(a,10)" in plan and "c:string" not in plan
