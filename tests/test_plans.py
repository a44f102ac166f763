"""What scripts compile to: plans, order, null semantics, errors before a job runs."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import columns
from weftline.lang.diagnostics import ScriptError
from weftline.plans.engine import Engine
from weftline.plans.typed import Value


@pytest.fixture
def engine(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("g"), F.when(F.col("id") % 10 != 3, (F.col("id") * 1.5)).alias("v"), F.concat(F.lit("n"), F.col("id")).alias("name")).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.createDataFrame([(1, "one"), (2, "two"), (None, "none"), (2, "zwei")], "k long, label string").coalesce(1).write.parquet(str(tmp_path / "u.parquet"))
    return Engine(spark).bind_folder(str(tmp_path), "t", "u")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_filter_and_columns_reach_the_scan(engine):
    told = plan(engine.query("t[*] | where x => x.id > 5 && x.v > 3 | select x => { id: x.id }"))
    assert "PushedFilters: [IsNotNull(id), IsNotNull(v), GreaterThan(id,5), GreaterThan(v,3.0)]" in told
    assert "name" not in told.split("ReadSchema")[1] and "monotonically" not in told


def test_group_aggregates_fuse(engine):
    told = plan(engine.query("t[*] | groupBy x => x.g | select r => { g: r.key, n: (r.items | count), s: (r.items | where x => x.id > 3 | select x => x.v | sum) }"))
    assert "partial_sum" in told and "partial_count" in told and "collect_list" not in told


def test_lookup_is_a_join_and_membership_a_semi_join(engine):
    assert "Join" in plan(engine.query("let f = memo k => u[*] | first r => r.k == k\nt[*] | select x => { l: f(x.id).label }"))
    assert "LeftSemi" in plan(engine.query("t[*] | where x => x.id.in(u[*] | select r => r.k)"))
    assert "LeftAnti" in plan(engine.query("t[*] | where x => !x.id.in(u[*] | select r => r.k)"))


def test_top_k_is_taken_while_sorting(engine):
    assert "TakeOrderedAndProject" in plan(engine.query("t[*] | orderBy x => x.v desc | take 3 | select x => x.id"))


def test_lookup_takes_the_first_row(engine):
    got = rows(engine.query("let f = memo k => u[*] | first r => r.k == k\nt[*] | where x => x.id < 4 | select x => { id: x.id, l: f(x.id).label }"))
    assert sorted(got) == [(0, None), (1, "one"), (2, "two"), (3, None)]


def test_null_keys_match_null(engine):
    got = rows(engine.query("u[*] | join u on a => a.k equals b => b.k into b | where r => r.k == null | select r => { l: r.b.label }"))
    assert got == [("none",)]


def test_nulls_count_as_zero_in_arithmetic_and_comparison(engine):
    assert rows(engine.query("t[*] | where x => x.id == 3 | select x => { a: x.v + 1, b: x.v < 1, c: x.v > -1, d: x.v == null, e: 'x' + x.v, f: -x.v }")) == [(1.0, True, True, True, "x", 0.0)]


def test_sums_and_groups_with_nulls(engine):
    got = dict(rows(engine.query("u[*] | groupBy r => r.k | select g => { k: g.key, n: (g.items | count) }")))
    assert got == {1: 1, 2: 2, None: 1}
    assert rows(engine.query("{ s: (t[*] | where x => x.id == 3 | select x => x.v | sum), m: (t[*] | where x => x.id > 1000 | select x => x.v | max) }")) == [(0.0, None)]


def test_order_is_kept(engine):
    assert [r[0] for r in rows(engine.query("t[*] | orderBy x => x.g, x => x.id desc | take 3 | select x => x.id"))] == [98, 91, 84]
    assert rows(engine.query("t[*] | where x => x.g == 0 | take 2 | select x => x.id")) == [(0,), (7,)]
    assert rows(engine.query("(t[*] | where x => x.id > 90 | last).name")) == [("n99",)]


def test_groups_keep_their_items_in_order(engine):
    assert rows(engine.query("t[*] | where x => x.id < 10 | groupBy x => x.g | select g => { g: g.key, ids: (g.items | select x => x.id) } | orderBy r => r.g | take 2")) == [(0, [0, 7]), (1, [1, 8])]
    assert rows(engine.query("t[*] | where x => x.id < 10 | groupBy x => x.g | where g => (g.items | count) > 1 | count")) == [(3,)]


def test_index_and_batch_number_rows_in_read_order(engine):
    assert rows(engine.query("t[*] | where x => x.g == 1 | index | select i => i + 1", ordered=True))[:3] == [(1,), (2,), (3,)]
    got = rows(engine.query("t[*] | where x => x.id < 5 | select x => x.id | batch 2"))
    assert sorted(got) == [([0, 1],), ([2, 3],), ([4],)]


def test_take_while_stops_at_the_first_failure(engine):
    assert len(rows(engine.query("t[*] | orderBy x => x.id desc | takeWhile x => x.id != 95"))) == 4
    assert len(rows(engine.query("t[*] | takeWhile x => x.id >= 0"))) == 100


def test_arrays_within_items(engine):
    q = "t[*] | where x => x.id == 5 | select x => { a: (range(0, 6) | where i => i > x.id - 3 | select i => i * 10), b: (range(1, 4) | reduce (s, i) => s + i from 0.5), c: ([3, 1, 2] | orderBy i => i desc | concat), d: (['a', 'b', 'a'] | groupBy s => s | select g => `{g.key}{g.items.count()}`) }"
    assert rows(engine.query(q)) == [([30, 40, 50], 10.5, "3|2|1", ["a2", "b1"])]


def test_objects_by_computed_keys(engine):
    assert rows(engine.query("t[*] | where x => x.id == 5 | select x => { m: ([{ k: 'a', v: 1 }, { k: 'b', v: 2 }, { k: 'a', v: 3 }] | reduce (acc, f) => { ...acc, [f.k]: f.v } from {}) }"))[0][0] == {"b": 2, "a": 3}


def test_join_without_alias_keeps_the_left_of_equal_names(engine):
    got = engine.query("t[*] | select x => { k: x.id, label: 'left' } | join u on a => a.k equals b => b.k")
    assert got.columns == ["k", "label"] and {r[1] for r in rows(got)} == {"left"}


def test_documents_lane(spark):
    df = spark.createDataFrame([('{"a": [1, 2, {"b": 3}]}',), (None,)], "j string")
    got = rows(Engine(spark).documents(df, "j", "$..b | sum"))
    assert [r[1] for r in got] == ["3", "0"]


def test_host_method(engine):
    engine.register("double", lambda x, args: Value(x.col * 2, x.type))
    assert rows(engine.query("t[*] | where x => x.id == 4 | select x => x.id.double()")) == [(8,)]
    assert "double" not in columns.METHODS


@pytest.mark.parametrize(("script", "word"), [("t[*] | select x => $.tt", "Did you mean 't'"), ("tt[*]", "Did you mean"), ("t[*] | select x => x.name.toUper()", "toUpper"), ("t[*] | select x => $.u.lable?", "value"), ("t[*] | select x => (u[*] | where r => r.k > x.id | count)", "join"), ("t[*] | batch 0", "above 0")])
def test_errors_come_before_any_job(engine, script, word):
    if word == "value":
        engine.query(script)
        return
    with pytest.raises(ScriptError) as e:
        engine.query(script)
    assert word in str(e.value)


def test_division_by_zero_is_an_error(engine):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        engine.query("t[*] | select x => 1 / (x.id - x.id)").collect()


def test_a_few_items_of_each_group_are_ranked_before_they_are_collected(engine):
    df = engine.query("t[*] | groupBy x => x.id == 5 | select g => { k: g.key, top: (g.items | where i => i.id > 1 | orderBy i => i.id desc | take 2 | select i => i.id), n: (g.items | count), none: (g.items | take 0 | count) }")
    told = plan(df)
    assert "WindowGroupLimit" in told and told.count("collect_list") <= 2
    got = {r["k"]: (r["top"], r["n"], r["none"]) for r in df.collect()}
    ids = sorted(r[0] for r in rows(engine.query("t[*] | select x => x.id")) if r[0] is not None and r[0] > 1 and r[0] != 5)
    assert got[True][0] == [5] and got[False][0] == ids[::-1][:2] and got[False][2] == 0


@pytest.mark.parametrize("order", ["v", "v desc", "s", "s desc", "d", "d desc", "s, v desc"])
def test_sorted_rows_are_numbered_by_ranges(spark, order):
    rng = random.Random(4)
    data = [(k, rng.choice([None, rng.uniform(-5, 5), 0.0, float("inf"), float("-inf"), float("nan")]), rng.choice([None, "", "é", "z", "zz", "zé", "a" * 5, str(rng.random())]), rng.choice([None, datetime.date(2000, 1, 1) + datetime.timedelta(rng.randint(0, 999))])) for k in range(300)]
    df = spark.createDataFrame(data, "k int, v double, s string, d date")
    keys = ", ".join("x => x." + part for part in order.split(", ")) + ", x => x.k"
    numbered = Engine(spark).bind("t", df).query(f"t[*] | orderBy {keys} | batch 7", ordered=True)
    want = df.orderBy(*[F.col(part.split(" ")[0]).desc() if " " in part else F.col(part) for part in order.split(", ")], "k").select("k").collect()
    got = [x.k for r in numbered.collect() for x in r[0]]
    assert got == [r.k for r in want]
    assert "row_number() windowspecdefinition(__w_p" in plan(numbered)


def test_iterate_ends_by_its_values(engine):
    q = "t[*] | where x => x.id == 5 | select x => { a: (iterate(x.id, i => i * 3) | takeWhile i => i < 200), b: (iterate({ a: 0, b: 1 }, s => { a: s.b, b: s.a + s.b }) | first s => s.a > x) }"
    with pytest.raises(ScriptError, match="its item only"):
        engine.query(q)
    q = "t[*] | where x => x.id == 5 | select x => { a: (iterate(x.id, i => i * 3) | takeWhile i => i < 200 | select i => i + 1), b: (iterate({ a: 0, b: 1 }, s => { a: s.b, b: s.a + s.b }) | first s => s.a > 50).a }"
    assert rows(engine.query(q)) == [([6, 16, 46, 136], 55)]
