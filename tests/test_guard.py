"""What guarded SQL lets through, what it refuses, and which combinations mix currencies."""

import pytest

from tidemark.errors import Refused
from tidemark.plans import guard
from tidemark.plans.combine import MAX_ROWS, Handle, Store, column_names, combine_frames, inferred_types, jsonable, load

TABLES = {"t", "u"}


@pytest.fixture(scope="module")
def frames(spark):
    t = spark.createDataFrame([(k, f"r{k % 3}", ["USD", "EUR"][k % 2], float(k), f"2024-01-{k + 1:02d}") for k in range(12)], "id int, region string, ccy string, value double, day string")
    u = spark.createDataFrame([(k, f"r{k % 4}", ["USD", "EUR"][k % 2], k * 2.0) for k in range(8)], "id int, region string, ccy string, value double")
    return {"t": t, "u": u}


OK = [
    "select region, count(*) from t group by 1", "select region, count(*) filter (where value > 3) as n from t group by region order by n desc nulls last", "with x as (select * from t), y as (select region, avg(value) v from x group by 1) select * from y where v > 1",
    "select rank() over (partition by region order by value desc) r, sum(value) over (partition by region) s from t", "select date_trunc('month', to_date(day)) m, count(*) from t group by 1", "select datediff(to_date(day), date'2024-01-01') d from t", "select case when value > 5 then 'a' else 'b' end k from t",
    "select region from t union all select region from u order by 1 limit 3", "select t.region, count(*) from t left join u on t.id = u.id group by 1 having count(*) > 1", "select * from t where region in (select region from u)", "select t.id, m from t, lateral (select max(value) m from u where u.region = t.region) q",
    "select * from t tablesample (50 percent)", "select id from range(5)", "select explode(sequence(1, 3)) as x", "select * from values (1, 'a'), (2, 'b') as v(x, y)", "select /* note */ id from t -- end", "select id, (select count(*) from u where u.region = t.region) n from t",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 4) select * from r", "select * from t full outer join u using (region)", "select sum(abs(t.value)) from t join u using (id)", "select avg(value) over (partition by region order by id rows between 4 preceding and current row) m, lag(value) over (order by id) l from t",
    "select region from t except select region from u", "select region from t intersect select region from u", "select round(100.0 * sum(value) / nullif(count(*), 0), 2) from t", "select percentile_cont(0.5) within group (order by value) from t", "select region, count(*) from t group by rollup (region)", "select * from (select *, row_number() over (partition by region order by day desc) n from t) where n = 1",
    "select * from t where not exists (select 1 from u where u.id = t.id)", "select regexp_replace(region, 'r', 'x') from t where region rlike '^r[0-9]$'", r"select * from t where region like 'r\_%'", "select unix_timestamp(to_timestamp(day)), .5, 5., 1e3 from t;",
]
HOSTILE = [
    "drop table t", "insert into t values (1)", "delete from t", "update t set id = 1", "create table x as select 1", "set spark.sql.ansi.enabled=false", "show tables", "describe t", "use db", "select 1; select 2", "", "   ", "select * from secret", "select * from t where id in (select id from secret)", "with x as (select * from secret) select * from x",
    "select * from t, lateral (select * from secret) s", "select exists(select 1 from secret)", "select * from parquet.`/etc/passwd`", "select * from csv.`/etc/passwd`", "select * from spark_catalog.default.t", "select * from db.t", "select java_method('java.lang.System', 'exit', '0')", "select reflect('java.lang.System', 'getenv')", "select * from read_files('/etc')",
    "select input_file_name() from t", "select current_user()", "select current_database()", "select version()", "select spark_partition_id() from t", "select assert_true(false)", "select raise_error('x')", "select from_json(day, 'a int') from t", "select transform(array(1), x -> x) from t", "cache table t", "explain select 1", "analyze table t compute statistics", "truncate table t",
    "select sleep(10)", "select xpath('<a/>', 'a') from t", "select aes_decrypt('a', 'b')", "select try_java_method('a', 'b')", "describe function abs", "add jar x", "refresh table t", "alter table t add columns (x int)", "select * from `t`.`u`", "from t insert overwrite directory '/tmp/x' select *", "merge into t using u on t.id = u.id when matched then delete", "select getbit(1, 0)", "values (java_method('a', 'b'))",
    "select /*+ broadcast(t) */ secret.id from t join secret", "select * from t order by (select max(id) from secret)", "select * from t limit (select count(*) from secret)", "select count(*) over (order by java_method('a','b')) from t", "with t as (select 1), x as (select * from secret) select * from t", "select t.id from t group by t.id having max(value) > (select max(id) from secret)", "select x\0 from t",
]


@pytest.mark.parametrize("sql", OK)
def test_accepted_and_runs(spark, frames, sql):
    session = spark.newSession()
    for name, df in frames.items():
        guard.session_view(session, name, df)
    assert session.sql(guard.check(session, sql, TABLES)).count() >= 0


@pytest.mark.parametrize("sql", HOSTILE)
def test_refused(spark, sql):
    with pytest.raises(Refused):
        guard.check(spark, sql, TABLES)


@pytest.mark.parametrize("sql", ["with recursive r(n) as (select 1 union all select n + 1 from r) select * from r", "select * from t tablesample (1 percent)", "select * from values (1) v(x)", "select explode(array(1, 2))", "select collect_list(value) from t", "select listagg(region) from t", "select * from t, lateral (select max(value) from u) q", "select array_agg(value) from t", "select 1", "select percentile_cont(0.5) within group (order by value) from t", "select id from range(3)"])
def test_combine_refuses_more(spark, frames, sql):
    with pytest.raises(Refused):
        combine_frames(spark, sql, handles(frames))


def handles(frames):
    return {k: Handle(df, frozenset({"value"}), "ccy") for k, df in frames.items()}


KEPT = [
    "select ccy, sum(value) as s from t group by ccy", "select ccy, region, max(value) as m from t group by ccy, region", "select count(*) as n, count(value) as k from t", "select ccy as c, avg(value) as a from t group by ccy", "with x as (select ccy, value from t) select ccy, sum(value) as s from x group by ccy",
    "select ccy, sum(v) as s from (select ccy, value * 2 as v from t) group by ccy", "select ccy, value, sum(value) over (partition by ccy) as s from t", "select t.ccy, sum(t.value) as s from t join u on t.id = u.id group by t.ccy", "select ccy, sum(value) as s from (select ccy, value from t union all select ccy, value from u) group by ccy", "select region, value, ccy from t order by value limit 3",
    "select region, rank() over (order by value) as r from t", "select ccy, sum(value) as s from t group by all", "select ccy, region, sum(value) over (partition by ccy order by id) as s from t", "select approx_count_distinct(value) as n from t", "select ccy, median(value) as m from t where value > 1 group by ccy having count(*) > 1",
]
MIXED = [
    "select sum(value) as s from t", "select region, sum(value) as s from t group by region", "select min(value) as m from t", "select region, max(value) as m from t group by region", "select 'USD' as ccy, sum(value) as s from t", "select upper(ccy) as ccy, sum(value) as s from t group by upper(ccy)", "select sum(value) as s from t group by ccy",
    "with x as (select region, value from t) select region, avg(value) as s from x group by region", "select u.ccy, sum(t.value) as s from t join u on t.id = u.id group by u.ccy", "select a.ccy, sum(b.value) as s from t a join t b on a.id = b.id group by a.ccy", "select region, sum(value) over (partition by region) as s from t", "select region, sum(value) over (partition by ccy) as s from t",
    "select ccy, sum(value) as s from t group by rollup (ccy)", "select ccy, sum(value) as s from t group by cube (ccy, region)", "select ccy, sum(value) as s from t group by grouping sets ((ccy), ())", "select ccy, (select max(value) from u) as m from t", "select * from t where value > (select avg(value) from t)",
    "select ccy, sum(value) as s from (select region as ccy, value from t) group by ccy", "select ccy, sum(value) as s from (select ccy, value from t union all select region, value from u) group by ccy", "select sum(s) as total from (select ccy, sum(value) as s from t group by ccy)", "with x as (select ccy, value from t) select a.ccy, sum(b.value) as s from x a cross join x b group by a.ccy",
    "select median(value) as m from t", "select stddev(value) as m from t", "select any_value(value) as m from t", "select lag(value) over (order by id) as p from t", "select first_value(value) over (partition by region order by id) as p from t", "select sum(value + 1) as s from t", "select sum(case when ccy = 'USD' then value end) as s from t", "select coalesce(ccy, 'X') as ccy, sum(value) as s from t group by 1",
    "select sum(t.value + u.value) as s, t.ccy from t join u using (id) group by t.ccy", "select ccy, sum(v) as s from (select t.ccy, u.value as v from t join u using (id)) group by ccy",
]


@pytest.mark.parametrize("sql", KEPT)
def test_currency_kept(spark, frames, sql):
    assert combine_frames(spark, sql, handles(frames)).frame.count() >= 1


@pytest.mark.parametrize("sql", MIXED)
def test_currency_mixed(spark, frames, sql):
    with pytest.raises(Refused) as e:
        combine_frames(spark, sql, handles(frames))
    assert e.value.code == "mixed_currency"


def test_no_currency_column_fails_closed(spark, frames):
    bare = {"t": Handle(frames["t"].drop("ccy"), frozenset({"value"}), None)}
    with pytest.raises(Refused):
        combine_frames(spark, "select region, sum(value) as s from t group by region", bare)
    assert combine_frames(spark, "select region, count(*) as n from t group by region", bare).frame.count() == 3


def test_lineage_goes_on(spark, frames):
    one = combine_frames(spark, "select ccy as money, sum(value) as total, count(*) as n from t group by ccy", handles(frames))
    assert (one.amounts, one.ccy) == (frozenset({"total"}), "money")
    with pytest.raises(Refused):
        combine_frames(spark, "select sum(total) as x from a", {"a": one})
    assert combine_frames(spark, "select money, sum(total) as x, sum(n) as k from a group by money", {"a": one}).frame.count() == 2


def test_load_ladder(spark):
    assert column_names([" A ", "a", "", "b"]) == ["a", "a_2", "col_2", "b"]
    rows = [[True, 1, 1.5, "x", None, 2**70, 1, [1, 2]], [False, None, 2, None, None, 1, "y", {"a": 1}]]
    schema = inferred_types(list("abcdefgh"), rows)
    assert [f.dataType.simpleString() for f in schema] == ["boolean", "bigint", "double", "string", "string", "string", "string", "string"]
    assert load(spark, list("abcdefgh"), rows).count() == 2
    assert [jsonable(float("nan")), jsonable(float("-inf")), jsonable(b"\xff"), jsonable({"a": (1, None)})] == ["NaN", "-Infinity", "�", {"a": [1, None]}]


def test_store(spark, frames):
    now = [0.0]
    store = Store(ttl_s=10, own=2, clock=lambda: now[0])
    a = store.put("x", Handle(frames["t"], truncated=True))
    assert store.summary("x", a)["truncated"] and len(store.page("x", a, 10, 5)["rows"]) == 2
    b, c = store.put("x", Handle(frames["u"])), store.put("y", Handle(frames["u"]))
    store.get("x", a)
    store.put("x", Handle(frames["u"]))  # the least recently read of x goes, y's stays
    for sub, name, there in (("x", a, True), ("x", b, False), ("y", c, True), ("y", a, False)):
        if there:
            store.get(sub, name)
        else:
            with pytest.raises(Refused):
                store.get(sub, name)
    now[0] = 11
    with pytest.raises(Refused):
        store.get("y", c)
    cut = combine_frames(spark, "select region from t", {"t": Handle(frames["t"], truncated=True)})
    assert cut.partial and cut.truncated


def test_combined_rows_beyond_the_cap_are_told(spark):
    big = Handle(spark.range(30_000).toDF("id"))
    store = Store()
    whole = combine_frames(spark, "select id from a", {"a": big})
    assert whole.frame.count() == 30_000
    kept = store.combine("x", "select id * 2 as twice from a where id < 9", {"a": store.put("x", big, 30_000)})
    assert not store.get("x", kept).truncated and store.get("x", kept).frame.count() == 9
    many = store.combine("x", "select id from a", {"a": store.put("x", big, 30_000)})
    assert store.get("x", many).truncated and store.get("x", many).frame.count() == MAX_ROWS
    pages = [r[0] for k in range(0, 1000, 200) for r in store.page("x", many, k)["rows"]]
    assert pages == [r[0] for k in range(0, 1000, 200) for r in store.page("x", many, k)["rows"]] and len({*pages}) == 1000


def test_store_holds_bytes_and_odd_columns(spark, tmp_path):
    rows = spark.range(2000).selectExpr("sha2(cast(id as string), 512) as s")
    store = Store(own_bytes=400_000)
    a, b = store.put("x", Handle(rows)), store.put("x", Handle(rows))
    c = store.put("x", Handle(rows))
    held = [n for n in (a, b, c) if ("x", n) in store.held]
    assert held and held[-1] == c and a not in held
    with pytest.raises(Refused) as e:
        Store(own_bytes=100).put("x", Handle(rows))
    assert e.value.code == "too_large"
    odd = store.put("x", Handle(spark.sql("select 1 as a, null as A, interval 1 day as b, 'x' as `c d`")))
    assert store.page("x", odd)["rows"] == [[1, None, "INTERVAL '1' DAY", "x"]] and store.page("x", odd)["columns"] == ["a", "a_2", "b", "c d"]


def test_relations_of_a_statement(spark):
    named = lambda sql: guard.relations(spark, sql, {"t", "u", "v"})
    assert named("with x as (select * from T) select (select max(id) from u) from x") == {"t", "u"} and named("select 1") == set()
