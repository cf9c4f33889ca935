"""Edge cases of the operators: nulls, empties, ties, rejects, files, streams, jobs."""

import gzip

import pytest

from flowloom.errors import ConfigurationError, JobAborted
from flowloom.operators import aggregate, extract, joins, order, reshape, rows
from flowloom.operators.joins import Lookup, Output
from flowloom.plans.job import Job, Step
from flowloom.plans.schema import Field, enforce
from flowloom.sources import files, made, sinks
from flowloom.sources.jdbc import upsert_statement
from flowloom.streaming.batches import each_batch


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_filter_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "n int, s string")
    keep = lambda *c: rows_of(rows.filter_rows(df, list(c))["main"])
    assert len(keep({"column": "s", "operator": "!=", "value": "a"})) == 2
    assert len(keep({"column": "s", "operator": "NOT_CONTAINS", "value": "a"})) == 2
    assert keep({"column": "none", "operator": "==", "value": 1}) == []
    assert len(keep()) == 3
    reject = rows.filter_rows(df, [{"column": "n", "operator": ">", "value": "1"}])["reject"]
    assert reject.count() == 2 and "n > 1" in reject.first()["errorMessage"]
    with pytest.raises(ConfigurationError):
        keep({"column": "s", "operator": "LIKE", "value": 1})


def test_replace_literals(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("$1",), (None,)], "s string")
    out = rows.replace(df, [{"column": "s", "search": "a.b", "replacement": "$1\\"}])
    assert rows_of(out) == sorted([("$1\\",), ("axb",), ("$1",), (None,)], key=str)
    assert rows_of(rows.replace(df, [{"column": "s", "search": "A?b", "replacement": "g", "use_glob": True}])).count(("g",)) == 2


def test_schema_rejects_and_defaults(spark):
    df = spark.createDataFrame([("1", "01/02/2024", None), ("x", "2024-02-01", "k")], "n string, d string, k string")
    out = enforce(df, [Field("k", nullable=False), Field("n", "int"), Field("d", "datetime", date_pattern="%d/%m/%Y"), Field("new", "int", nullable=False)])
    assert [tuple(map(str, r)) for r in out["main"].collect()] == [("k", "None", "2024-02-01 00:00:00", "0")]
    assert out["reject"].first()["errorMessage"] == "Column 'k': non-nullable column has null"


def test_join_first_match_case_and_nulls(spark):
    main = spark.createDataFrame([(1, "A"), (2, "b"), (3, None)], "id int, k string")
    lookup = spark.createDataFrame([("a", "second", 2), ("a", "first", 1), (None, "null", 0)], "k string, v string, o int")
    out = joins.join(main, lookup, {"k": "k"}, lookup_columns={"v": "v"}, case_sensitive=False, order_by=["o"])
    assert rows_of(out["main"]) == [(1, "A", "first"), (2, "b", None), (3, None, None)]
    assert [r[0] for r in rows_of(out["reject"])] == [2, 3]


def test_map_empty_lookup_and_reject(spark):
    main = spark.createDataFrame([(1,), (2,)], "id int")
    empty = spark.createDataFrame([], "id int, v string")
    outputs = [Output("out", {"id": "m.id", "v": "l.v"}), Output("no", {"id": "m.id", "v": "Var.x"}, inner_join_reject=True)]
    left = joins.map_rows(main, "m", [Lookup("l", empty, {"id": "m.id"})], outputs, {"x": "l.v"})
    assert rows_of(left["out"]) == [(1, None), (2, None)] and rows_of(left["no"]) == []
    inner = joins.map_rows(main, "m", [Lookup("l", empty, {"id": "m.id"}, inner=True)], outputs, {"x": "l.v"})
    assert rows_of(inner["out"]) == [] and rows_of(inner["no"]) == [(1, None), (2, None)]


def test_aggregate_edges(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), (None, 3.0, 3), ("b", None, 4)], "k string, v double, o int")
    ops = [{"output": f, "function": f, "input": "v", "scale": 2} for f in ("sum", "avg", "std", "first", "list")]
    assert [tuple(map(str, r)) for r in rows_of(aggregate.aggregate(df, ["k"], ops, ["o"]))] == [("a", "2.00", "2.000000", "None", "2.0", "2.0"), ("b", "0.00", "None", "None", "None", "")]
    assert aggregate.aggregate(df, ["k"], ops, ["o"], null_keys="keep").count() == 3
    assert aggregate.aggregate(df.limit(0), [], ops).count() == 0


def test_unique_keep_none_and_last(spark):
    df = spark.createDataFrame([("a", 1), ("A", 2), (None, 3), (None, 4), ("b", 5)], "k string, o int")
    assert rows_of(aggregate.unique_rows(df, ["k"], "last", ["o"], case_insensitive=["k"])["unique"]) == sorted([("A", 2), (None, 4), ("b", 5)], key=str)
    assert rows_of(aggregate.unique_rows(df, ["k"], "none", ["o"], case_insensitive=["k"])["unique"]) == [("b", 5)]


def test_normalize_edges(spark):
    df = spark.createDataFrame([(1, "a,,b,,"), (2, None), (3, ",,")], "id int, s string")
    assert [r[1] for r in rows_of(reshape.normalize(df, "s")) if r[0] == 1] == ["", "", "", "a", "b"]
    assert rows_of(reshape.normalize(df, "s", discard_trailing_empty=True)) == [(1, ""), (1, "a"), (1, "b")]
    assert (2, "") in rows_of(reshape.normalize(df, "s"))


def test_positions_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    got = rows_of(order.sample_rows(df, "1,500..502,2000", ["id"])["main"])
    assert got == [(0,), (499,), (500,), (501,)]
    assert order.sample_rows(df, "1", ["id"])["reject"].count() == 999
    with pytest.raises(ConfigurationError):
        order.sample_rows(df, "a", ["id"])


def test_extract_rejects(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}'), (2, "{"), (3, None), (4, "")], "id int, j string")
    out = extract.extract_json(df, "j", {"a": "$.a"})
    assert rows_of(out["main"].select("id", "a")) == [(1, '[1,{"b":2}]')]
    assert rows_of(out["reject"].select("id", "errorCode")) == [(2, "PARSE_ERROR"), (3, "NO_JSON"), (4, "NO_JSON")]
    bad = extract.extract_xml(spark.createDataFrame([("<a>",), ("<a><b>1</b></a>",), (None,)], "x string"), "x", "/a/b", {"v": "."})
    assert [r.v for r in bad["main"].collect()] == ["1"] and rows_of(bad["reject"].select("errorCode")) == [("NO_XML",), ("PARSE_ERROR",)]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("h\nid||name||d\n1||é||2024-01-31\nx||b||2024-01-31\n\n3||c||bad\n4||d\nfoot\n".encode("ISO-8859-15"))
    fields = [Field("id", "int"), Field("name"), Field("d", "datetime")]
    out = files.read_delimited(spark, str(tmp_path / "a.txt"), fields, "||", header=2, footer=1)
    assert [(r.id, r.name) for r in out["main"].collect()] == [(1, "é"), (4, "d")]
    assert rows_of(out["reject"].select("id", "errorCode")) == [("3", "DATE_FORMAT"), ("x", "TYPE_CONVERSION")]
    (tmp_path / "b.csv").write_text('id;name;d\n1;"a;\nb";2024-01-31\n')
    assert files.read_delimited(spark, str(tmp_path / "b.csv"), fields, csv=True, header=1, encoding="UTF-8")["main"].first()["name"] == "a;\nb"
    assert files.count_rows(spark, str(tmp_path / "a.txt"), True) == 7


def test_other_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("00001 a1.234,5\n")
    got = files.read_positional(spark, str(tmp_path / "p.txt"), [Field("n", "int"), Field("s"), Field("v", "float")], [5, 2, 7], thousands=".", decimal=",")["main"].first()
    assert tuple(got) == (1, "a", 1234.5)
    (tmp_path / "c.ini").write_text("[s]\nK=v\n[t]\nk2: w\n")
    assert rows_of(files.read_properties(spark, str(tmp_path / "c.ini"))) == [("s", "K", "v"), ("t", "k2", "w")]
    (tmp_path / "j.json").write_text('{"r": [{"a": 1}, {"a": 2}]}')
    assert rows_of(files.read_json(spark, str(tmp_path / "j.json"), {"a": "$.a"}, "$.r[*]")["main"]) == [("1",), ("2",)]
    (tmp_path / "x.xml").write_text("<d><r><a>1</a><b/></r></d>")
    assert rows_of(files.read_xml_rows(spark, str(tmp_path / "x.xml"), "r", ["a", "b"])) == [("1", None)]
    assert rows_of(files.read_xml(spark, str(tmp_path / "x.xml"), "/d/r", {"a": "a"})["main"]) == [("1",)]
    assert files.read_raw(spark, str(tmp_path / "c.ini")).first()["content"].startswith("[s]")
    assert [f["name"] for f in files.list_files(spark, str(tmp_path), ["*.xml", "*.ini"], order_by="name")] == ["c.ini", "x.xml"]
    assert files.file_properties(spark, str(tmp_path / "c.ini"), md5=True).first()["size"] == 18


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", None), (2, 'q"', "z")], "n int, s string, t string").coalesce(1)
    sinks.write_delimited(df, str(tmp_path / "raw"))
    assert rows_of(spark.read.text(str(tmp_path / "raw"))) == [("1;a;b;",), ('2;q";z',)]
    sinks.write_delimited(df, str(tmp_path / "csv"), csv=True, header=True)
    assert rows_of(spark.read.csv(str(tmp_path / "csv"), header=True, sep=";", escape="\\")) == [("1", "a;b", None), ("2", 'q"', "z")]
    sinks.write_positional(df, str(tmp_path / "pos"), [{"column": "n", "size": 3, "align": "R"}, {"column": "t", "size": 3, "align": "C", "padding": "*"}], compression="gzip")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "pos").glob("*.gz")))
    assert text == b"  1***\n  2*z*\n"
    sinks.write_xml(df, str(tmp_path / "xml"), "row", "rows", ["n"])
    assert spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "xml")).count() == 2
    said = []
    assert sinks.log_rows(df, style="basic", show=said.append)["main"] is df and said == ["1|a;b|\n2|q\"|z"]


def test_made_rows_and_statement(spark):
    assert rows_of(made.fixed_rows(spark, "a int, b string", {"a": "7"}, 2)) == [(7, None), (7, None)]
    assert upsert_statement("t", ["k", "v"], ["k"], "s").startswith("MERGE INTO t t USING s s ON (t.k = s.k) WHEN MATCHED")
    with pytest.raises(ValueError):
        upsert_statement("t; drop", ["k"], ["k"], "s")


def test_job_context_and_globals(spark):
    job = Job(spark, {"n": 2})
    assert job.load_context(spark.createDataFrame([("n", "3", "id_Integer"), ("m", "x", "id_Integer")], "key string, value string, type string")) == 1
    assert job.context == {"n": 3, "m": "x"}
    job.run([Step("r", lambda n: spark.range(n), [], {"n": "${context.n}"})])
    assert job.count("r") == 3 and job.globals["r_NB_LINE"] == 3
    job.set_global("last", df=job.flows["r.main"], column="id", order_by="id")
    seen = []
    assert job.globals["last"] == 2 and job.each_row(job.flows["r.main"], lambda j, r: seen.append(r["id"])) == 3 and sorted(seen) == [0, 1, 2]
    with pytest.raises(ConfigurationError):
        job.run([Step("x", lambda d: d, ["none"])])
    with pytest.raises(JobAborted):
        job.die("stop", 4)


def test_context_keys_each_value_and_warning(spark):
    job = Job(spark, {"a": "1", "b": "2"})
    rows = spark.createDataFrame([("a", "5"), ("c", "6")], "key string, value string")
    assert job.load_context(rows, new_keys=False, name="load") == 1
    assert job.context == {"a": "5", "b": "2"}
    assert (job.globals["load_NB_CONTEXT_LOADED"], job.globals["load_KEY_NOT_INCONTEXT"], job.globals["load_KEY_NOT_LOADED"]) == (1, "c", "b")
    with pytest.raises(ConfigurationError):
        job.load_context(rows, known_must_load=True)
    with pytest.raises(ConfigurationError):
        job.load_context(rows, most=1)
    seen = []
    assert job.for_each(["x", "${context.a}"], lambda j: seen.append((j.globals["foreach_CURRENT_ITERATION"], j.globals["foreach_CURRENT_VALUE"]))) == 2
    assert seen == [(1, "x"), (2, "5")]
    job.warn("a is ${context.a}", 7)
    assert (job.globals["warn_MESSAGE"], job.globals["warn_CODE"]) == ("a is 5", 7)


def test_map_errors_keep_failing_rows_apart(spark):
    main = spark.createDataFrame([(1, "4"), (2, "x"), (3, None), (4, "0")], "id int, v string")
    outputs = [Output("main", {"id": "m.id", "inverse": "8 / Var.v"}), Output("rest", {"id": "m.id"}, is_reject=True), Output("caught", {"id": "m.id", "v": "m.v"}, catch_errors=True)]
    errors = {"no number": "m.v is not null and try_cast(m.v as int) is null", "zero": "try_cast(m.v as int) = 0"}
    out = joins.map_rows(main, "m", outputs=outputs, variables={"v": "cast(m.v as int)"}, errors=errors)
    assert sorted(map(tuple, out["main"].collect())) == [(1, 2.0), (3, None)]
    assert out["rest"].count() == 0
    assert sorted(map(tuple, out["caught"].collect())) == [(2, "x", "no number"), (4, "0", "zero")]
    bare = joins.map_rows(main, "m", outputs=outputs[1:], variables={"v": "1"})
    assert bare["caught"].count() == 0 and bare["rest"].count() == 4


def test_stream_batches(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (5, "b")], "n int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, s string").parquet(str(tmp_path / "in"))
    keep = lambda df: rows.filter_rows(df, [{"column": "n", "operator": ">", "value": 2}])
    each_batch(stream, keep, {"main": str(tmp_path / "m"), "reject": str(tmp_path / "r")}, str(tmp_path / "c")).awaitTermination(60)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [5] and spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_numbers_of_many_rows(spark):
    df = spark.range(0, 1_000_000, 1, 64).selectExpr("(id * 7919) % 1000003 key", "id")
    got = order.numbered(df, ["key", "id"], "n")
    assert got.selectExpr("count(distinct n)", "min(n)", "max(n)").first() == (1_000_000, 1, 1_000_000)
    place = {r.key: r.n for r in got.where("n in (1, 500000, 1000000)").collect()}
    keys = sorted((i * 7919) % 1000003 for i in range(1_000_000))
    assert place == {keys[0]: 1, keys[499_999]: 500_000, keys[-1]: 1_000_000}
    flows = order.sample_rows(df.withColumnRenamed("id", "position"), "1..500000", ["key"])
    assert flows["main"].count() == flows["reject"].count() == 500_000 and flows["main"].columns == ["key", "position"]
    assert order.number_rows(df, "k", ["key"], 10, 5).agg({"k": "max"}).first()[0] == 10 + 5 * 999_999


def test_heads_feet_and_limits_of_many_lines(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in "ab":
        (folder / f"{f}.txt").write_text("".join(f"{f}{i}\n" if i % 10 else "\n" for i in range(300_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = lambda **x: [r.value for r in files._lines(spark, str(folder), **x).collect()]
        whole = [f"{f}{i}" if i % 10 else "" for f in "ab" for i in range(300_000)]
        kept = whole[2:299_997] + whole[300_002:-3]
        assert sorted(read(header=2, footer=3, remove_empty=False)) == sorted(kept)
        full = [x for x in kept if x]
        assert sorted(read(header=2, footer=3, limit=400_000)) == sorted(full[:400_000])
        assert sorted(read(header=290_000, remove_empty=False)) == sorted(whole[290_000:300_000] + whole[590_000:])
        assert read(header=300_000) == [] and read(limit=0) == [] and sorted(read(limit=5)) == ["a1", "a2", "a3", "a4", "a5"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filters_reach_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    some = [{"column": "o_totalprice", "operator": ">", "value": "1000"}, {"column": "o_custkey", "operator": "==", "value": 7}, {"column": "o_orderstatus", "operator": "==", "value": "F"}]
    for x, expected in zip(some, ("GreaterThan(o_totalprice,1000.0)", "EqualTo(o_custkey,7)", "EqualTo(o_orderstatus,F)"), strict=True):
        plan = rows.filter_rows(orders, [x])["main"]._jdf.queryExecution().executedPlan().toString()
        assert expected in plan.split("PushedFilters: ")[1].split("\n")[0]
    df = spark.createDataFrame([(2**53 + 1,), (2**53,), (None,)], "n long")
    assert rows.filter_rows(df, [{"column": "n", "operator": "==", "value": str(2**53)}])["main"].count() == 1
    assert rows.filter_rows(df, [{"column": "n", "operator": "!=", "value": 2**53}])["main"].count() == 2
    assert rows.filter_rows(df, [{"column": "n", "operator": ">", "value": "1.5"}])["reject"].count() == 1


def test_aggregates_of_text(spark):
    df = spark.createDataFrame([(1, "1.5"), (1, "x"), (1, None), (2, "y")], "k int, v string")
    names = ["sum", "avg", "std", "median", "count", "min"]
    out = aggregate.aggregate(df, ["k"], [{"output": f, "function": f, "input": "v", "scale": 2} for f in names]).orderBy("k")
    assert [tuple(str(c) for c in r) for r in out.collect()] == [("1", "1.50", "1.500000", "None", "1.5", "2", "1.5"), ("2", "0.00", "None", "None", "None", "1", "y")]


def test_helpers_leave_user_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 6, "y")], "k int, place string, why int, code string")
    assert aggregate.unique_rows(df, ["k"], order_by=["place"])["unique"].collect() == [(1, "a", 5, "x")]
    assert rows.convert_type(df, {"place": "int"})["reject"].columns == [*df.columns, "error_code", "error_message"]
    assert extract.extract_delimited(df, "place", ["p"])["main"].columns == [*df.columns, "p"]


def test_python_rows_once(spark, tmp_path):
    log = tmp_path / "calls"

    def double(row):
        with open(log, "a") as f:
            f.write(f"{row['n']!r}\n")
        return {"m": row["n"] * 2}

    from flowloom.operators.code import python_rows

    flows = python_rows(spark.createDataFrame([(1,), (None,), (2**60,)], "n long").coalesce(1), double, "m long")
    assert rows_of(flows["main"]) == [(2,), (2**61,)] and flows["reject"].count() == 1 and flows["reject"].first()["n"] is None
    assert sorted(log.read_text().split()) == ["1", "1152921504606846976", "None"]
