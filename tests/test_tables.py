"""Sources, writes, inference, catalog, streaming, and the registered queries against DuckDB."""

import glob
import gzip
import json
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from querylark import infer, queries
from querylark.functions import values
from querylark.operators import retention, writes
from querylark.operators.catalog import Catalog, from_json, to_json
from querylark.query import dates, ip
from querylark.schema import Field, Ghost, Schema, SchemaError
from querylark.sources import files
from querylark.streaming import ingest

SF = "/root/testdata/sf0.001"


def column(spark, cells, fn):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r["v"] for r in df.select("i", fn(F.col("c")).alias("v")).orderBy("i").collect()]


def test_dates_of_cells_are_those_of_literals(spark):
    cells = "2024-06-15T12:00:00Z|2024-06-15T14:00:00.5+02:00|Sat, 15 Jun 2024 12:00:00 +0000|2024-06-15 12:00:00|2024/06/15 12:00|2024.6.15|06/15/2024 12:00|15.06.2024 12:00:00|20240615|20240615120000|202406151200|1718452800|2024-06|2024|June 15, 2024|15 Jun 2024|Jun 15 2024|9999-01-01|15/03/2024|03.15.2024|24-01-01|2024-13-01|soon|".split("|")
    got = column(spark, [*cells, None], lambda c: F.unix_timestamp(values.parse_date(c)))
    assert got == [*map(dates.parse, cells), None]
    assert column(spark, ["15/03/2024", "03.15.2024"], lambda c: F.unix_timestamp(values.parse_date(c, values.DAY_FIRST, values.MONTH_FIRST))) == [dates.parse("2024-03-15")] * 2


def test_addresses_of_cells_are_those_of_literals(spark):
    cells = "10.1.2.3|::1|2001:db8::1|::ffff:10.1.2.4|::|1:2:3:4:5:6:7:8|fe80::1:0:0:1|256.1.1.1|1.2.3|1::2::3|12345::|g::|1:2:3|:1:2:3:4:5:6:7|01.2.3.4|".split("|")
    assert column(spark, [*cells, None], values.ip_key) == [*map(ip.key, cells), None]


def test_shapes(spark):
    cells = {"": "empty", " ": "empty", "n/a": "missing", "-": "missing", "TRUE": "boolean", "y": "yes/no", "-12": "integer", "007": "leading-zero number", "1234567890123456": "long number", "1.5": "decimal", ".5": "decimal", "8023954622E7": "exponent number", "2024-01-02": "date", "15/03/2024": "date", "1.2.3.4": "ip", "::1": "ip", "['a', 'b']": "list", "[1, 2]": "list", "[]": "list", "[draft]": "text", '{"a": 1}': "object", "hello": "text", "1e999": "text"}
    assert column(spark, list(cells), values.shape) == list(cells.values())


def test_lists_cells_and_bytes(spark):
    assert column(spark, ["['a', 'it''s']", "['a', \"b c\"]", '["x","y"]', "[1, 2]", "[]", "[None, True]", "[draft]", "x"], values.parse_list)[1:] == [["a", "b c"], ["x", "y"], ["1", "2"], [], [None, "true"], None, None]
    assert column(spark, ["12", "x", " 7 ", "na", ""], lambda c: values.typed(c, "i64")) == [12, None, 7, None, None]
    assert column(spark, ["Yes", "0", "maybe"], values.boolean_word) == [True, False, None]
    df = spark.sql("select bytes_ from values (array(1, 255)), (array(1, 256)), (null) as t(bytes_)")
    assert [r[0] and bytes(r[0]) for r in df.select(values.bytes_of("bytes_")).collect()] == [b"\x01\xff", None, None]


def test_sources(spark, tmp_path):
    csv = "id;price.f64;name\n1;2.5;a\n2;x;b c\n"
    (tmp_path / "a.csv").write_text(csv)
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write(csv)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", csv)
    for name in ("a.csv", "a.csv.gz", "a.zip"):
        df, types = files.read(spark, str(tmp_path / name))
        assert types == {"price": "f64"} and [tuple(r) for r in df.orderBy("id").collect()] == [("1", "2.5", "a"), ("2", "x", "b c")], name
    assert files.sniff_delimiter("a;b,c\n") == ";" and files.sniff_delimiter("a\tb,c") == "\t" and files.sniff_delimiter("a,b") == ","
    assert [files.detect_format(t) for t in ("[{}]", '{"a":1}\n{"a":2}', '{"fields": []}', '{"a": 1}', "a,b")] == ["array", "jsonl", "schema", "document", "csv"]
    (tmp_path / "d.json").write_text('[{"doc": {"a": 1}}, {"doc": {"a": 2}}]')
    assert sorted(r["a"] for r in files.read(spark, str(tmp_path / "d.json"))[0].collect()) == [1, 2]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n[1]\n{"a": 3}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "l.jsonl"))
    assert sorted(r["a"] for r in good.collect()) == [1, 3] and sorted(r["text"] for r in bad.collect()) == ["[1]", "not json"]


def test_writes(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    batch = spark.createDataFrame([("b", 20, 1), ("c", 30, 2), ("b", 21, 3)], "id string, n int, o int")
    assert sorted((r["id"], r["n"]) for r in writes.put(table, batch.drop("o"), order=None).collect() if r["id"] != "b") == [("a", 1), ("c", 30)]
    assert {r["id"]: r["n"] for r in writes.put(table, batch, order=F.col("o").cast("long")).collect()} == {"a": 1, "b": 21, "c": 30}
    schema = Schema((Field("id", "string"), Field("n", "i64"), Field("when", "date"), Field("src", "ip")))
    cells = spark.createDataFrame([("1", "5", "2024-01-01", "1.2.3.4"), ("2", "x", None, None), (None, "1", None, None), ("4", "", "soon", None), ("5", "na", None, "::1")], "id string, n string, when string, src string")
    good, bad = writes.typed(cells, schema)
    assert sorted(r["id"] for r in good.collect()) == ["1", "5"]
    said = writes.errors(bad)
    assert said["more"] == 0 and len(said["errors"]) == 3 and any("'x' is no i64" in e for e in said["errors"])
    composed = writes.compose_id(spark.createDataFrame([("a", "b"), ("a", None), ("", "c")], "x string, y string"), ["x", "y"])
    assert [r["id"] for r in composed.collect()] == ["a|b", None, None]
    assert [tuple(r) for r in writes.ledger(spark.createDataFrame([("a",), ("a",), ("b",)], "id string")).collect()] == [("a", 2)]


def test_inference(spark):
    n = 40
    rows = [(str(i), f"00{i}", ["red", "blue"][i % 2], f"{i}.5", "2024-01-0" + str(1 + i % 9), "yes" if i % 2 else "true", f"10.0.0.{i}", f"['t{i}']", f"x{i}-{i}", f"some words {i}", None, str(10**18 + i * 10**18 // 2), "NA" if i % 3 else "3") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, code string, color string, price string, day string, flag string, src string, tags string, mac string, note string, none string, big string, gaps string")
    found = {p.name: infer.decide(p) for p in infer.profile(df)}
    assert {k: (f.type, f.many) for k, f in found.items()} == {
        "id": ("i64", False), "code": ("text", False), "color": ("string", False), "price": ("f64", False), "day": ("date", False), "flag": ("boolean", False), "src": ("ip", False), "tags": ("text", True),
        "mac": ("text", False), "note": ("text", False), "none": ("text", False), "big": ("f64", False) if 10**18 + 39 * 10**18 // 2 >= 1 << 64 else ("u64", False), "gaps": ("i64", False),
    }
    assert found["mac"].tokenizer == "raw" and found["note"].tokenizer == "default"
    profiles = infer.profile(df)
    assert infer.choose_id(profiles) == ["id"] and "color: string" in infer.report(profiles)
    pair = spark.createDataFrame([(str(i // 5), str(i % 5)) for i in range(25)], "a string, b string")
    assert infer.choose_id(infer.profile(pair), pair) == ["a", "b"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    s = Schema((Field("id", "string"), Field("t", "text"), Field("g", "text", ghost=Ghost("t", "id", within=("a",)))), ("t",))
    assert from_json(to_json(s)) == s and c.names() == []
    c.put_schema("one", s)
    c.write("one", spark.createDataFrame([("a", "some text")], "id string, t string"))
    assert c.open("one").search("some").total_hits == 1
    with pytest.raises(SchemaError):
        c.put_schema("one", Schema((Field("id", "string"), Field("t", "string"))))
    with pytest.raises(SchemaError):
        c.rebuild("one", s)
    assert c.patch_schema("one", indexed={"t": False}).version == 2
    row = c.listing().first()
    assert (row["name"], row["documents"], row["fields"]) == ("one", 1, 3) and c.totals().first()["documents"] == 1
    c.drop("one", keep_schema=True)
    assert c.names() == ["one"] and not c.has_rows("one")
    c.drop("one")
    assert c.names() == []


def test_streaming_ingest(spark, tmp_path):
    src, log, bad, ck = (f"{tmp_path}/{n}" for n in ("src", "log", "bad", "ck"))
    os.mkdir(src)
    schema = Schema((Field("id", "string"), Field("n", "i64")))

    def feed(name, rows):
        with open(f"{src}/{name}", "w") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
        ingest.start(spark, src, log, bad, ck, schema, once=True).awaitTermination()

    feed("1.ndjson", [{"id": "a", "n": 1}, {"id": "b", "n": 2}, "not json", {"n": 5}])
    feed("2.ndjson", [{"id": "a", "n": 10}, {"id": "c", "n": 3}])
    assert {r["id"]: r["n"] for r in ingest.snapshot(spark, log).collect()} == {"a": 10, "b": 2, "c": 3}
    assert spark.read.text(bad).count() == 2


def test_of_files_of_one_time_the_later_wins(spark, tmp_path):
    src, log, bad, ck = (f"{tmp_path}/{n}" for n in ("src", "log", "bad", "ck"))
    os.mkdir(src)
    for name, n, more in (("1.ndjson", 1, 0), ("2.ndjson", 2, 5000)):
        with open(f"{src}/{name}", "w") as f:
            f.write("".join(json.dumps({"id": i, "n": n}) + "\n" for i in ["a", *map(str, range(more))]))
        os.utime(f"{src}/{name}", (1_700_000_000, 1_700_000_000))
    ingest.start(spark, src, log, bad, ck, Schema((Field("id", "string"), Field("n", "i64"))), once=True).awaitTermination()
    got = ingest.snapshot(spark, log)
    assert got.count() == 5001 and got.filter("id = 'a'").first()["n"] == 2


def test_retention(spark):
    df = spark.sql("select id, cast(d as timestamp) d from values (1, '2024-01-01'), (2, '2025-01-01'), (3, null) t(id, d)")
    assert [r["id"] for r in retention.prune(df, "d", "2024-06-01").orderBy("id").collect()] == [2, 3]
    assert retention.profile(df, "d", "2024-06-01").first()["before"] == 1 and retention.expired(df, "d", "2024-06-01").count() == 1


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(df, relation):
    def norm(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return [cols[i] for i in order], sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)

    return norm([tuple(r) for r in df.collect()], df.columns) == norm(relation.fetchall(), relation.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_query_matches_its_sql(spark, duck, name):
    assert same(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["event_id", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    plan = queries.QUERIES["topk_sort"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(event_type,click)" in plan and "Exchange" not in plan
