import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from wayfare import combinators as q
from wayfare import documents as d
from wayfare.catalog import Catalog
from wayfare.query import execute
from wayfare.sources import database, files, xml
from wayfare.streaming import windowed
from wayfare.syntax import QueryError


def test_csv_and_money(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,pay\n1,ann,"$1,000.10"\n2,bob,$10.05\n')
    db = Catalog(spark)
    files.attach_csv(db, "person", str(tmp_path / "a.csv"), "id int, name string, pay string", "id", money=("pay",))
    rows = execute(db, "person:select(name, pay, third => pay/3, twice => pay*2, rate => pay/(8*_usd), more => pay > 20*_usd)").collect()
    assert [tuple(map(str, r)) for r in rows] == [("ann", "1000.10", "333.37", "2000.20", "125.0125", "True"), ("bob", "10.05", "3.35", "20.10", "1.25625", "False")]
    assert str(execute(db, "sum(person.(pay/3))").first()[0]) == "336.72"  # each row is rounded
    assert str(execute(db, "mean(person.pay)").first()[0]) in ("505.07", "505.08")
    with pytest.raises(QueryError):
        execute(db, "person.(pay*pay)")


def test_json_documents(spark, tmp_path):
    doc = {"quays": [{"name": "north", "berths": [{"m": 40}, {"m": 65}]}, {"name": "mole", "berths": []}, {"name": None, "berths": [{"m": 12}]}], "spare": None}
    (tmp_path / "harbour.json").write_text(json.dumps(doc))
    harbour = files.read_json(spark, str(tmp_path / "harbour.json"))
    quays, name, berths, m = d.Fields("quays", "name", "berths", "m")
    unrow = lambda x: x.asDict(recursive=True) if hasattr(x, "asDict") else [unrow(y) for y in x] if isinstance(x, list) else x
    value = lambda c, **ctx: unrow(c(harbour, ctx).first()[0])
    assert value(d.Const("pier")) == "pier" and value(d.Count(quays)) == 3
    assert value(quays >> name) == ["north", "mole"]
    assert value(quays >> berths >> m) == [40, 65, 12]
    assert value(quays >> d.Select(name=name, berths=d.Count(berths))) == [{"name": "north", "berths": 2}, {"name": "mole", "berths": 0}, {"name": None, "berths": 1}]
    assert value(quays >> d.Filter(d.Count(berths) == 0) >> name) == ["mole"]
    assert value(d.Max(quays >> berths >> m)) == 65 and value(d.Min(quays >> d.Field("berths") >> m)) == 12
    assert value(d.First(quays >> name)) == "north" and value(d.First(quays >> name, 1)) == ["north"] and value(d.First(quays >> name, -1)) == ["north"]
    assert value(d.Given(quays >> berths >> d.Filter(m == d.Ref("long")), long=d.Max(quays >> berths >> m))) == [{"m": 65}]
    assert value(quays >> berths >> (m - d.Ref("k")), k=2) == [38, 63, 10]
    assert value(quays >> name >> d.Len(d.Here())) == [5, 4]
    assert value(d.Const(-9) // 4) == -3 and value(d.Const(-9) % 4) == 3 and value(d.Const(9) / 4) == 2.25
    assert value(d.Const("x") + "y") == "xy" and value(d.Const([3]) + d.Const([4])) == [3, 4] and value(d.Select(p=1) + d.Select(q=2)) == {"p": 1, "q": 2}
    assert value(d.Const(False) ^ d.Const(True)) is True and value(~d.Const(False)) is True and value(-d.Const(8)) == -8
    assert (d.Ref("u") + d.Given(d.Ref("v"), v=d.Ref("w"))).refs == {"u", "w"}
    # operators map over a list beside a single value, or alone
    long = quays >> berths >> m
    assert value(long > 20) == [True, True, False] and value(100 - long) == [60, 35, 88] and value(long * d.Ref("k"), k=2) == [80, 130, 24]
    assert value(-long) == [-40, -65, -12] and value(d.Len(quays >> name)) == [5, 4] and value((quays >> name) + "!") == ["north!", "mole!"]
    assert value(~(long > 20)) == [False, False, True] and value((long > 20) & True) == [True, True, False] and value(d.Max(long % 7)) == 5
    assert value(long == 65) == [False, True, False] and value(long + d.Const([1])) == [40, 65, 12, 1] and value(long > d.Const(None)) is None
    for wrong, error in ((d.Field("crane"), d.InputError), (d.Count(d.Const(4)), d.OperandError), (d.Const(2) + "b", d.OperandError), (d.Ref("y"), d.ContextError), (long - d.Const([1]), d.OperandError), (long + "b", d.OperandError), (d.Filter(long > 20), d.OperandError)):
        with pytest.raises(error):
            wrong(harbour)


def test_bound_values_are_worked_out_once(spark):
    """Not again for each item of a list, which takes time with the square of its length."""
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.struct(i.alias("m"))).alias("items"))
    items, m = d.Fields("items", "m")
    top, start = d.Max(items >> m), time.monotonic()
    assert d.Given(d.First(items >> d.Filter(m == d.Ref("top")) >> m), top=top)(long).first().value == 30_000
    assert d.Count((items >> m >= top) >> d.Filter(d.Here()))(long).first().value == 1
    assert d.Count((top <= (items >> m)) >> d.Filter(d.Here()))(long).first().value == 1
    assert time.monotonic() - start < 20


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<lib kind="x"><shelf n="1"><book lang="en">One <b>bold</b> tail</book><book>Two</book></shelf><shelf/></lib>')
    (tmp_path / "b.xml").write_text("<other/>")
    nodes = xml.open_xml(spark, str(tmp_path)).cache()
    texts = lambda df: [r.text for r in df.orderBy("doc", "node").collect()]
    assert [r.name for r in xml.root(nodes).orderBy("doc").collect()] == ["lib", "other"]
    lib = xml.root(nodes, "lib", kind="x")
    assert xml.root(nodes, "lib", kind=False).count() == 0 and xml.child(nodes, lib).count() == 2
    assert texts(xml.descendant(nodes, lib, "book")) == ["One bold tail", "Two"]
    assert texts(xml.descendant(nodes, lib, "book", lang=True)) == ["One bold tail"] and texts(xml.descendant(nodes, lib, "book", lang=False)) == ["Two"]
    assert [r.name for r in xml.parent(nodes, xml.matching(nodes, "b")).collect()] == ["book"]
    db = Catalog(spark)
    xml.attach_xml(db, "element", str(tmp_path), attributes=("lang",))
    rows = execute(db, 'element:filter(name == "shelf"):select(n => count(child), first => first(child).text, up => parent.name, langs => child.lang)').collect()
    assert sorted(map(tuple, rows), key=str) == [(0, None, "lib", []), (2, "One bold tail", "lib", ["en"])]


def test_xml_of_any_shape():
    """Against the library's tree; deeper than Python's own stack."""
    from xml.etree import ElementTree

    text = '<a xmlns="u" xmlns:x="v" k="1"><!-- no --><b x:l="2">p<c/>q<![CDATA[<r>]]></b>s<b>t</b></a>'
    tree = list(ElementTree.fromstring(text).iter())
    got = xml.elements(text.encode())
    assert [(r[4], dict(r[5]), r[6]) for r in got] == [(e.tag, e.attrib, "".join(e.itertext())) for e in tree]
    assert [(r[0], r[1], r[2], r[3], r[7]) for r in got] == [(1, None, 4, 0, []), (2, 1, 3, 1, [1]), (3, 2, 3, 2, [1, 2]), (4, 1, 4, 1, [1])]
    deep = xml.elements(b"<d>" * 3000 + b"x" + b"</d>" * 3000)
    assert len(deep) == 3000 and deep[-1][3] == 2999 and {r[6] for r in deep} == {"x"} and {r[2] for r in deep} == {3000}


def test_database_catalog(spark):
    cols = [("emp", "id", 1, "NO"), ("emp", "name", 2, "YES"), ("emp", "dept_id", 3, "NO"), ("emp", "boss_id", 4, "YES"), ("emp", "deputy_id", 5, "YES"), ("dept", "id", 1, "NO"), ("dept", "name", 2, "NO"), ("note", "t", 1, "YES")]
    keys = [("pk1", "PRIMARY KEY", "emp", "id", 1, None, None), ("uq", "UNIQUE", "dept", "id", 1, None, None), ("f1", "FOREIGN KEY", "emp", "dept_id", 1, 1, "uq"), ("f2", "FOREIGN KEY", "emp", "boss_id", 1, 1, "pk1"), ("f3", "FOREIGN KEY", "emp", "deputy_id", 1, 1, "pk1")]
    tables = database.described(cols, keys)
    assert tables["emp"].key == ("id",) and tables["dept"].key == ("id",) and tables["emp"].links == {"dept_id": ("dept", "id"), "boss_id": ("emp", "id"), "deputy_id": ("emp", "id")}
    data = {"emp": spark.createDataFrame([(1, "ann", 1, None, 2), (2, "bob", 1, 1, None), (3, "cid", 2, 1, None)], "id int, name string, dept_id int, boss_id int, deputy_id int"), "dept": spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")}
    read = []
    db = database.attach_tables(Catalog(spark), tables, lambda n: read.append(n) or data[n])
    assert not read and set(db.classes) == {"emp", "dept"}
    assert {"emp_via_boss", "emp_via_deputy", "boss", "deputy", "dept"} <= set(db["emp"].arrows) and "emp" in db["dept"].arrows and "dept_id" not in db["emp"].arrows
    assert sorted(map(tuple, execute(db, "dept:select(name, n => count(emp))").collect())) == [("x", 2), ("y", 1)]
    assert sorted(map(tuple, execute(db, "emp:select(name, boss => boss.name, n => count(emp_via_boss))").collect())) == [("ann", None, 2), ("bob", "ann", 0), ("cid", "ann", 0)]


def test_database_by_its_driver(spark, tmp_path):
    """A real database, embedded: its catalog is read, queries run on it, and conditions are pushed down to it."""
    url, driver = f"jdbc:derby:{tmp_path}/harbour;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    con = jvm.java.sql.DriverManager.getConnection(url)
    for sql in (
        'CREATE TABLE "quay" ("id" INT NOT NULL PRIMARY KEY, "name" VARCHAR(20) NOT NULL)',
        'CREATE TABLE "boat" ("id" BIGINT NOT NULL PRIMARY KEY, "name" VARCHAR(20), "quay_id" INT NOT NULL REFERENCES "quay", "tug_id" BIGINT REFERENCES "boat", "tons" INT)',
        'CREATE TABLE "crew" ("code" VARCHAR(9) NOT NULL UNIQUE, "boat_id" BIGINT REFERENCES "boat")',
        'CREATE TABLE "log" ("line" VARCHAR(20))',
        'CREATE VIEW "heavy" AS SELECT * FROM "boat" WHERE "tons" > 100',
        """INSERT INTO "quay" VALUES (1, 'north'), (2, 'mole')""",
        """INSERT INTO "boat" VALUES (1, 'tug', 1, NULL, 90), (2, 'barge', 1, 1, 300), (3, NULL, 2, 1, NULL)""",
        """INSERT INTO "crew" VALUES ('a', 1), ('b', 2), ('c', NULL)""",
    ):
        con.createStatement().execute(sql)
    con.close()
    db = database.attach_database(Catalog(spark), url, schema="APP", driver=driver)
    assert set(db.classes) == {"quay", "boat", "crew"}
    rows = lambda q: sorted(map(tuple, execute(db, q).collect()), key=str)
    assert rows("quay:select(name, n => count(boat), tons => sum(boat.tons))") == [("mole", 1, 0), ("north", 2, 390)]
    assert rows("boat:select(id, name, tug => tug.name, quay => quay.name, towed => count(boat))") == [(1, "tug", None, "north", 2), (2, "barge", "tug", "north", 0), (3, None, "tug", "mole", 0)]
    assert rows("crew:filter(boat.tons > 100):select(code, boat => boat.name)") == [("b", "barge")]
    plan = execute(db, "boat:filter(tons > 100).name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(tons,100)" in plan and "quay_id" not in plan


def test_flat_tables(spark):
    from wayfare.operators.output import html
    from wayfare.query import formatdf

    db = Catalog(spark)
    db.attach("quay", spark.createDataFrame([(1, "north"), (2, "mo<le")], "id int, name string"), "id", attributes={"name": "name"})
    db.attach("boat", spark.createDataFrame([(1, "tug", 1, None), (2, "barge", 1, 1)], "id int, name string, quay int, tug int"), "id", attributes={"name": "name"})
    db.link("boat", "quay", "quay", {"quay": "id"}, inverse="boat")
    db.link("boat", "tug", "boat", {"tug": "id"}, optional=True)
    flat = execute(db, "boat:select(id, quay, tug:select(a => id, b => 1)):dataframe")
    assert flat.columns == ["id", "name", "a", "b"] and sorted(map(tuple, flat.collect())) == [(1, "north", None, None), (2, "north", 1, 1)]
    nested = execute(db, "quay:dataframe(name, boat:select(id, quay, name))")
    assert nested.schema["boat"].dataType.elementType.names == ["id", "name", "name_3"]
    page = html(nested, 1)
    assert page.count("<table") == 2 and "&vellip;" in page and "north" in page and "mo&lt;le" in html(nested)
    formatdf(db)
    assert execute(db, "boat:select(id, quay)").columns == ["id", "name"]
    formatdf(db, False)
    assert execute(db, "boat:select(id, quay)").columns == ["id", "quay"]
    assert execute(db, "count(boat):dataframe").first()[0] == 2


def test_functions_of_many_values(spark):
    db = Catalog(spark)
    db.attach("item", spark.createDataFrame([(1, "a b", 2), (2, None, 3), (3, "c", None)], "id int, name string, n int"), "id", attributes={"name": "name", "n": "n"}, optional=("name", "n"))
    item, name, n = q.Fields("item", "name", "n")
    words = lambda x: F.split(x, " ")
    rows = lambda c: [tuple(r) for r in c.run(db).collect()]
    assert sorted(rows(q.LiftMany(words, "str", item >> name))) == [("a",), ("b",), ("c",)]
    times = lambda x, k: F.array_repeat(x, k.cast("int"))
    assert sorted(rows(q.LiftMany(times, "int", item >> n, q.Const([1, 2])))) == [(2,)] * 3 + [(3,)] * 3
    assert sorted(rows(item >> q.ThenSelect(q.Field("id"), ("k", q.Count(q.LiftMany(times, "int", q.Const([5, 6]), n)))))) == [(1, 4), (2, 6), (3, 0)]
    assert sorted(rows(q.Lift(lambda a, b: a + b, "int", item >> n, q.Const([10, 20])))) == [(12,), (13,), (22,), (23,)]
    from wayfare.compiler import RULES
    from wayfare.functions.scalars import SCALARS

    before = len(RULES), len(SCALARS)
    for _ in range(3):
        q.Aggregate(lambda x: F.max(x), "int", item >> n), q.Lift(lambda x: x, "int", n), q.LiftMany(words, "str", name)
    assert (len(RULES), len(SCALARS)) == before


def test_host_combinators(spark):
    db = Catalog(spark)
    db.attach("item", spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "a", 7)], "id int, name string, n int"), "id", attributes={"name": "name", "n": "n"}, optional=("n",))
    item, name, n = q.Fields("item", "name", "n")
    run = lambda c, **p: sorted((tuple(r) for r in c.run(db, **p).collect()), key=str)
    assert run(item >> name) == [("a",), ("a",), ("b",)]
    assert run(item >> q.ThenFilter((n + 1 > 5) & ~(name == "b")) >> q.ThenSelect(name, ("m", 10 - n))) == [("a", 3), ("a", 5)]
    assert run(item >> q.ThenGroup(name) >> q.ThenSelect(name, ("k", q.Count(item)), ("s", q.SumOf(item >> n)))) == [("a", 2, 12), ("b", 1, 0)]
    assert run(q.Record(("c", q.Count(item)), ("u", q.Count(q.Unique(item >> name))))) == [(3, 2)]
    assert run(q.Given(item >> q.ThenFilter(n == q.Field("TOP")) >> name, TOP=q.MaxOf(item >> n))) == [("a",)]
    assert run(item >> q.ThenSort(q.Desc(q.NullLast(n))) >> q.ThenTake(1) >> name) == [("a",)]
    assert run(item >> q.Define(k=n * 2) >> q.ThenFilter(q.Field("k") > q.Parameter("MIN")) >> q.ThenSelect(q.Field("k")), MIN=10) == [(14,)]
    assert run(item >> q.ThenSummarize(("m", q.MaxOf(item >> n)))) == [(7,)]
    assert run(item >> q.ThenSelect(("x", q.Lift(lambda a, b: F.concat(a, b.cast("string")), "str", name, n)))) == [("a5",), ("a7",), (None,)]
    assert run(item >> q.ThenSelect(name, ("c", q.Count(q.LiftMany(lambda a: F.split(a, ""), "str", name))), ("t", q.FieldIfExists("n")))) == [("a", 1, 5), ("a", 1, 7), ("b", 1, None)]
    assert run(item >> n >> q.ThenAggregate(lambda x: F.sum(x * x), "int", 0)) == [(74,)]
    assert run(q.Const([1, 2]) >> (q.It * 2)) == [(2,), (4,)] and run(q.Merge(item >> name, q.Const("z"))) == [("a",), ("a",), ("b",), ("z",)]
    assert run(item >> q.ThenSelect(("x", q.Switch(n > 6, "big", "small")), q.Decorate("y", n))) == [("big", 7), ("small", 5), (None, None)]


def test_streams_give_what_tables_give(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = spark.createDataFrame([(at(1), "a", 1.0), (at(7), "a", 2.0), (at(12), "b", 3.0), (at(59), "a", 4.0)], "ts timestamp, k string, v double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))  # one file each, so that the stream reads them in this order
    spark.createDataFrame([(datetime.datetime(2024, 1, 2), "z", 0.0)], rows.schema).coalesce(1).write.parquet(str(tmp_path / "in2"))
    make = lambda df: windowed(df, "ts", "10 minutes", ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")})
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = make(stream).writeStream.outputMode("append").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT * FROM windows_out").collect()}
    want = {tuple(r) for r in make(rows).collect()}
    assert got == want and len(want) == 3  # the last row only moves the watermark
