from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sparkweave.plans import documents as D
from sparkweave.plans.validate import parse_schema, validate
from sparkweave.sources import readers, writers
from sparkweave.sources.native import NativeError, parse_document, stringify

LONG = "doc string, path string, type string, value string"


def long(spark, rows):
    return spark.createDataFrame(rows, LONG)


def test_patch_of_diff_is_the_other(spark):
    a = long(spark, [("d", "x", "string", "1"), ("d", "y", "string", "2"), ("d", "z", "string", "3"), ("d", "n", "null", None)])
    b = long(spark, [("d", "x", "string", "9"), ("d", "w", "string", "2"), ("d", "n", "null", None), ("e", "q", "string", "2")])
    d = D.diff(a, b)
    assert {(r["op"], r["path"]) for r in d.collect()} == {("changed", "x"), ("moved", "w"), ("removed", "z"), ("added", "q")}
    assert sorted(map(tuple, D.patch(a, d).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert D.missing(a, d).count() == 0


def test_overlay_deletes_below(spark):
    c = spark.createDataFrame([("d", 1, "a.b", "string", "1"), ("d", 1, "t[0]", "string", "x"), ("d", 1, "t[1]", "string", "y"), ("d", 2, "a", "null", None), ("d", 2, "t[]", "null", None), ("d", 3, "t[0]", "string", "z"), ("d", 3, "ab", "string", "k")], "doc string, seq int, path string, type string, value string")
    assert {(r["path"], r["value"]) for r in D.overlay(c).collect()} == {("t[0]", "z"), ("ab", "k")}


def test_references(spark):
    r = long(spark, [("d", "a", "reference", "b"), ("d", "b", "reference", "c"), ("d", "c", "string", "v"), ("d", "p", "reference", "q"), ("d", "q", "reference", "p")])
    got = {x["path"]: (x["value"], x["cycle"]) for x in D.resolve(r).collect()}
    assert got["a"] == ("v", False) and got["p"][1] and got["q"][1]


def test_validation_codes(spark):
    s = parse_schema('{Person}\nname = !\nage = ##:(0..150)\nemail = :format email\nstatus = ("active", "closed")\nphone = ! :if status = "active"\ntags = [] :(1..2)\n')
    rows = [("d", "Person.age", "integer", "200"), ("d", "Person.email", "string", "x"), ("d", "Person.status", "string", "active"), *[("d", f"Person.tags[{i}]", "string", "t") for i in range(3)], ("d", "Person.z", "string", "?"), ("d", "Person.r", "reference", "no.where")]
    got = {(r["path"], r["code"]) for r in validate(long(spark, rows), s, strict=True).collect()}
    assert got == {("Person.name", "V001"), ("Person.age", "V003"), ("Person.email", "V004"), ("Person.phone", "V010"), ("Person.tags", "V006"), ("Person.z", "V011"), ("Person.r", "V011"), ("Person.r", "V013")}


TEXT = st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00\r\x0b\x0c\x1c\x1d\x1e\x85  "), max_size=20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "S.b", "S.c", "T.d"]), TEXT), max_size=6))
def test_native_round_trip(pairs):
    rows = [(p, "string", v, "") for p, v in dict(pairs).items()]
    assert parse_document(stringify(rows)) == rows


def test_native_literals():
    d = dict((p, (t, v)) for p, t, v, _ in parse_document('a = ##42\nb = #3.14\nc = #$99.99:USD\nd = #%50\ne = 2024-01-15\nf = T14:30:00\ng = P1Y2M3D\nh = @o\ni = ~\nj = true\nk = *"s" ; note\n'))
    assert d["a"] == ("integer", "42") and d["c"] == ("currency", "99.99:USD") and d["e"][0] == "date" and d["g"][0] == "duration" and d["h"] == ("reference", "o") and d["i"] == ("null", None) and d["k"] == ("string", "s")
    try:
        parse_document("x = bare")
        raise AssertionError
    except NativeError as e:
        assert e.code == "P002"


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert [tuple(r) for r in readers.read_csv(spark, put("a.csv", 'Name,Age,Note\nAlice,30,"She said ""hi"""\nBob,25,x\n')).collect()] == [("Alice", 30, 'She said "hi"'), ("Bob", 25, "x")]
    assert readers.read_fixed_width(spark, put("a.txt", "Alice     00100\n"), "Name:0:10;Amount:10:5").first() == ("Alice", "00100")
    assert readers.read_flat(spark, put("a.properties", "a.b=1\n# c\nn=~\n"), "a struct<b:int>, n string").first()["a"]["b"] == 1
    y = readers.read_yaml(spark, put("a.yaml", "person:\n  name: Alice\n  age: 30\nok: yes\n"), "person struct<name:string,age:int>, ok boolean").first()
    assert (y["person"]["name"], y["person"]["age"], y["ok"]) == ("Alice", 30, True)
    assert readers.read_json(spark, put("a.json", '{"a": [1, 2]}')).first()["a"] == [1, 2]
    x = readers.read_xml(spark, put("a.xml", '<root><person id="1">Al</person><person id="2">Bo</person></root>'), "person").orderBy("@id").collect()
    assert [(r["@id"], r["_text"]) for r in x] == [(1, "Al"), (2, "Bo")]
    m = readers.read_multi_record(spark, put("m.txt", "H,1\nD,2\nD,3\n"), field=0)
    assert {r["record_type"]: r["count"] for r in m.groupBy("record_type").count().collect()} == {"H": 1, "D": 2}
    n = readers.read_native(spark, put("a.native", '{A}\nx = ##1\ny = "b"\n'))
    assert [(r["path"], r["value"]) for r in n.orderBy("ord").collect()] == [("A.x", "1"), ("A.y", "b")]
    assert writers.native_text(n).first()["value"] == '{A}\nx = ##1\ny = "b"\n'
    assert len(writers.canonical_hash(n).first()["hash"]) == 64


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("AB", "WIDGET", 5.0)], "code string, name string, n double")
    assert writers.fixed_width_text(d, [("code", 0, 5, " ", "right"), ("name", 5, 8, " ", "right")], 20, ".").first()[0] == "AB   WIDGET  ......."
    assert writers.json_text(d).first()[0] == '{"code":"AB","name":"WIDGET","n":5}'
    assert writers.csv_text(d).first()[0] == "AB,WIDGET,5.0" and writers.flat_text(d).first()[0] == "code=AB\nn=5\nname=WIDGET"
    writers.write_csv(d, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).first() == ("AB", "WIDGET", 5.0)


def test_invariants(spark):
    from sparkweave.plans.invariants import check_invariants

    rows = [("ok", "a", "integer", "3"), ("ok", "b", "number", "1.5"), ("bad", "a", "integer", "1"), ("bad", "b", "number", "1.5"), ("absent", "a", "integer", "1"), ("void", "a", "null", None), ("void", "b", "number", "1")]
    got = {(r["doc"], r["path"]) for r in check_invariants(long(spark, rows), ["a >= b * 2", "!(a < 0) && (b = 1.5 || b = 1)"]).collect()}
    assert got == {("bad", "a >= b * 2"), ("void", "a >= b * 2"), ("void", "!(a < 0) && (b = 1.5 || b = 1)")}


def test_imports(tmp_path):
    import pytest

    from sparkweave.plans.imports import ImportProblem, resolve

    def put(n, t):
        (tmp_path / n).write_text(t)
        return tmp_path / n

    put("c.txt", "c = ##1\n")
    put("b.txt", "@import ./c.txt\nb = ##1\n")
    a = put("a.txt", '@import "./b.txt"\n@import ./c.txt\na = ##1\n')
    assert [x for x in resolve(a, tmp_path).splitlines() if x] == ["c = ##1", "b = ##1", "a = ##1"]
    put("x.txt", "@import ./y.txt")
    put("y.txt", "@import ./x.txt")
    for name, text, code in (("m.txt", "@import ./none.txt", "I001"), ("o.txt", "@import ../../etc.txt", "I002"), ("e.txt", "@import ./q.py", "I003"), ("z.txt", "@import ./x.txt", "I004")):
        with pytest.raises(ImportProblem) as e:
            resolve(put(name, text), tmp_path)
        assert e.value.code == code


def test_exports(spark):
    from sparkweave.plans.exports import Builder, to_json

    d = Builder("d").set("a.b[0]", 1).set("a.b[1]", 2.5).set("c", True).set("n", None).set("gone", "x").without("gone").frame(spark)
    assert to_json(d).first()["value"] == '{"a": {"b": [1, 2.5]}, "c": true, "n": null}'


def test_text_exports(spark):
    from sparkweave.plans.exports import to_csv, to_fixed_width, to_xml

    rows = [("d", 0, "$.id", "string", "m", ""), ("d", 1, "a b", "string", "x<y", "required"), ("d", 2, "r[1].q", "number", "2.50", ""), ("d", 3, "r[0].p", "string", 'say "hi"', ""), ("d", 4, "r[0].q", "null", None, ""), ("d", 5, "s.1", "currency", "3.10:EUR", "confidential deprecated"), ("d", 6, "s.t", "reference", "r", "")]
    rows += [("e", 0, "p", "boolean", "true", ""), ("e", 1, "q", "percent", "4.0", ""), ("m", 0, "$.id", "string", "only", "")]
    d = spark.createDataFrame(rows, "doc string, ord bigint, path string, type string, value string, modifiers string").repartition(3)
    of = lambda df: {r["doc"]: r["value"] for r in df.collect()}
    assert of(to_csv(d)) == {"d": 'p,q\n"say ""hi""",\n,2.5\n', "e": "p,q\ntrue,4\n", "m": ""}
    assert of(to_csv(d, ";", False, "none"))["d"] == "x<y;3.1;@r\n"
    assert of(to_xml(d, modifiers=True)) == {
        "d": '<?xml version="1.0" encoding="UTF-8"?>\n<root xmlns:doc="urn:document">\n  <a_b doc:required="true">x&lt;y</a_b>\n  <r_1_>\n    <q doc:type="number">2.50</q>\n  </r_1_>\n  <r_0_>\n    <p>say &quot;hi&quot;</p>\n  </r_0_>\n  <s>\n    <_1 doc:type="currency" doc:currencyCode="EUR" doc:confidential="true" doc:deprecated="true">3.10</_1>\n    <t doc:type="reference">@r</t>\n  </s>\n</root>\n'.replace("r_1_>", "r[1]>").replace("r_0_>", "r[0]>"),
        "e": '<?xml version="1.0" encoding="UTF-8"?>\n<root xmlns:doc="urn:document">\n  <p doc:type="boolean">true</p>\n  <q doc:type="percent">4.0</q>\n</root>\n',
        "m": '<?xml version="1.0" encoding="UTF-8"?>\n<root xmlns:doc="urn:document">\n</root>\n',
    }
    assert of(to_fixed_width(d, [("q", 2, 3, "0", "left"), ("a b", 5, 2, " ", "right")], 6)) == {"d": "  000x", "e": "  004 ", "m": "  000 "}


def test_cycles_of_any_length(spark):
    rows = [("d", f"c{n}_{k}", "reference", f"c{n}_{(k + 1) % n}") for n in (1, 2, 3, 5, 6, 11) for k in range(n)]
    rows += [("d", f"t{k}", "reference", f"t{k + 1}") for k in range(70)] + [("d", "t70", "string", "end"), ("e", "x", "reference", "y"), ("e", "y", "string", "v")]
    got = {(r["doc"], r["path"]) for r in validate(long(spark, rows), parse_schema("")).filter("code = 'V012'").collect()}
    assert got == {("d", r[1]) for r in rows if r[1].startswith("c")}
    ends = {r["path"]: (r["value"], r["cycle"]) for r in D.resolve(long(spark, rows)).collect()}
    assert ends["t0"] == ("end", False) and ends["x"] == ("v", False) and ends["c5_2"] == (None, True)


def test_formats(spark):
    from sparkweave.plans.formats import meets

    good = {
        "email": ["a@b.c", ""], "url": ["http://x", "https://"], "uri": ["mailto:a", "x+y:"], "uuid": ["123e4567-e89b-12d3-a456-426614174000"], "hostname": ["a-b.c"], "date-time": ["2024-01-15T10:00:00Z"], "ipv4": ["0.10.255.1"],
        "ipv6": ["::", "1::2", "1:2:3:4:5:6:7:8", "::1"], "phone": ["+1 (555) 123-4567"], "zip": ["12345", "12345-6789"], "date-iso": ["2024-01-15"], "naic": ["12345"], "fein": ["12-3456789"], "vin": ["1hgcm82633a004352"], "currency-code": ["USD"],
        "country-alpha2": ["DE"], "country-alpha3": ["DEU"], "state-us": ["TX"], "credit-card": ["4111 1111 1111 1111"], "ssn": ["123-45-6789", "123456789"], "iban": ["DE89370400440532013000"], "swift": ["DEUTDEFF", "DEUTDEFF500"], "routing": ["123456789"],
        "cusip": ["037833100"], "isin": ["US0378331005"], "lei": ["A" * 20], "npi": ["1234567890"], "dea": ["AB1234567"], "imei": ["1" * 15], "iccid": ["1" * 19], "no-such": ["anything"],
    }
    bad = {
        "email": ["a@b", "@b.c", "a@@b.c", "a@.c"], "url": ["ftp://x"], "uri": ["1x:"], "uuid": ["123e4567"], "hostname": ["-a"], "datetime": ["2024-01-15"], "ipv4": ["256.1.1.1", "01.1.1.1", "1.1.1"], "ipv6": ["1::2::3", "1:2", ":::", "12345::"], "phone": ["123456", "1234567x"], "zip": ["1234"],
        "date-iso": ["", "15.01.2024"], "naic": ["1234"], "fein": ["123456789"], "vin": ["IOQ00000000000000"], "currency-code": ["usd", "ZZZ"], "country-alpha2": ["XX", ""], "state-us": ["ZZ"], "creditcard": ["4111111111111112", "411"], "ssn": ["000-12-3456", "12-345-6789"], "iban": ["D1"], "bic": ["DEUT"], "routing": ["1"], "imei": ["1" * 14],
    }
    for want, cases in ((True, good), (False, bad)):
        for name, values in cases.items():
            d = spark.createDataFrame([(x,) for x in values], "v string").select("v", meets(F.col("v"), name).alias("ok"))
            assert [r["v"] for r in d.collect() if r["ok"] != want] == [], name


def test_decimal_places_and_bounds_of_moments(spark):
    s = parse_schema("{}\na = #.2\nb = #$.2\nc = date:(2024-01-01..2024-12-31)\nd = ^:(2..4)\ne = timestamp:(..2024-06-01T00:00:00)\n")
    ok = [("g", "a", "number", "1.25"), ("g", "b", "currency", "9.99:USD"), ("g", "c", "date", "2024-12-31"), ("g", "d", "binary", "SGVs"), ("g", "e", "timestamp", "2024-05-01T00:00:00")]
    no = [("h", "a", "number", "1.2"), ("h", "b", "currency", "9:USD"), ("h", "c", "date", "2025-01-01"), ("h", "d", "binary", "SGVsbG8="), ("h", "e", "timestamp", "2024-07-01T00:00:00")]
    got = {(r["doc"], r["path"], r["code"]) for r in validate(long(spark, ok + no), s).collect()}
    assert got == {("h", p, "V003") for p in "abcde"}


def test_malformed_documents_are_error_rows(spark, tmp_path):
    d = spark.createDataFrame([("a", "x = ##1"), ("b", "x = bare"), ("c", None)], "doc string, text string")
    rows = {(r["doc"], r["type"], r["modifiers"]) for r in readers.parse_native(d, "doc", "text").collect()}
    assert rows == {("a", "integer", ""), ("b", "error", "P002")}
    broken = readers.parse_texts(spark.createDataFrame([("a", "1"), ("b", "2")], "doc string, value string"), lambda t: 1 // (int(t) - 1)).collect()
    assert [r["json"] for r in broken] == [None, "1"] and "ZeroDivisionError" in broken[0]["_error"]


def test_json_numbers_inside_texts_stay(spark):
    d = spark.createDataFrame([("ratio 3:1.0, ok", 2.0, 2.5, [1.0, 0.1], {"k": 3.0}, float("nan"), None)], "s string, a double, b double, c array<double>, m map<string,double>, n double, z double")
    assert writers.json_text(d).first()["value"] == '{"s":"ratio 3:1.0, ok","a":2,"b":2.5,"c":[1,0.1],"m":{"k":3},"n":null,"z":null}'
