import pytest

from sparkweave.plans import forms, schemas, targets
from sparkweave.plans.language import TransformError, execute
from sparkweave.plans.validate import parse_schema

TEXT = '{P}\nname = !\nage = ##:(0..150)\ncode = :/[A-Z]+/\nstatus = ("a", "b")\nmail = :format email\nphone = ! :if status = "a"\ntags = [] :(1..3) :unique\n:exactly_one name mail\n'


def test_serialised_schema_parses_to_the_same():
    s = parse_schema(TEXT)
    again = parse_schema(schemas.serialize(s))
    assert again.rules == s.rules and again.one_of == s.one_of


def test_problems_of_definitions():
    assert schemas.problems(parse_schema(TEXT)) == []
    bad = parse_schema("{P}\na = ##:(9..1)\na = \nb = :/[/\nc = :format nothing\n:of (1..1) a zz\n")
    assert {m for _, _, m in schemas.problems(bad)} == {"defined twice", "empty bounds", "malformed pattern", "unknown format nothing", "not defined"}


def test_flattening():
    texts = {"one": "{P}\na = ##\n{Q}\nz = \n", "two": "{P}\na = !\nb = \n"}
    with pytest.raises(ValueError):
        schemas.flatten(texts)
    assert [r.path for r in schemas.flatten(texts, "overwrite", {"P"}).rules] == ["P.a", "P.b"]
    assert "two.P.a" in [r.path for r in schemas.flatten(texts, "namespace").rules]


def test_forms():
    e = forms.parse_form('{heading t}\nvalue = "A & B"\n{text name}\nlabel = "Name"\nbind = "p.name"\n{checkbox ok}\n{select s}\nitems = "x,y"\n{table rows}\n')
    out = forms.render(e, {"p.name": "<Al>", "ok": "true", "s": "y", "rows[0].a": "1", "rows[1].a": "2"})
    assert "A &amp; B" in out and 'value="&lt;Al&gt;"' in out and "checked" in out and "<option selected>y" in out and out.count("<tr>") == 3
    with pytest.raises(ValueError):
        forms.parse_form("{widget x}\n")


def test_targets(spark, tmp_path):
    d = spark.createDataFrame([(1, [("a", 1), ("b", 2)])], "doc int, items array<struct<s:string,n:int>>")
    out = execute("{rows[]}\n:loop items\ns = @.s\nn = @.n\n", d, "doc")
    targets.write(out, "json", str(tmp_path / "j"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "j/rows")).collect()] == ['{"s":"a","n":1}', '{"s":"b","n":2}']
    assert [r[0] for r in targets.text_of(out["rows"], "fixed-width", columns=[("s", 0, 3, " ", "right"), ("n", 3, 2, "0", "left")]).collect()] == ["a  01", "b  02"]
    with pytest.raises(TransformError):
        targets.write(out, "fwf", str(tmp_path / "x"))
