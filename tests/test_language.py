import pytest

from sparkweave.plans.language import TransformError, execute, formula_tree, parse_transform

DOC = "doc int, vehicles array<struct<vin:string,coverages:array<struct<code:string>>>>, items array<struct<amount:int,sku:string>>, k string, x int"
ROW = (1, [("V1", [("A",), ("B",)]), ("V2", []), ("V3", [("C",)])], [(10, "p"), (20, "q"), (30, "r")], "A", 7)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([ROW], DOC)


def test_nested_loops_drop_empty_inner(docs):
    out = execute("{rows[]}\n:loop vehicles :as veh\n:loop .coverages :as cov\nvin = @veh.vin\ncode = \"@cov.code\"\n", docs, "doc")["rows"]
    assert [(r["vin"], r["code"]) for r in out.orderBy("_ord0", "_ord1").collect()] == [("V1", "A"), ("V1", "B"), ("V3", "C")]


def test_accumulators_run_and_persist(docs):
    t = "{$accumulator}\ntotal = ##0\ncount = ##0\n{_sink[]}\n:loop items\n_t = %accumulate total @.amount\n_c = %accumulate count ##1\n{Summary}\ntotal = @$accumulator.total\ncount = @$accumulator.count\n"
    r = execute(t, docs, "doc")["Summary"].first()
    assert (r["total"], r["count"]) == (60, 3)


def test_running_value_inside_a_loop(docs):
    t = "{$accumulator}\ntotal = ##0\n{lines[]}\n:loop items\nsku = @.sku\nso_far = %accumulate total @.amount\n"
    assert [r["so_far"] for r in execute(t, docs, "doc")["lines"].orderBy("_ord0").collect()] == [10, 30, 60]


def test_lookup_tables_and_defaults(docs, spark):
    t = '{$table.RATE[code, value]}\n"A", "hundred"\n"B", "two"\n{out}\nv = %lookup RATE.value @k\nw = %lookupDefault RATE.value "Z" "none"\n'
    r = execute(t, docs, "doc")["out"].first()
    assert (r["v"], r["w"]) == ("hundred", "none")
    big = spark.createDataFrame([("A", "one")], "code string, name string")
    assert execute("{out}\nv = %lookup N.name @k\n", docs, "doc", {"N": big})["out"].first()["v"] == "one"


def test_branches_take_the_first_that_holds(docs):
    t = '{a :if @x > ##10}\nv = "a"\n{b :elif @x > ##5}\nv = "b"\n{c :else}\nv = "c"\n'
    out = execute(t, docs, "doc")
    assert {n: d.count() for n, d in out.items()} == {"a": 0, "b": 1, "c": 0}
    with pytest.raises(TransformError):
        execute('{c :else}\nv = "c"\n', docs, "doc")


def test_directives_and_errors(docs):
    t = '{out}\na.b = @x :range 1..5\nc = @missing :required\nd = @missing :default "dd"\ne = @k :integer\nf = "${@k}-${@x}"\nh = @x :if @x > ##100\n'
    r = execute(t, docs, "doc")["out"].first()
    assert r["a"]["b"] == 7 and r["d"] == "dd" and r["e"] is None and r["f"] == "A-7" and r["h"] is None
    assert {(e["code"], e["field"]) for e in r["_errors"]} == {("T013", "a.b"), ("T005", "c"), ("T002", "e")}


def test_later_fields_read_earlier_ones(docs):
    r = execute("{out}\na = %add @x ##1\nb = %multiply @a ##2\n", docs, "doc")["out"].first()
    assert (r["a"], r["b"]) == (8.0, 16.0)


def test_loop_variables_and_counter(docs):
    out = execute("{o[]}\n:loop items\n:counter n\ni = @_index\nl = @_length\nn2 = @n\n", docs, "doc")["o"]
    assert [(r["i"], r["l"], r["n2"]) for r in out.orderBy("_ord0").collect()] == [(0, 3, 0), (1, 3, 1), (2, 3, 2)]


def test_passes_order_segments():
    t = parse_transform("{a}\n_pass = ##2\nx = ##1\n{b}\n_pass = ##1\nx = ##1\n{c}\nx = ##1\n")
    assert [s.number for s in t.segments] == [2, 1, 0]


def test_formulas():
    t = formula_tree("2 ^ 3 ^ 2 - -a * max(b, 1)", "v")
    assert t.value == "subtract" and t.args[0].value == "pow" and t.args[0].args[1].value == "pow"
    for bad in ("1 +", "foo(1)", "(1"):
        with pytest.raises(TransformError):
            formula_tree(bad, "v")


def test_unknown_verb(docs):
    with pytest.raises(TransformError) as e:
        execute("{o}\nx = %noSuchVerb @x\n", docs, "doc")
    assert e.value.code == "T001"


def test_text_directives_failures_and_lines(docs):
    from sparkweave.plans.language import failures, literal_lines

    out = execute('{out}\na = "ab,cd,ef" :field 1\nb = "abcdef" :pos 2 :len 3\nc = @missing :required\n', docs, "doc")
    r = out["out"].first()
    assert (r["a"], r["b"]) == ("cd", "cde")
    assert [(x["segment"], x["code"]) for x in failures(out).collect()] == [("out", "T005")]
    assert literal_lines(out["out"], "A:${a};${b}").first()[0] == "A:cd;cde"
    with pytest.raises(TransformError):
        literal_lines(out["out"], "${a${b}}")


def test_policies_of_validation_and_missing_values(docs):
    body = '{out}\na = @x :range 1..5\nb = @k :enum P,Q\nc = @gone\nd = @k :integer\n'
    r = execute(body, docs, "doc")["out"].first()
    assert {(e["code"], e["field"]) for e in r["_errors"]} == {("T013", "a"), ("T013", "b"), ("T002", "d")} and "_warnings" not in r.asDict()
    r = execute('{$target}\nonValidation = "warn"\nonMissing = "warn"\n' + body, docs, "doc")["out"].first()
    assert (r["a"], r["b"]) == (7, "A") and {(e["code"], e["field"]) for e in r["_warnings"]} == {("T013", "a"), ("T013", "b"), ("T005", "c")} and [e["field"] for e in r["_errors"]] == ["d"]
    r = execute('{$target}\nonValidation = "skip"\nonMissing = "fail"\nonError = "skip"\n' + body, docs, "doc")["out"].first()
    assert (r["a"], r["b"], r["d"]) == (None, None, None) and [(e["code"], e["field"]) for e in r["_errors"]] == [("T005", "c")]


def test_accumulators_start_anew_in_a_pass_unless_they_persist(docs):
    t = """{$accumulator}
t = ##0
p = ##0
p.persist = ?true
{_a[]}
_pass = ##1
:loop items
_1 = %accumulate t @.amount
_2 = %accumulate p @.amount
{first}
_pass = ##1
t = @$accumulator.t
p = @$accumulator.p
{_b[]}
_pass = ##2
:loop items
_2 = %accumulate p ##1
{second}
_pass = ##2
t = @$accumulator.t
p = @$accumulator.p
"""
    out = execute(t, docs, "doc")
    a, b = out["first"].first(), out["second"].first()
    assert (a["t"], a["p"]) == (60, 60) and (b["t"], b["p"]) == (0, 63)


def test_records_are_routed_by_type(spark):
    lines = spark.createDataFrame([(1, "H,7,x"), (2, "L,8,y"), (3, "M,9,z"), (4, "Q,1,w")], "doc int, line string")
    t = '{$source}\ndiscriminator = ":field 0"\n{heads[]}\n_type = "H"\nid = @line :field 1 :integer\n{lines[]}\n_type = "L, M"\nname = @line :field 2\n'
    out = execute(t, lines, "doc")
    assert [r["id"] for r in out["heads"].collect()] == [7] and sorted(r["name"] for r in out["lines"].collect()) == ["y", "z"]
    fixed = spark.createDataFrame([(1, "AB  one"), (2, "CD  two")], "doc int, line string")
    out = execute('{$source}\ndiscriminator = ":pos 0 :len 2"\n{a[]}\n_type = "AB"\nv = @line :pos 4 :len 3\n', fixed, "doc")
    assert [r["v"] for r in out["a"].collect()] == ["one"]


def test_objects_indices_and_appended_items(docs):
    t = '{out}\no = :object {k = @k, up = %upper "a, b", n = ##3}\nrows[1].a = @x\nrows[0].b = "z"\ntags[] = "p"\ntags[] = "q"\nlast = @x\n'
    r = execute(t, docs, "doc")["out"].first()
    assert r["o"].asDict() == {"k": "A", "up": "A, B", "n": 3} and r["tags"] == ["p", "q"] and r["last"] == 7
    assert [x.asDict() for x in r["rows"]] == [{"a": None, "b": "z"}, {"a": 7, "b": None}]


def test_types_of_directives(docs):
    t = '{out}\na = "10:30" :time\nb = "P1D" :duration\nc = "x.y" :reference\nd = "hi" :binary\ne = "9.5" :currency :decimals 3 :currencyCode "EUR"\nf = "oops" :currency\n'
    r = execute(t, docs, "doc")["out"].first()
    assert (r["a"], r["b"], r["c"], bytes(r["d"])) == ("10:30", "P1D", "x.y", b"hi") and (str(r["e"]["amount"]), r["e"]["code"]) == ("9.500", "EUR")
    assert r["f"] is None and [(e["code"], e["field"]) for e in r["_errors"]] == [("T002", "f")]
