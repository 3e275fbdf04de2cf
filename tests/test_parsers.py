from codeloom.parsers import edges, parse_file, parse_files, references, symbols
from codeloom.parsers.l5x import instructions, operand, role, terms


def got(path, text, record="edge"):
    rows = [r for r in parse_file(path, text) if r["record"] == record]
    return {(r["fqn"], r["target"], r["kind"]) for r in rows} if record == "edge" else {(r["fqn"], r["kind"]) for r in rows}


PY = "import os.path\nfrom .x import y as z\nclass A(B.C):\n  def go(self, q: int) -> str:\n    z.run()\n    return os.path.join(q)\n\ndef make():\n  def inner(): pass\n  return A()\n"


def test_python():
    assert got("a.py", PY, "symbol") == {("a.py::A", "class"), ("a.py::A.go", "method"), ("a.py::make", "function")}
    e = got("a.py", PY)
    assert ("a.py::A", "C", "EXTENDS") in e and ("a.py", ".x", "IMPORTS") in e and ("a.py::A", "a.py::A.go", "OWNS") in e
    calls = {r["target"]: r for r in parse_file("a.py", PY) if r.get("kind") == "CALLS"}
    assert calls["run"]["bound_module"] == ".x" and calls["join"]["bound_module"] == "os.path" and calls["run"]["member_call"]
    assert parse_file("a.py", "def (") == []


def test_overloads_and_wildcards():
    text = "from typing import overload\nfrom .. import *\n@overload\ndef f(x: int): ...\n@overload\ndef f(x: str): ...\ndef f(x): return x\n"
    assert len([r for r in parse_file("a.py", text) if r["record"] == "symbol"]) == 1
    assert ("a.py", "..", "IMPORTS") in got("a.py", text)


def test_scripts():
    text = "import {Foo as Bar} from './foo';\nexport class A extends B implements C {\n  #p(x: number): void { this.qq(x); Bar.zz(); }\n}\nconst hh = async (a) => { Bar(); };\nfunction kk(a) { return useContext(Ctx); }\n// class No {}\n"
    s = got("a.ts", text, "symbol")
    assert s == {("a.ts::A", "class"), ("a.ts::A.#p", "method"), ("a.ts::hh", "arrow_function"), ("a.ts::kk", "function")}
    e = got("a.ts", text)
    assert {("a.ts::A", "B", "EXTENDS"), ("a.ts::A", "C", "IMPLEMENTS"), ("a.ts::kk", "Ctx", "CONSUMES_CONTEXT"), ("a.ts", "./foo", "IMPORTS")} <= e


def test_csharp():
    text = "using System.Text;\nnamespace N.M {\n public partial class A<T> : B, IC {\n  private Store store;\n  public A(int x) { store.Save(x); }\n  public async Task<int> Go(string s, int t) { var w = new Widget(); w.Run(); return 1; }\n  public int P { get; set; }\n }\n}\n"
    assert got("a.cs", text, "symbol") == {("N.M.A", "partial_class"), ("N.M.A.A/1", "constructor"), ("N.M.A.Go/2", "method"), ("N.M.A.P", "property")}
    receivers = {r["target"]: r["receiver_type"] for r in parse_file("a.cs", text) if r.get("kind") == "CALLS"}
    assert receivers["Save"] == "Store" and receivers["Run"] == "Widget"


def test_cpp():
    text = "#include <vector>\nnamespace n {\nclass A : public B, private C<int> {\n public:\n  A(int x) : y(x) {}\n  ~A() {}\n  int go(const std::string & s, int* p) const { return store->save(s); }\n  Store* store;\n};\nvoid A::out(int q) { helper(q); }\n}\n"
    s = got("a.cpp", text, "symbol")
    assert {("n::A::A(int)", "constructor"), ("n::A::~A()", "destructor"), ("n::A::go(const std::string&,int*)", "method"), ("n::A::out(int)", "method")} <= s
    assert ("n::A", "C", "EXTENDS") in got("a.cpp", text)


RUNGS = '<R TargetType="Controller"><Controller><Tags><Tag Name="Valve" DataType="BOOL"/><Tag Name="Go" DataType="BOOL"/></Tags><Programs><Program Name="Main"><Routines><Routine Name="R" Type="RLL"><RLLContent><Rung Number="1"><Text>XIC(Go)OTE(Valve);</Text></Rung><Rung Number="3"><Text>JSR(S,0)OTE(Valve);</Text></Rung></RLLContent></Routine><Routine Name="S" Type="RLL"/></Routines></Program></Programs></Controller></R>'


def test_controller():
    rows = parse_file("c.L5X", RUNGS)
    assert [r for r in rows if r.get("kind") == "WRITES"] == [{"record": "edge", "path": "c.L5X", "fqn": "Main.R", "target": "Valve", "kind": "WRITES"}]
    assert [r["line"] for r in rows if r["record"] == "ref" and r["kind"] == "WRITE"] == [1, 3]
    assert ("Main.R", "Main.S", "CALLS") in got("c.L5X", RUNGS)
    assert parse_file("c.L5X", RUNGS.replace("Controller\"", "Routine\"", 1)) == []


def test_instruction_scan():
    assert list(instructions("MOVE(A[B,C],D)NOP()EQ(,x)")) == [("MOV", ["A[B,C]", "D"]), ("NOP", []), ("EQU", ["", "x"])]
    assert operand("Recipe[Row,Col.Idx].V") == ("Recipe", ["Row", "Col"]) and operand("Local:1:I.Data")[0] == "Local:1:I"
    assert terms("A + SIN(B) MOD C[D]") == ["A", "B", "C[D]"]
    assert [role("GSV", i, 3) for i in range(3)] == ["k", "k", "w"] and role("JSR", 5, 6) == "r" and role("NEW", 0, 1) == "r"


def test_table_function(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.py", "def ("), ("c.txt", "x"), ("d.py", None)], "path string, text string")
    rows = parse_files(files).cache()
    assert symbols(rows).count() == 3 and edges(rows).where("kind = 'CALLS'").count() == 2 and references(rows).count() >= 2


def test_audits(spark):
    from codeloom.operators import audits

    files = spark.createDataFrame([("c.L5X", RUNGS), ("bad.L5X", "<")], "path string, text string")
    rungs = audits.rungs(files).cache()
    rows = audits.operands(rungs).cache()
    assert rungs.count() == 2 and rows.count() == 5
    assert audits.role_audit(rows).where("contradiction").count() == 0
    tags = spark.createDataFrame([("Valve",)], "name string")
    assert {r.role: (r.n, r.resolved) for r in audits.resolution_audit(rows, tags).collect()} == {"r": (1, 0), "w": (2, 2)}
    assert audits.controller_profile(rungs).first().rungs == 2 and audits.survey(rows, "mnemonic").first().mnemonic == "JSR"
    need = spark.createDataFrame([("OTE", 3)], "name string, n_required int")
    assert audits.binding_check(rows, need).count() == 2
    assert audits.scrub(rows, "operand").select("operand").distinct().count() == rows.select("operand").distinct().count()
    assert [audits.look(x) for x in ("", "-1.5", "'a'", "a+b", "L:1:I.D", "a[1]", "a.b", "a")] == ["empty", "number", "string", "expression", "module", "indexed", "member", "name"]
