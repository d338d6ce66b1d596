import json

import pytest

from callweave.plans import indexing
from callweave.plans.store import Store
from callweave.tools import TOOLS, Workspace

SOURCE = "def main():\n    return step(1)\n\ndef step(x):\n    return deep(x)\n\ndef deep(x):\n    return x\n\ndef test_main():\n    assert main()\n\nclass A:\n    def twin(self):\n        pass\n\nclass B:\n    def twin(self):\n        pass\n"


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("ws")
    (top / "tree").mkdir()
    (top / "tree" / "m.py").write_text(SOURCE)
    tables = indexing.index(spark, {"svc": str(top / "tree")}, as_of=0)
    Store(spark, str(top / "store")).write(tables)
    return Workspace.open(spark, str(top / "store"))


def test_every_tool_answers(workspace):
    given = {"symbol": "step", "query": "step", "path": "m.py", "paths": ["m.py"], "source": "main", "target": "deep"}
    assert len(TOOLS) == 32
    for name, f in TOOLS.items():
        wanted = f.__code__.co_varnames[1 : f.__code__.co_argcount]
        got = json.loads(workspace.answer(name, **{k: given[k] for k in wanted if k in given}))
        assert got["tool"] == name and "status" not in got and len(got) > 1, name


def test_answers(workspace):
    rows = lambda *a, **k: json.loads(workspace.answer(*a, **k))["rows"]
    assert [r["name"] for r in rows("get_dependency_path", source="main", target="deep")] == ["main", "step", "deep"]
    blast = json.loads(workspace.answer("blast_radius", symbol="deep"))
    assert {r["name"] for r in blast["affected"]} == {"step", "main", "test_main"} and blast["summary"][0]["total"] == 3 and blast["summary"][0]["affected_files"] == "m.py"
    diff = json.loads(workspace.answer("diff_impact", paths=["m.py"]))
    assert {r["name"] for r in diff["affected_symbol_details"]} >= {"step", "main"} and diff["review_focus"][0]["path"] == "m.py" and "affected_tests" in diff
    assert json.loads(workspace.answer("get_boundaries"))["summary"][0]["boundary_violations"] == 0 and json.loads(workspace.answer("get_file_summary", path="m.py"))["symbols"]
    assert {r["name"] for r in rows("get_dependencies", symbol="main")} == {"step"}
    assert json.loads(workspace.answer("get_context", symbol="twin"))["status"] == "ambiguous"
    assert json.loads(workspace.answer("get_context", symbol="nothing"))["status"] == "not_found"
    assert rows("get_complexity")[0]["symbols"] == 8
