import pytest
from loomstone.runtime import table
from loomstone.operators.shape import Budget
from loomstone.tools import Index, ToolError


@pytest.fixture(scope="module")
def index(spark):
    return Index.of_tables(**{n: table(spark, "/root/testdata/sf0.001", n) for n in ("symbols", "edges", "usages", "text_units", "files", "source_files", "skim_decls")})


def test_tools(index):
    assert index.call("search_java_symbols", {"query": "run", "limit": 3}).startswith("Showing 3 of")
    assert "No symbols match" in index.call("search_java_symbols", {"query": "nosuchname"})
    shown = index.call("find_java_definition", {"symbol": "run"})
    assert "run(" in shown and ".java:" in shown
    assert "Total refs:" in index.call("find_java_references", {"symbol": "run"})
    path, line = shown.split("\n")[0].split("  ")[0].rsplit(":", 1)
    assert path in index.call("find_java_definition", {"file": path, "line": int(line), "col": 1})
    e = index.tables["edges"].where("type = 'EXTENDS' AND src NOT LIKE '~%' AND src <> dst").first()
    typed = e["src"].replace("/", ".").replace("#", ".").strip(".")
    assert "depth 1" in index.call("find_java_supertypes", {"symbol": typed})
    assert index.call("find_java_subtypes", {"symbol": typed})
    assert "matches across" in index.call("grep_java", {"query": "the file"}) and "(0 symbols" in index.call("grep_java", {"query": "zq+x", "output": "count"})
    assert "{" in index.call("skim_java", {"path": path})
    assert index.call("health").startswith("ok")
    assert len(index.calls) == 11 and all(c["ok"] for c in index.calls)


@pytest.mark.parametrize("tool,args", [
    ("find_java_references", {}), ("find_java_definition", {"symbol": "run", "line": 3}), ("find_java_definition", {"symbol": "nosuchname"}), ("grep_java", {"query": "a("}), ("grep_java", {"query": "a", "output": "x"}),
    ("grep_java", {"query": "a", "match_in": "x"}), ("search_java_symbols", {"query": "a", "kind": "THING"}), ("skim_java", {"path": "no.java"}), ("nothing", {}), ("health", {"x": 1})])
def test_errors(index, tool, args):
    with pytest.raises(ToolError):
        index.call(tool, args)


def test_references_are_never_cut(spark):
    """More than 1,000 unconfirmed uses and more than 2,000 files: counts and files stay whole on every rung."""
    m = "app/Box#get()."
    symbols = spark.createDataFrame([(m, "METHOD", 0, "app/Box#", 0, (3, 1, 3, 9), "get", None)], "moniker string, kind string, flags int, enclosing string, file_id bigint, range struct<start_line:int,start_col:int,end_line:int,end_col:int>, name string, signature string")
    files = spark.createDataFrame([(i, f"src/F{i:04d}.java") for i in range(2101)], "file_id bigint, path string")
    use = lambda dst, f, line, cause=None: ("app/A#f().", dst, "CALLS", "value", cause, (f, (line, 9, line, 11), "CALL"))
    schema = "src string, dst string, type string, layer string, cause string, occ struct<file_id:bigint,range:struct<start_line:int,start_col:int,end_line:int,end_col:int>,role:string>"
    tail = [use("get~UNRESOLVED", i % 3, i, "UNSOLVED_SYMBOL") for i in range(1, 1201)]

    def answer(uses, budget):
        return Index({"symbols": symbols, "files": files, "edges": spark.createDataFrame(uses, schema)}, budget).call("find_java_references", {"symbol": "get"}).split("\n")

    short = answer([use(m, 5, 7), *tail], Budget())
    assert short[0].endswith("Total refs: 1 across 1 file") and short[2:] == ["1200 unconfirmed across 3 files", *(f"  src/F000{i}.java  400" for i in range(3)), "Shortened to fit the token budget."]
    whole = answer([use(m, 5, 7), *tail], Budget(default=None))
    assert len(whole) == 3 + 1200 and whole[2].startswith("1200 unconfirmed") and whole[-1].endswith("[UNSOLVED_SYMBOL]")
    wide = answer([use(m, i, 7) for i in range(2101)] + tail, Budget())
    assert wide[0].endswith("Total refs: 2101 across 2101 files") and wide[1:2102] == [f"  src/F{i:04d}.java  1" for i in range(2101)]
    assert wide[2102].startswith("1200 unconfirmed") and wide[-1].startswith("Over the token budget")
