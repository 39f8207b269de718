"""Matching, search, graph, live view, freshness, shape, store, extraction and streams on small known cases."""

import random

import pytest
from loomstone import schema
from loomstone.functions import text as tx
from loomstone.operators import fresh, graph, liveview, quality, search, shape
from loomstone.operators.ids import dense_ids
from loomstone.operators.match import SearchSpec, path_matches, qualified_match
from loomstone.plans import registry
from loomstone.runtime import table
from loomstone.sources import calllog, indexer, java, walk
from loomstone.sources.store import FormatError, Locked, Store, index_tables
from loomstone.streaming import feed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("moniker,typed,want", [
    ("com/shapes/Circle#area().", "area", True), ("com/shapes/Circle#area().", "Circle.area", True), ("com/shapes/MyCircle#area().", "Circle.area", False),
    ("com/shapes/Circle#area(a.B).", "shapes.area", False), ("com/shapes/Circle#", "myshapes.Circle", False), ("com/shapes/Circle#<init>(int).", "Circle", False),
    ("com/shapes/Circle#<init>(int).", "Circle.<init>", True), ("Circle#", "a.b.c.Circle", False), ("com/Circle#", "", False)])
def test_qualified_match(spark, moniker, typed, want):
    assert one(spark, qualified_match(F.col("m"), typed), m=moniker) is want


@pytest.mark.parametrize("glob,path,want", [
    ("*.java", "A.java", True), ("*.java", "a/A.java", False), ("**/*.java", "a/b/A.java", True), ("a/?.java", "a/B.java", True), ("a?b", "a/b", False),
    ("{a,b}/*.java", "b/C.java", True), ("[!a]x", "bx", True), ("[a-c]x", "dx", False), ("a[!b]c", "a/c", False), ("a\\*b", "a*b", True), ("*", None, False)])
def test_glob(spark, glob, path, want):
    assert one(spark, path_matches(F.col("p"), glob), p=path) is want


def test_specs(spark):
    assert SearchSpec("abc").literal and not SearchSpec("a.c").literal and SearchSpec("a.c", fixed=True).literal and not SearchSpec("abc", case_sensitive=False).literal
    assert not SearchSpec("a\\sb").per_line and SearchSpec("a.b").per_line
    with pytest.raises(ValueError):
        SearchSpec("a(").validate(spark)
    assert one(spark, SearchSpec("É", case_sensitive=False).matches(F.col("x")), x="é") is False  # folding is ASCII only
    assert one(spark, SearchSpec("a\\Eb", fixed=True, case_sensitive=False).matches(F.col("x")), x="xA\\Eby") is True


@pytest.mark.parametrize("text,ms", [("200", 200), ("200ms", 200), ("2s", 2000), ("0", None), ("-1", None), ("1m", None), ("", None), (None, None)])
def test_duration(spark, text, ms):
    assert one(spark, tx.duration_ms(F.col("x")), x=text) == ms


def test_generics(spark):
    assert one(spark, tx.strip_generics(F.col("x")), x="Map<String, List<Set<A>>> m") == "Map m"


UNITS = "file_id bigint, kind string, range struct<start_line:int,start_col:int,end_line:int,end_col:int>, text string"


def test_text_hits(spark):
    u = spark.createDataFrame([(1, "COMMENT", (10, 5, 12, 9), "foo bar\nxfoo foo\nnone"), (1, "COMMENT", (10, 5, 12, 9), "foo bar\nxfoo foo\nnone"), (2, "JAVADOC", (1, 1, 1, 1), None), (3, "COMMENT", (1, 1, 1, 4), "")], UNITS)
    hits = {(r["line"], r["col"], r["whole_word"], r["snippet"]) for r in search.text_hits(u, SearchSpec("foo")).collect()}
    assert hits == {(10, 5, True, "foo bar"), (11, 2, False, "xfoo foo")}
    assert {(r["line"], r["col"]) for r in search.text_hits(u, SearchSpec("bar\\s+xf")).collect()} == {(10, 9)}
    assert {(r["line"], r["col"]) for r in search.text_hits(u, SearchSpec("^n")).collect()} == {(12, 1)}
    assert search.text_hits(u, SearchSpec(" ")).count() == 0


def test_every_line_of_a_unit_with_a_match(spark, tmp_path):
    text = "a the file, the  file\nnone\nthe\n file and the file\nthe - file"
    spark.createDataFrame([(1, "COMMENT", (10, 5, 14, 10), text), (1, "COMMENT", (20, 1, 20, 8), "the file")] * 2, UNITS).write.parquet(str(tmp_path / "text_units.parquet"))
    got = {tuple(r) for r in registry.queries()["line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, "COMMENT", 10, 10, 7), (1, "COMMENT", 10, 12, 1), (1, "COMMENT", 10, 13, 11), (1, "COMMENT", 10, 14, 1), (1, "COMMENT", 20, 20, 1)}


def test_trigram_short_query(spark):
    with pytest.raises(ValueError):
        search.trigram_candidates(spark.createDataFrame([], "tri string, moniker string"), "io")


def test_dense_ids(spark):
    keys = [f"k{i:05d}" for i in range(3000)]
    random.Random(1).shuffle(keys)
    got = dense_ids(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k", start=5).collect()
    assert {r["k"]: r["id"] for r in got} == {k: i + 5 for i, k in enumerate(sorted(keys))}
    assert dense_ids(spark.createDataFrame([], "k string"), "k").count() == 0


def test_live_view_against_a_dictionary(spark):
    rnd = random.Random(42)
    base = {f: {f"m{f}_{k}" for k in range(3)} for f in range(40)}
    log, over, state = [], {}, {f: set(s) for f, s in base.items()}
    for seq in range(200):
        f = rnd.randrange(50)
        dead = rnd.random() < 0.2
        over[f] = set() if dead else {f"m{f}_{rnd.randrange(9)}" for _ in range(3)}
        state[f] = over[f]
        log.append((seq, f, dead))
    edits = liveview.latest_edits(spark.createDataFrame(log * 2, "seq bigint, file_id bigint, deleted boolean"))
    rows = lambda d: spark.createDataFrame([(f, m) for f, s in d.items() for m in s], "file_id bigint, moniker string")
    got = {tuple(r) for r in liveview.live(rows(base), rows(over), edits).collect()}
    assert got == {(f, m) for f, s in state.items() for m in s}


def test_live_edges_and_text_of_edited_files(spark, tmp_path):
    """File 0 is unchanged, 1 was edited, 2 was withdrawn: the slices of 1 are replaced, not lost."""
    place = lambda i: (i, 1, i, 9)
    rng = "range struct<start_line:int,start_col:int,end_line:int,end_col:int>"
    tables = {
        "files": ([(i, f"F{i}.java", 3 if i != 1 else 9, 5, None if i == 2 else "h", "MAIN") for i in range(3)], "file_id bigint, path string, size bigint, mtime bigint, content_hash string, source_set string"),
        "source_files": ([(i, "abc") for i in range(3)], "file_id bigint, text string"),
        "symbols": ([(f"s{i}", "CLASS", 0, None, i, place(1), f"s{i}", None) for i in range(3)], f"moniker string, kind string, flags int, enclosing string, file_id bigint, {rng}, name string, signature string"),
        "edges": ([(src, "x", "CALLS", "value", None, (0, place(n), "CALL")) for src, n in (("s0", 1), ("s1", 1), ("s1", 2), ("s2", 1), ("~out", 1))] * 2, "src string, dst string, type string, layer string, cause string, occ struct<file_id:bigint," + rng.replace("range struct", "range:struct") + ",role:string>"),
        "text_units": ([(i, "COMMENT", place(n), f"t{i}{n}") for i in range(3) for n in (1, 2)] * 2, f"file_id bigint, kind string, {rng}, text string")}
    for name, (rows, schema_) in tables.items():
        spark.createDataFrame(rows, schema_).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r["src"], r["n"]) for r in run("live_edges")} == {("s0", 1), ("s1", 2), ("~out", 1)}
    assert sorted(r["text"] for r in run("live_text")) == ["t01", "t02", "t11", "t12"]


def test_valid_prefix(spark):
    log = calllog.frame(spark.createDataFrame([(i, f"p{i}") for i in range(5)], "seq bigint, payload string"))
    torn = calllog.verified(log.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload"))))
    assert sorted(r["seq"] for r in liveview.valid_prefix(torn).collect()) == [0, 1, 2]
    assert liveview.valid_prefix(calllog.verified(log)).count() == 5


@pytest.mark.parametrize("base,log,ratio,want", [(100, 50, 0.5, True), (100, 49, 0.5, False), (0, 9, 0.5, False), (100, 900, None, False)])
def test_compaction_policy(base, log, ratio, want):
    assert liveview.should_compact(base, log, ratio) is want


def test_fresh(spark):
    known = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 2, "h"), ("d", 1, None)], "path string, size bigint, content_hash string")
    now = spark.createDataFrame([("a", 1, "h"), ("c", 3, "h"), ("d", 1, "x"), ("e", 1, "y")], "path string, size bigint, content_hash string")
    diff = fresh.snapshot_diff(known, now)
    assert {tuple(r) for r in diff.collect()} == {("a", "unchanged"), ("b", "deleted"), ("c", "touched"), ("d", "changed"), ("e", "added")}
    assert fresh.reconcile_stats(diff).first().asDict() == {"total": 5, "unchanged": 1, "touched": 1, "added": 1, "changed": 1, "deleted": 1, "reparsed": 2, "warm": True}
    old = spark.createDataFrame([(1, "m", "s"), (1, "n", None)], "file_id bigint, moniker string, signature string")
    new = spark.createDataFrame([(1, "m", None), (1, "o", None)], "file_id bigint, moniker string, signature string")
    assert {tuple(r)[1:] for r in fresh.node_diff(old, new).collect()} == {("m", "signatureChanged"), ("n", "removed"), ("o", "added")}


def test_failure_causes(spark):
    def cause(exception, message="", **flags):
        f = [F.lit(flags.get(k, False)) for k in ("stack", "lam", "pat", "var", "args")]
        return spark.range(1).select(quality.classify_failure(F.lit(exception), F.lit(message), *f)).first()[0]

    assert cause("MethodAmbiguityException", stack=True) == "OVERLOAD_AMBIGUITY"
    assert cause("X", stack=True) == "GENERICS_INFERENCE"
    assert cause("UnsolvedSymbolException", "Unsolved symbol : java.io") == "NON_SYMBOL_QUALIFIER"
    assert cause("X", "We are unable to find the value declaration corresponding to Outer.Inner)") == "NESTED_MEMBER_ACCESS"
    assert cause("UnsupportedOperationException", "AnnotationDeclaration x") == "ANNOTATION_MEMBER"
    assert cause("UnsupportedOperationException", lam=True) == "LAMBDA_METHODREF" and cause("UnsupportedOperationException") == "UNSUPPORTED"
    assert cause("UnsolvedSymbolException", "Foo") == "MISSING_CLASSPATH" and cause("X", args=True) == "GENERICS_INFERENCE" and cause("X", None) == "OTHER"


def test_recall(spark):
    o = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "w string, x int")
    p = spark.createDataFrame([("a", 1), ("a", 1), ("a", 9), ("c", 1)], "w string, x int")
    by = quality.compare(o, p, "w", ["w", "x"])
    assert {tuple(r) for r in by.collect()} == {("a", 2, 2, 1), ("b", 1, 0, 0), ("c", 0, 1, 0)}
    assert tuple(quality.micro_macro(by).first()) == (pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(0.25))
    assert [r["w"] for r in quality.worst_offenders(by, "w").collect()] == ["a", "b", "c"]
    assert quality.micro_macro(by.limit(0)).first()["micro_recall"] == 1.0


def test_budget(spark):
    rows = [("a", "f.java", i, "x" * 30) for i in range(20)] + [("b", f"f{i}.java", 1, None) for i in range(3)]
    sizes = shape.rung_sizes(spark.createDataFrame(rows, "k string, path string, line int, snippet string"), "k")
    rung = {r["k"]: r["rung"] for r in sizes.withColumn("rung", shape.choose_rung(80)).collect()}
    assert rung == {"a": "locations", "b": "full"}
    assert {r["rung"] for r in sizes.withColumn("rung", shape.choose_rung(None)).collect()} == {"full"}
    assert shape.Budget({"grep": 10}).cap("grep") == 10 and shape.Budget(default=None).cap("x") is None


JAVA = '''package a.b;
import x.Y;
/** Doc of <T>. */
public class Cart<T extends Base> extends Base implements One, Two {
    private int a, b = f(1, 2);
    // before
    @Tag({1, 2}) Cart(int... n) { this.a = n[0]; }
    /** Says. */
    <R> Map<String, R> get(final @Nn List<R> x, int[] y) throws Ex { String s = "/* no */ \\"q\\""; return x.y().z; /* c */ }
    abstract void open();
    static { init(); }
    enum Day { MON, TUE { void m() {} }; int k; }
    record P(int x, String y) { P { check(); } }
    @interface Ann { int value() default 1; }
}
'''


def test_java_extraction():
    rows = java.Parser(java.Source(JAVA)).rows
    assert [(r["kind"], r["name"]) for r in rows] == [
        ("CLASS", "Cart"), ("FIELD", "a"), ("FIELD", "b"), ("CONSTRUCTOR", "Cart"), ("METHOD", "get"), ("METHOD", "open"), ("ENUM", "Day"), ("ENUM_CONSTANT", "MON"),
        ("ENUM_CONSTANT", "TUE"), ("FIELD", "k"), ("RECORD", "P"), ("FIELD", "x"), ("FIELD", "y"), ("ANNOTATION", "Ann"), ("METHOD", "value")]
    get = rows[4]
    assert get["doc_text"] == "    /** Says. */" and get["has_body"] and not get["body_has_line_comment"] and get["parent_no"] == 0
    texts = [(k, x) for k, _, x in java.text_units(java.Source(JAVA))]
    assert texts == [("JAVADOC", " Doc of <T>. "), ("COMMENT", " before"), ("JAVADOC", " Says. "), ("STRING_LITERAL", '/* no */ \\"q\\"'), ("COMMENT", " c ")]
    assert java.Parser(java.Source("class A { void m( {")).rows[0]["name"] == "A"  # damaged text gives what could be read
    assert list(java.text_units(java.Source(""))) == []


def test_extraction_matches_the_tables(spark):
    sources = table(spark, SF, "source_files")
    got = {(r["file_id"], r["kind"], r["target_name"], tuple(r["range"])) for r in java.extract_usages(sources).collect()}
    want = {(r["file_id"], r["kind"], r["target_name"].strip(), tuple(r["range"])) for r in table(spark, SF, "usages").where("trim(target_name) <> ''").collect()}
    assert want <= got
    cols = ["file_id", "kind", "name", "header_text", "start_line", "end_line", "body_inner", "doc_text"]
    have = {tuple(r) for r in java.extract_skim(sources).select(*cols).collect()}
    assert {tuple(r) for r in table(spark, SF, "skim_decls").where("name = trim(name)").select(*cols).collect()} <= have


def test_one_parse_gives_what_each_extractor_gives(spark):
    sources = table(spark, SF, "source_files")
    found = java.facts(sources)
    for name, single in (("text_units", java.extract_text), ("usages", java.extract_usages), ("skim_decls", java.extract_skim), ("outline", java.extract_outline)):
        a, b = java.projection(found, name), single(sources)
        assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert found.where("failure IS NOT NULL").count() == 0


@pytest.mark.parametrize("text,failure", [("class A { void m() { x(); }", "the text ends inside the declaration of A"), ("class A { int f", "the text ends inside the declaration of A"), ("class A {} ", None), ("", None), ("class A { void m(", "the text ends inside the declaration of m")])
def test_failures_are_told(text, failure):
    found, said = java.parse(text, ("outline",))
    assert said == failure and all(r["range"]["end_line"] for r in found["outline"])


def test_index_and_reindex(spark, tmp_path):
    root = tmp_path / "proj/src/main/java/p"
    root.mkdir(parents=True)
    (root / "A.java").write_text("package p;\n/** Holds rows. */\nclass A {\n  void m() { B.go(); }\n}\n")
    (root / "B.java").write_text("package p;\nclass B { static void go() { }\n")
    store = Store(spark, str(tmp_path / "index"))
    assert indexer.index_repo(store, str(tmp_path / "proj")) == 1
    monikers = lambda: {r["moniker"] for r in store.read("symbols").collect()}
    assert monikers() == {"p/A#", "p/A#m().", "p/B#", "p/B#go()."}
    assert {(r["src"], r["dst"]) for r in store.read("edges").collect()} == {("p/A#", "p/A#m()."), ("p/B#", "p/B#go().")}
    assert [r["failure"] for r in indexer.failures(store).collect()] == ["the text ends inside the declaration of B"]
    assert {r["target_name"] for r in store.read("usages").collect()} >= {"go"}
    path = {r["path"].rsplit("/", 1)[1]: r["path"] for r in store.read("files").collect()}
    ids = {r["path"]: r["file_id"] for r in store.read("files").collect()}
    walked = spark.createDataFrame([
        (path["B.java"], 30, 5, "package p;\nclass B { int f; }\n"), ("src/main/java/p/C.java", 9, 5, "package p;\nclass C { }\n"), (path["A.java"], 0, 5, None)], "path string, size bigint, mtime bigint, text string")
    assert indexer.reindex(store, walked) == 2
    assert monikers() == {"p/B#", "p/B#f.", "p/C#"}
    assert indexer.failures(store).count() == 0
    now = {r["path"]: r["file_id"] for r in store.read("files").collect()}
    assert now[path["B.java"]] == ids[path["B.java"]] and path["A.java"] not in now and len(set(now.values()) | set(ids.values())) == 3
    assert {(r["src"], r["dst"]) for r in store.read("edges").collect()} == {("p/B#", "p/B#f.")}


def test_resolved_again(spark):
    syms = spark.createDataFrame([(f"s{i}", "CLASS", 0, None, i, (1, 1, 2, 1), f"s{i}", None) for i in range(3)], schema.SCHEMAS["symbols"])
    row = lambda s, d, layer: (s, d, "CALLS", layer, None, None)
    base = spark.createDataFrame([row("s0", "old", "value"), row("s0", "in", "structural"), row("s1", "kept", "value"), row("s2", "gone", "value"), row("~x", "y", "value")], schema.SCHEMAS["edges"])
    found = spark.createDataFrame([row("s0", "new", "value"), row("s1", "other", "value"), row("s2", "late", "value"), row("s0", "again", "structural")], schema.SCHEMAS["edges"])
    edits = spark.createDataFrame([(0, 1, False), (2, 1, True)], "file_id bigint, seq bigint, deleted boolean")
    assert {(r["src"], r["dst"]) for r in liveview.resolved_again(base, found, syms, edits).collect()} == {("s0", "in"), ("s0", "new"), ("s1", "kept"), ("~x", "y")}


def test_moniker_composition(spark):
    skim = spark.createDataFrame(
        [(1, 0, None, "CLASS", "A", "class A<T>", 1), (1, 1, 0, "CLASS", "B", "class B", 2), (1, 2, 1, "METHOD", "m", "Map<K, V> m(final Map<K, List<V>> a, @X(1) int... b)", 3), (1, 3, 1, "CONSTRUCTOR", "B", "B()", 4), (1, 4, 0, "FIELD", "f", "int f;", 5)],
        "file_id bigint, decl_no int, parent_no int, kind string, name string, header_text string, start_line int")
    files = spark.createDataFrame([("mod/src/main/java/p/q/A.java", 1)], "path string, file_id bigint")
    got = {r["decl_no"]: (r["moniker"], r["enclosing"]) for r in graph.compose_monikers(skim, files).collect()}
    assert got == {0: ("p/q/A#", None), 1: ("p/q/A#B#", "p/q/A#"), 2: ("p/q/A#B#m(Map,int[]).", "p/q/A#B#"), 3: ("p/q/A#B#<init>().", "p/q/A#B#"), 4: ("p/q/A#f.", "p/q/A#")}


def test_store(spark, tmp_path):
    tables = {n: table(spark, SF, n) for n in ("symbols", "edges", "text_units", "usages", "files")}
    store = Store(spark, str(tmp_path / "index"))
    with pytest.raises(FormatError):
        store.read("symbols")
    assert store.write(index_tables(**tables, text_kinds=["COMMENT"])) == 1
    assert store.read("edges").count() == tables["edges"].distinct().count() == store.read("edges_by_dst").count()
    assert {r["kind"] for r in store.read("text_units").select("kind").distinct().collect()} == {"COMMENT"}
    assert store.write({"files": tables["files"].limit(1)}) == 2
    assert store.read("files").count() == 1 and store.read("symbols").count() == tables["symbols"].distinct().count()
    assert store.stats()["symbols"] > 0
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path / "index"), read_only=True).write({})
    assert not (tmp_path / "index/v=000002/symbols").exists()  # tables that stay are not copied
    (tmp_path / "index/LOCK").write_text("somebody")
    with pytest.raises(Locked):
        store.write({"files": tables["files"]})
    assert store.version == 2
    store.unlock()
    assert store.write({"files": tables["files"].limit(1)}) == 3 and not (tmp_path / "index/LOCK").exists()
    (tmp_path / "index/CURRENT").write_text("2")
    (tmp_path / "index/.CURRENT.crc").unlink(missing_ok=True)
    (tmp_path / "index/v=000002/MANIFEST.json").write_text('{"format": 99, "tables": {}}')
    (tmp_path / "index/v=000002/.MANIFEST.json.crc").unlink(missing_ok=True)
    with pytest.raises(FormatError):
        store.read("files")


def test_walk(spark, tmp_path):
    for p in ("m/src/main/java/a/A.java", "m/src/test/java/a/T.java", "m/target/x/src/main/java/B.java", "m/readme.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"class {p[-6]} {{}}")
    assert walk.source_roots(str(tmp_path)) == [("m/src/main/java", "MAIN"), ("m/src/test/java", "TEST")]
    got = walk.fingerprints(walk.walk(spark, str(tmp_path))).collect()
    assert {r["path"] for r in got} == {"m/src/main/java/a/A.java", "m/src/test/java/a/T.java", "m/target/x/src/main/java/B.java"}
    assert walk.java_level("<maven.compiler.release>21</maven.compiler.release>") == "21" and walk.java_level("") is None


def test_calls_round_trip(spark, tmp_path):
    calls = table(spark, SF, "call_log").where("request IS NOT NULL")
    calllog.write_calls(calls, str(tmp_path / "log"))
    assert calllog.read_calls(spark, str(tmp_path / "log")).count() == calls.count()


def _feed(spark, tmp_path, on_change=None):
    q = feed.keep_latest(feed.stream(spark, str(tmp_path / "in"), "files", 2), str(tmp_path / "out"), str(tmp_path / "cp"), on_change=on_change)
    q.awaitTermination()
    at = (tmp_path / "out/latest").read_text()
    return {r["path"]: (r["mtime"], r["content_hash"]) for r in spark.read.parquet(str(tmp_path / f"out/state={at}")).collect()}


def _report(spark, tmp_path, *row):
    spark.createDataFrame([row], schema.SCHEMAS["files"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_keeps_latest(spark, tmp_path):
    for r in [("p1", 1, 1, 10, "h1", "MAIN"), ("p1", 1, 1, 30, "h3", "MAIN"), ("p1", 1, 1, 20, "h2", "MAIN"), ("p2", 2, 1, 5, None, "TEST"), ("p1", 1, 1, 10, "h1", "MAIN")]:
        _report(spark, tmp_path, *r)
    for _ in range(2):  # a second run finds nothing new
        assert _feed(spark, tmp_path) == {"p1": (30, "h3"), "p2": (5, None)}


def test_stream_reports_a_return_to_earlier_content(spark, tmp_path):
    seen = []
    note = lambda batch, no: seen.extend((r["mtime"], r["content_hash"]) for r in batch.collect())
    for mtime, content in ((1, "a"), (2, "b"), (3, "a"), (4, "a"), (2, "b")):
        _report(spark, tmp_path, "p", 1, 1, mtime, content, "MAIN")
        _feed(spark, tmp_path, note)
    assert seen == [(1, "a"), (2, "b"), (3, "a")]


def test_a_state_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    import shutil

    from pyspark.errors import StreamingQueryException

    for i in range(4):
        _report(spark, tmp_path, f"p{i}", i, 1, 1, "a", "MAIN")
    before = _feed(spark, tmp_path)
    at = (tmp_path / "out/latest").read_text()
    shutil.move(tmp_path / f"out/state={at}", tmp_path / "aside")
    _report(spark, tmp_path, "new", 9, 1, 1, "a", "MAIN")
    with pytest.raises(StreamingQueryException):
        _feed(spark, tmp_path)
    assert (tmp_path / "out/latest").read_text() == at
    shutil.move(tmp_path / "aside", tmp_path / f"out/state={at}")
    assert _feed(spark, tmp_path) == before | {"new": (1, "a")}


def test_changes_of_a_batch(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 1, "a"), ("p", 2, "a"), ("p", 3, None), ("p", 4, None), ("q", 1, None), (None, 1, "x")], "path string, mtime bigint, content_hash string")
    assert {tuple(r) for r in feed.changes(df).collect()} == {("p", 1, "a"), ("p", 3, None), ("q", 1, None), (None, 1, "x")}
    assert feed.changes(df.limit(0)).count() == 0


def test_stream_windows_equal_batch(spark, tmp_path):
    calls = table(spark, SF, "call_log")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    streamed = feed.run_to_memory(feed.call_windows(feed.stream(spark, str(tmp_path / "in"), "call_log"), late="3650 days"), "windows")
    assert streamed.select("tool", "window_start", "calls").exceptAll(feed.call_windows(calls).select("tool", "window_start", "calls")).count() == 0


def test_deadline(spark):
    assert feed.deadline(spark, 60, "quick", lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        feed.deadline(spark, 0.5, "slow", lambda: spark.range(0, 10**12, 1, 8).selectExpr("sum(hash(id, id * 2))").collect())


REF_EDGES = "src string, dst string, type string, layer string, cause string, occ struct<file_id:bigint,range:struct<start_line:int,start_col:int,end_line:int,end_col:int>,role:string>"


def test_references_of_the_known_fixture(spark):
    def use(src, dst, line, cause=None):
        return (src, dst, "CALLS", "value", cause, (1, (line, 9, line, 11), "CALL"))

    run = "app/Service#run()."
    rows = [use("app/ClientA#go().", run, 5), use("app/ClientB#first(Service).", run, 8), use("app/ClientB#second(Service).", run, 12), use("app/Mystery#poke().", "run~UNRESOLVED", 4, "MISSING_CLASSPATH"),
            use("app/KnownMiss#use(Service).", "run~UNRESOLVED", 6, "UNSOLVED_SYMBOL"), ("app/Service#", run, "CONTAINS", "structural", None, (-1, (-1, -1, -1, -1), "NONE"))]
    edges = spark.createDataFrame(rows * 2, REF_EDGES)
    groups = {r["enclosing"]: r["n"] for r in graph.reference_groups(edges).collect()}
    assert groups == {"app/ClientA#go().": 1, "app/ClientB#first(Service).": 1, "app/ClientB#second(Service).": 1}
    symbols = spark.createDataFrame([(run, "METHOD", 0, "app/Service#", 2, (3, 1, 3, 9), "run", None)], "moniker string, kind string, flags int, enclosing string, file_id bigint, range struct<start_line:int,start_col:int,end_line:int,end_col:int>, name string, signature string")
    refs, tail = graph.find_references(edges, symbols, "Service.run")
    assert refs.count() == 3 and tail.count() == 2
    assert [tuple(r) for r in graph.reference_counts(edges).collect()] == [(run, 3, 1, 3)]
    assert graph.reference_groups(edges.limit(0)).count() == 0


def test_innermost_over_buckets(spark):
    ranges = spark.createDataFrame([("outer", 1, 1, 1, 900, 9, 899_000_008), ("inner", 1, 100, 5, 300, 6, 200_000_001), ("line", 1, 200, 1, 200, 50, 49), ("tie", 1, 200, 1, 200, 50, 49), ("other", 2, 1, 1, 9, 9, 8_000_008)],
                                   "moniker string, file_id bigint, sl int, sc int, el int, ec int, span bigint")
    points = spark.createDataFrame([(1, 200, 3), (1, 100, 4), (1, 100, 5), (1, 300, 7), (1, 901, 1), (2, 5, 5), (3, 1, 1)], "file_id bigint, line int, col int")
    got = {(r["file_id"], r["line"], r["col"]): r["enclosing"] for r in graph.innermost(points, ranges, ["file_id", "line", "col"]).collect()}
    assert got == {(1, 200, 3): "line", (1, 100, 4): "outer", (1, 100, 5): "inner", (1, 300, 7): "outer", (2, 5, 5): "other"}
