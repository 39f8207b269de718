"""Training-data operators against brute force, known cases and round trips, and with nulls, empties, repeats and foreign columns."""

import math
import random
import unicodedata

import numpy as np
import pytest

llm = pytest.importorskip("loomstone.llm.queries")
from loomstone.llm import docpairs, fmindex, leakage, natural, packing, prose, sentences, termfreq  # noqa: E402
from loomstone.runtime import table  # noqa: E402
from oracle import compare  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(spark, name):
    if name in llm.SQL:
        assert compare(spark, name, llm.QUERIES[name], llm.SQL[name], SF) == ""
    else:
        assert llm.QUERIES[name](spark, SF).count() > (0 if name != "p6_found" else -1)


# ---- p1


@pytest.mark.parametrize("doc,name,header,want", [
    ("/** Holds the lock throughout. */", "run", "void run()", True), ("/** Runs. */", "run", "void run()", False), (None, "run", "void run()", False), ("/** */", "f", "f()", False),
    ("/** This trims the warm ladders */", "trimWarmLadder", "void trimWarmLadder()", False), ("/** {@inheritDoc} */", "f", "f()", False), ("/** {@inheritDoc} Only on a warm start. */", "f", "f()", True),
    ("/**\n * @param slot slot\n * @return this\n */", "f", "f(int slot)", False), ("/** @return empty input yields zero. */", "f", "f()", True), ("/** TODO */", "f", "f()", False),
    ("/** Konstruktor */", "C", "C()", False), ("/** Default constructor for Cart. */", "Cart", "Cart()", False), ("/** 行号从一开始。 */", "f", "f()", True), ("/** 构造函数 */", "f", "f()", False),
    ("/** @author ann */", "f", "f()", False), ("/** Jamais hors du verrou. */", "f", "f()", True), ("/** Только под блокировкой. */", "f", "f()", True), ("/** <pre>x.y();</pre> */", "f", "f()", False),
    ("/** ------ */", "f", "f()", False), ("/** La cachÃ© ordena las filas. */", "f", "f()", True)])
def test_description(doc, name, header, want):
    assert docpairs.describe(doc, name, header)[1] is want


@pytest.mark.parametrize("body,want", [(None, False), ("", False), (" // x\n", False), ("/* a; */", False), ("return 1;", True), ('log("/* no comment */");', True), ("; ;", False), ("// a\r\n x();", True), ('"//";', True)])
def test_statements(body, want):
    assert docpairs.has_statement(body) is want


RANGE = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
SKIM = "file_id bigint, decl_no int, parent_no int, kind string, name string, doc_text string, doc_start_line int, header_text string, start_line int, end_line int, body_inner string, has_body boolean, owner string"
SYMBOLS = f"moniker string, kind string, flags int, enclosing string, file_id bigint, range {RANGE}, name string, signature string"
EDGES = f"src string, dst string, type string, layer string, cause string, occ struct<file_id:bigint,range:{RANGE},role:string>"


def test_inherited_documentation(spark):
    said = "/** Never blocks a reader. */"

    def m(f, doc, body):
        return (f, 1, 0, "METHOD", "m", doc, 2, "void m(int a)", 3, 5, body, True, "clash")

    skim = [m(1, said, None), m(2, None, "x();"), m(3, "/** {@inheritDoc} */", "x();"), m(4, None, "x();"), m(5, "/** Locks every file twice. */", "x();"), m(6, None, " // none\n")]
    symbols = [(f"p/{t}#m(int).", "METHOD", 0, f"p/{t}#", f, (3, 1, 5, 1), "m", None) for f, t in enumerate("ABCXEF", 1)]
    up = [("B", "A"), ("C", "B"), ("B", "C"), ("X", "Y"), ("E", "A"), ("F", "A")]
    edges = [(f"p/{a}#", f"p/{b}#", "EXTENDS", "hierarchy", None, None) for a, b in up]
    got = docpairs.pairs(spark.createDataFrame(skim * 2, SKIM), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)).collect()
    assert {(r["file_id"], r["origin"], r["source"], r["description"]) for r in got} == {
        (2, "inherited", "1:1", "Never blocks a reader."), (3, "inherited", "1:1", "Never blocks a reader."), (5, "own", None, "Locks every file twice.")}
    assert all(r["body_inner"] for r in got) and len(got) == 3
    empty = [spark.createDataFrame([], s) for s in (SKIM, SYMBOLS, EDGES)]
    assert docpairs.pairs(*empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None, None, None, None), (None, 1, 0, "METHOD", "m", said, 2, "h", 3, 5, "x();", True, "")], SKIM)
    assert docpairs.pairs(nulls, empty[1], empty[2]).count() == 0


def test_inherited_sections(spark):
    """Main text, parameters and results are inherited one by one, through a type variable too; {@inheritDoc} is filled in."""

    def m(f, doc, body, header="int m(int slot)"):
        return (f, 1, 0, "METHOD", "m", doc, 2, header, 3, 5, body, True, "clash")

    skim = [
        m(1, "/** Never blocks a reader.\n * @param slot counted from zero upwards\n * @return remaining free rows */", None, "int m(T slot)"),
        m(2, "/** Also warms the shard. {@inheritDoc}\n * @return doubled weight */", "x();", "int m(Row slot)"), m(3, "/** @param slot {@inheritDoc} */", "x();", "int m(Row slot)"), m(4, None, "x();", "int m(Row slot, int b)")]
    tails = {1: "m(T).", 2: "m(a.b.Row).", 3: "m(Row).", 4: "m(Row,int)."}
    symbols = [(f"p/{t}#{tails[f]}", "METHOD", 0, f"p/{t}#", f, (3, 1, 5, 1), "m", None) for f, t in enumerate("ABCD", 1)]
    edges = [(f"p/{a}#", f"p/{b}#", "EXTENDS", "hierarchy", None, None) for a, b in [("B", "A"), ("C", "B"), ("D", "A")]]
    got = {r["file_id"]: (r["origin"], r["description"]) for r in docpairs.pairs(spark.createDataFrame(skim, SKIM), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == {
        2: ("own", "Also warms the shard. Never blocks a reader. @return doubled weight @param slot counted from zero upwards"),
        3: ("inherited", "Never blocks a reader. @param slot counted from zero upwards @return doubled weight")}
    assert {r["file_id"] for r in docpairs.speaking(spark.createDataFrame(skim * 2, SKIM)).collect()} == {2}


def test_found_resolves_inherited_documentation(spark, tmp_path, monkeypatch):
    """p1_found chooses from what all steps resolve; a hierarchy with loops and several parents gives what a search by level gives."""
    rnd = random.Random(5)
    n = 30
    up = {t: {rnd.randrange(1, n + 1) for _ in range(rnd.choice([0, 1, 1, 2]))} for t in range(1, n + 1)}
    doc = {t: rnd.choice([None, None, "/** {@inheritDoc} */", f"/** Never blocks reader {'abcdefghij'[t % 10] * 3}{'klm'[t // 10 % 3] * 3}. */"]) for t in up}
    body = {t: rnd.choice(["x();", "x();", " // none\n", None]) for t in up}
    skim = [(t, 1, 0, "METHOD", "m", doc[t], 2, "void m(int slot)", 3, 5, body[t], True, "clash") for t in up]
    symbols = [(f"p/T{t}#m(int).", "METHOD", 0, f"p/T{t}#", t, (3, 1, 5, 1), "m", None) for t in up]
    edges = [(f"p/T{a}#", f"p/T{b}#", "EXTENDS", "hierarchy", None, None) for a in up for b in up[a]]
    for name, rows, schema in (("skim_decls", skim * 2, SKIM), ("symbols", symbols * 2, SYMBOLS), ("edges", edges * 2, EDGES)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    speaks = {t for t in up if doc[t] and "Never" in doc[t]}
    want = set()
    for t in up:
        level, seen = {t}, {t}
        while level and not level & speaks:
            level = {b for a in level for b in up[a]} - seen
            seen |= level
        if level and body[t] == "x();":
            at = min(level & speaks)
            want.add((t, "own" if at == t else "inherited", None if at == t else f"{at}:1", doc[at][4:-3]))
    resolved, described = [], docpairs.described
    monkeypatch.setattr(docpairs, "described", lambda *tables: resolved.append(described(*tables)) or resolved[-1])
    found = sorted(tuple(r) for r in llm.p1_found(spark, str(tmp_path)).collect())
    assert len(resolved) == 1  # the query went through every step
    got = sorted(tuple(r) for r in resolved[0].select("file_id", "origin", "source", "description").collect())
    assert got == sorted(want) and {o for _, o, _, _ in got} == {"own", "inherited"}
    assert found == [(t, 3) for t, origin, _, _ in got if origin == "own"]


# ---- p3


def test_frequencies_against_counts(spark):
    rnd = random.Random(3)
    rows = [(f"t{min(int(rnd.expovariate(0.02)), 3000)}" if rnd.random() < 0.6 else "hot", rnd.randrange(60), i) for i in range(6000)] + [(" hot ", 1, -1), (None, 1, -2), ("", 2, -3), ("hot", None, -4)]
    df = spark.createDataFrame(rows + rows[:500], "target_name string, file_id bigint, id int")
    want = {}
    for name, f, _ in rows:
        if name and name.strip():
            n, files = want.setdefault(name.strip(), [0, set()])
            want[name.strip()][0] = n + 1
            if f is not None:
                files.add(f)
    got = {r["term"]: (r["n_rows"], r["n_files"]) for r in termfreq.frequencies(termfreq.occurrences("f", df, "target_name")).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    hot = {r["term"]: (r["n_rows"], r["n_files"]) for r in termfreq.frequencies(termfreq.occurrences("f", df, "target_name"), least_hot=20).collect()}
    assert hot == got
    assert termfreq.frequencies(termfreq.occurrences("f", df.limit(0), "target_name")).count() == 0
    marks = {r["n_files"]: r["mark"] for r in termfreq.marked(spark.createDataFrame([("f", "t", 1, n) for n in (1, 2, 3, 10, 11)], "field string, term string, n_rows bigint, n_files bigint"), 100).collect()}
    assert marks == {1: "rare", 2: "rare", 3: None, 10: None, 11: "common"}


# ---- p4


@pytest.mark.parametrize("text,lang", [
    (" The file table drops the path.", "en"), ("Not for hot paths!", "en"), ("Empty input yields zero.", "en"), ("Der Index prueft zwei Schluessel.", "de"), ("n\\u00e4chtliche Kommentare vor dem Lauf", "de"),
    ("La cach&eacute; cuenta las filas", "es"), ("Le journal compte les lignes modifiÃ©es.", "fr"), ("Кэш хранит удалённые файлы.", "ru"), ("行号从一开始。", "zh"), ("行は一から数える。", "ja"),
    ("केवल ताले के भीतर चलाएँ।", "hi"), ("แคชนี้อ่านบรรทัดที่แก้ไข", "th"), (None, None), ("  ", None), ("SELECT a FROM b WHERE c = ?", None), ("for (int i = 0; i < n; i++) { a.add(i); }", None), ("/opt/a/b", None),
    ("yyyy-MM-dd", None), ("if (x == null) return;", None), (" @param slot slot\n * @return this ", None), ("TODO", None), ("{@code openPebble}", None), ("[a-z]+\\\\.x$", None), ("=====", None), ("${limit}", None),
    (" @return the index merges the rows. ", "en"), ("构造函数", None), ("\n * КОГДА ХЕШ ОТЛИЧАЕТСЯ\n", "ru"), ("0xdcf6", None), ("text/total", None), ("x = y + 0;", None)])
def test_language(text, lang):
    assert prose.unit_language(text) == lang


def test_language_shares(spark):
    rows = [(1, "COMMENT", (1, 1, 1, 9), "The file table drops the path"), (1, "COMMENT", (1, 1, 1, 9), "The file table drops the path"), (1, "STRING_LITERAL", (2, 1, 2, 9), "x"), (2, "COMMENT", (1, 1, 1, 2), None)]
    df = spark.createDataFrame(rows, f"file_id bigint, kind string, range {RANGE}, text string")
    assert [tuple(r) for r in natural.language_shares(df).collect()] == [(1, "en", 1, pytest.approx(29 / 30))]
    assert natural.text_languages(df.limit(0)).count() == 0


# ---- p6


def test_packing_limits_and_round_trip(spark):
    rnd = random.Random(6)
    texts = ["x" * rnd.choice([5, 40, 90, 300, 900]) for _ in range(400)] + ["é" * 700, "> q\n" * 50 + "a" * 100, None, "", " \n", "文" * 3000]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, container string")
    got = packing.assign(df, capacity=1000, segments=6).collect()
    by = {}
    for r in got:
        by.setdefault(r["container"], []).append(r)
        assert r["pieces"] == 1 or len(texts[r["doc_id"]].encode()) > 1000
    for rows in by.values():
        assert sum(r["tokens"] for r in rows) <= 1000 and len(rows) <= 6 and sum(r["loss_tokens"] for r in rows) <= 1000
    for i, t in enumerate(texts):
        parts = sorted((r["piece"], r["start_byte"], r["end_byte"]) for r in got if r["doc_id"] == i)
        if t and t.strip():
            assert b"".join(t.encode()[a:b] for _, a, b in parts) == t.encode()
            assert all(t.encode()[a:b].decode() for _, a, b in parts)
        else:
            assert parts == []
    quoted = next(r for r in got if r["doc_id"] == 401)
    assert quoted["loss_tokens"] == 100
    assert packing.assign(df.limit(0)).count() == 0
    long_quote = spark.createDataFrame([(1, "> " + "a" * 2500 + "\nb")], "doc_id bigint, text string")
    assert [r["loss_tokens"] for r in packing.assign(long_quote, capacity=1000).orderBy("piece").collect()] == [0, 0, 1]
    tight = packing.assign(df, capacity=1000, segments=6, loss=400).collect()
    loads = {}
    for r in tight:
        loads.setdefault(r["container"], []).append(r)
    for rows in loads.values():
        assert sum(r["tokens"] for r in rows) <= 1000 and len(rows) <= 6
        assert sum(r["loss_tokens"] for r in rows) <= 400 or sum(r["loss_tokens"] > 0 for r in rows) == 1
    assert any(len(rows) == 6 for rows in loads.values()) and any(350 < sum(r["loss_tokens"] for r in rows) <= 400 for rows in loads.values())
    with pytest.raises(ValueError):
        packing.assign(df, capacity=2)


def test_packing_is_tight():
    rnd = np.random.default_rng(1)
    size = np.clip(rnd.lognormal(6, 1, 4000), 20, 8192)
    no = packing.dot_product_packing(np.column_stack([size, np.ones(4000), size * 0.9]), np.array([8192.0, 1024, 8192]))
    assert (no >= 0).all() and np.bincount(no, weights=size).max() <= 8192
    assert size.sum() / (8192 * (no.max() + 1)) > 0.98


# ---- p7


def test_fm_index_against_search():
    rnd = np.random.default_rng(0)
    for sigma, n in ((3, 300), (50, 2000), (2, 17)):
        text = np.append(rnd.integers(1, sigma + 1, n), 0)
        index = fmindex.FMIndex(text, sigma + 1, every=4)
        assert [text[i:].tolist() for i in fmindex.suffix_array(text)] == sorted(text[i:].tolist() for i in range(n + 1))
        patterns = rnd.integers(1, sigma + 1, (60, 3))
        which, lo, hi = index.search(patterns)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
        for k, p in enumerate(patterns):
            want = [i for i in range(n - 2) if (text[i : i + 3] == p).all()]
            assert found.get(k, []) == want


def test_leaks(spark):
    word = [f"w{i}" for i in range(60)]
    item = " ".join(word)
    de = "Straße über Ärger und Öl mit großem Fuß bleibt heute ganz offen für alle"
    zh = "请阅读下面的记录并回答问题文件表在每个会话中一次替换最短路径符号索引按文件顺序丢弃重复的边"
    docs = [
        (1, f"before. {item} after"), (2, "// " + "\n// ".join(" ".join(word[i : i + 7]).upper() for i in range(0, 60, 7))), (3, " ".join(word[:29])), (4, " ".join(word[:30])),
        (5, " ".join(" ".join([*word[i : i + 7], "gap"]) for i in range(0, 60, 7))), (6, " ".join(f"**{w}**" if i % 3 else f"<em>{w}</em>" for i, w in enumerate(word))),
        (7, unicodedata.normalize("NFD", de).upper()), (8, f"文字 {zh[:12]}\n> {zh[12:]}"), (9, zh[:19]), (10, None), (11, "  "), (12, item), (13, " ".join(word[40:] + ["x"] + word[:15]))]
    items = [(100, "cause", "en", item), (101, "order", "de", de), (102, "order", "zh", zh), (103, "order", "en", "too short"), (104, None, None, None), (105, "cause", "en", item), (106, "order", None, zh), (107, "order", "en", zh)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, task string, lang string, text string")
    want = {(i, k) for i in (1, 2, 4, 6, 12, 13) for k in (100, 105)} | {(7, 101), (8, 102), (8, 106), (8, 107)}
    for shard, block in ((10**6, 10**6), (50, 100)):
        got = leakage.leaks(d, e, shard, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    spans = next(r["spans"] for r in got if r["doc_id"] == 1)
    assert [docs[0][1][s["start_pos"] : s["end_pos"]] for s in spans] == [item]
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, "t", "en", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 40)))) for i in range(30)]
    docs = []
    for i in range(120):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 20)))]
        for _ in range(rnd.randint(0, 3)):
            ws = rnd.choice(items)[3].split()
            a = rnd.randrange(len(ws))
            parts.append(" ".join(ws[a : a + rnd.randint(5, 30)]))
        docs.append((i, " ".join(parts)))
    want = set()
    for i, text in docs:
        ws = text.split()
        have = {tuple(ws[j : j + 8]) for j in range(len(ws) - 7)}
        for k, _, _, x in items:
            xs = x.split()
            hit = [False] * len(xs)
            for j in range(len(xs) - 7):
                if tuple(xs[j : j + 8]) in have:
                    hit[j : j + 8] = [True] * 8
            if 2 * sum(hit) >= len(xs):
                want.add((i, k))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, task string, lang string, text string"), 300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want


# ---- p8


@pytest.mark.parametrize("text,want", [
    ("One. Two.", ["One.", "Two."]), (None, []), (" \n ", []), ("No end", ["No end"]), ("See e.g. A.run() or B.close() etc. for more. Then go.", ["See e.g. A.run() or B.close() etc. for more.", "Then go."]),
    ("The total is 97.9. As long", ["The total is 97.9.", "As long"]), ("J. P. Ondrell's patch, rev. 61, was lost. Well... no. A", ["J. P. Ondrell's patch, rev. 61, was lost.", "Well... no.", "A"]),
    ("He wrote “Why twice? Once is enough.” and left. Ok.", ["He wrote “Why twice? Once is enough.” and left.", "Ok."]), ("It ended with “no edge left.” A slice", ["It ended with “no edge left.”", "A slice"]),
    ("Am 7. März stieg der Wert. Der 9. Lauf", ["Am 7. März stieg der Wert.", "Der 9. Lauf"]), ("Das kostet z. B. 24,1 Sekunden, d. h. viel. Gut.", ["Das kostet z. B. 24,1 Sekunden, d. h. viel.", "Gut."]),
    ("« Stop. Rechargez d'abord. » disait le journal. Bon.", ["« Stop. Rechargez d'abord. » disait le journal.", "Bon."]), ("Удаляются имена и т. д. Версия 2.", ["Удаляются имена и т. д.", "Версия 2."]),
    ("他说：“甲每次被调用。”边有四条。日志里写着“停下。先加载。”然后结束了。", ["他说：“甲每次被调用。”", "边有四条。", "日志里写着“停下。先加载。”然后结束了。"]), ("彼は「なぜ？」と書いた。「四回呼ばれる。」解析器は分ける。", ["彼は「なぜ？」と書いた。", "「四回呼ばれる。」", "解析器は分ける。"]),
    ("รายการหนึ่ง รายการสอง\nสาม", ["รายการหนึ่ง", "รายการสอง", "สาม"]), ("एक बात। दूसरी बात।", ["एक बात।", "दूसरी बात।"]), ("# Head on\nText here.", ["Head on", "Text here."]),
    ("- One item. More of it.\n- Two", ["One item.", "More of it.", "Two"]), ("1. A\n2. B", ["A", "B"]), ("Step\n9. of the plan came.", ["Step\n9. of the plan came."]), ("a\r\n\r\nb", ["a", "b"]),
    ("Intro.\n```java\nx.y(); // a. B\n\nz\n```\nEnd.", ["Intro.", "```java\nx.y(); // a. B\n\nz\n```", "End."]), ("> One line\n> goes on. Two", ["One line\n> goes on.", "Two"]), ("```\nopen. End", ["```\nopen. End"]),
    ("It stays open.The reviewer left", ["It stays open.", "The reviewer left"]), ("(It works.) Next", ["(It works.)", "Next"]), ("read the record below and then answer it. a slice drops the path.", ["read the record below and then answer it.", "a slice drops the path."]),
    ("¿Para qué? ¡Qué lío!", ["¿Para qué?", "¡Qué lío!"]), ("It shipped at 7 p.m. on a Friday. runProbe is called.", ["It shipped at 7 p.m. on a Friday.", "runProbe is called."])])
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


def test_sentences_of_any_text():
    rnd = random.Random(8)
    alphabet = "ab AB.!?。“”\"«»()\n\r>#-*`1 9…ไท文かаЯ́’'"
    for _ in range(800):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        spans = sentences.units(text)
        assert all(a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans), text
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])), text
    assert len(sentences.units("One thing. " * 20_000)) == 20_000
    assert sentences.units("a. " * 3000)


def test_long_quotations_stay_whole():
    quoted = "He wrote “" + "why twice? Once is enough. " * 300 + "” and left."
    text = quoted + " Ok."
    assert [text[a:b] for a, b in sentences.units(text)] == [quoted, "Ok."]


@pytest.mark.parametrize("seed", range(30))
def test_spans_against_all_starts(seed):
    """The best sequence of spans with every start tried, over texts with long and short stretches."""
    rnd = random.Random(seed)
    n = rnd.choice([300, 3000, 30_000])
    cuts = [sentences._Cut(c, rnd.choice([-6.0, -1.0, 0.5, 0.0, 0.4, 2.0, 5.0][: rnd.choice([3, 5, 7])]), rnd.choice([-5.0, -1.0, 0.0, 1.5]), rnd.random() < 0.3, rnd.random() < 0.2) for c in sorted(rnd.sample(range(1, n), 120))]
    pairs = sorted((a, a + rnd.randrange(1, n - a)) for a in rnd.sample(range(n - 1), rnd.choice([0, 2])))
    ends = [0] + [c.at for c in cuts] + [n]
    broken = [sum(a < e <= b for a, b in pairs) for e in ends]

    def value(i, j):
        end = cuts[j - 1] if j <= len(cuts) else None
        begin = cuts[i - 1] if i else None
        return sentences.span_score(ends[j] - ends[i], begin.opening if begin else 0.0, bool(begin and begin.inverted), end.closing if end else 0.0, end.asks if end else True, broken[j] if end else 0)

    total = [0.0]
    for j in range(1, len(ends)):
        total.append(max(total[i] + value(i, j) for i in range(j)))
    spans = sentences._best(n, cuts, pairs, False, True)
    at = {e: k for k, e in enumerate(ends)}
    assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(value(at[a], at[b]) for a, b in spans) == pytest.approx(total[-1])


def one_by_one(text):
    """What cutting wherever a cut alone seems right would give."""
    got = []
    real = sentences._best

    def greedy(n, cuts, found, inverted=False, asks=False):
        kept = [c.at for c in cuts if c.closing + c.opening - sentences.OPEN_PAIR * sum(a < c.at <= b for a, b in found) > 0]
        return list(zip([0, *kept], [*kept, n]))

    sentences._best = greedy
    try:
        got = [text[a:b] for a, b in sentences.units(text)]
    finally:
        sentences._best = real
    return got


@pytest.mark.parametrize("text,want", [
    ("The patch came at 5 p.m. U.S. Army bases were shut by then.", ["The patch came at 5 p.m.", "U.S. Army bases were shut by then."]),
    ("He moved to the U.K. U.S. Steel hired Ann.", ["He moved to the U.K.", "U.S. Steel hired Ann."]),
    ("¿Lo firmó Acme Inc. Madrid? Nadie más firmó.", ["¿Lo firmó Acme Inc. Madrid?", "Nadie más firmó."]),
    ("¡Llegó a las 7 a.m. María! Qué bien.", ["¡Llegó a las 7 a.m. María!", "Qué bien."])])
def test_spans_are_scored_jointly(text, want):
    """Each of these cuts alone would be accepted; only length, opening and closing of whole spans together decide."""
    assert [text[a:b] for a, b in sentences.units(text)] == want
    assert one_by_one(text) != want


@pytest.mark.parametrize("text,want", [
    ("It was signed by Acme Corp. Inc. Nobody else signed it.", ["It was signed by Acme Corp. Inc.", "Nobody else signed it."]),
    ("They ship to the U.S. D.C. Warehouses open on Monday.", ["They ship to the U.S. D.C.", "Warehouses open on Monday."]),
    ('The 15" panel broke. He said "Stop. Wait." and left. Ok.', ['The 15" panel broke.', 'He said "Stop. Wait." and left.', "Ok."]),
    ("See com.example.deeply.nested.packagename.ClassNameThatIsVeryLongIndeedSoThatNoWindowHoldsIt.method. Then go.", ["See com.example.deeply.nested.packagename.ClassNameThatIsVeryLongIndeedSoThatNoWindowHoldsIt.method.", "Then go."])])
def test_marks_and_long_tokens(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


@pytest.mark.parametrize("text", ["(" * 1_000_000, "“([" * 20_000 + "a. B" * 20_000, "a." * 100_000, "etc. " * 50_000, 'a". ' * 50_000, "x" * 500_000 + ". Y"])
def test_long_odd_texts_take_linear_time(text):
    import time

    began = time.perf_counter()
    sentences.units(text)
    assert time.perf_counter() - began < 6  # quadratic work would take minutes


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", 9), (1, "One. Two.", 9), (None, "x", 1), (2, None, 1)], "doc_id bigint, text string, start_pos int")
    assert sorted(tuple(r) for r in sentences.sentence_units(df).collect()) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]


def test_no_other_module_needs_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "loomstone"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "loomstone.llm" in p.read_text()]


def test_production_tables_are_whole(spark):
    """Every document with text has units, and every non-blank text a container."""
    docs = table(spark, SF, "documents").where(F.col("text").rlike(r"[^\s]"))
    assert llm.p8_found(spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert llm.p6_assignment(spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
