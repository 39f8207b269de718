"""Methods and constructors paired with what their documentation says.

1. Each documented or documentable declaration is cleaned once, in Arrow batches: tags, marks,
   links and code go; what remains must say something beyond the words of the declaration.
2. Declarations meet their symbol by file and line, which gives the owning type and the
   name and parameter types that overriding methods share.
3. Every open section of a method's documentation (no main description, a missing ``@param`` or
   ``@return``, or ``{@inheritDoc}`` in any) climbs the type hierarchy, one join per level for all of
   them together, until an overridden method has that section. What is still unresolved at the top
   stays empty, and methods that then say nothing are dropped.

An overridden method has the same name and number of parameters, and each parameter type is written alike, or
alike but for its package, or is a type variable there; one that is written alike throughout is preferred.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import strip_space
from loomstone.llm import prose
from loomstone.runtime import cut, spread

# Words that would fit any method or constructor.
GENERIC = set(
    """a an the of to in on for with by from as at and or is are be it its this that these those which who whose we you i
    method methods function functions constructor constructors ctor class classes type types interface object objects instance instances implementation implementations
    implements getter getters setter setters accessor mutator default creates create created creating constructs construct constructed builds new returns return returned
    gets get sets set result results value values param params parameter parameters argument arguments given specified provided supplied passed corresponding current auto autogenerated
    generated todo fixme xxx docs doc documentation documented document javadoc non comment comments missing description describe undocumented tbd na none see same super parent inherited
    override overrides overridden overriding call calls called invoke invokes executes execute performs perform does do something stuff thing things work works job handles handle helper utility
    here above below void any some member operation operations action actions details public private protected static final used use uses using initializes initialize initialises
    konstruktor methode funktion standardkonstruktor klasse constructeur méthode fonction classe método función clase метод конструктор функция класс геттер сеттер
    मेथड कंस्ट्रक्टर फ़ंक्शन""".split()
)
_GENERIC_UNSPACED = regex.compile("构造函数|构造方法|构造器|默认|方法|函数|实现|返回|获取|设置|自动生成|コンストラクタ[ー]?|メソッド|関数|デフォルト|ゲッター[ー]?|セッター[ー]?|自動生成|実装|คอนสตรัคเตอร์|เมธอด|ฟังก์ชัน|ตัวสร้าง")

_LITERALS = regex.compile(r'"""(?:\\.|(?!""").)*"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|(//[^\n\r]*|/\*.*?(?:\*/|$))', regex.S)
_IDENT = regex.compile(r"[\p{L}_$][\p{L}\p{N}_$]*")
_CAMEL = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|[\p{Lo}\p{M}]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_INHERIT = regex.compile(r"\{@inheritDoc\s*\}", regex.I)
_PARAMS = regex.compile(r"(?s)([\w\]>]+)\s+[\p{L}_$][\w$]*\s*\(((?:[^()]|\([^()]*\))*)\)[^()]*$")
_LAST_NAME = regex.compile(r"([\p{L}_$][\p{L}\p{N}_$]*)\s*$")


def has_statement(body: str | None) -> bool:
    """Whether a body holds anything but comments, white space and lone semicolons; comment marks within literals are none."""
    if not body:
        return False
    return bool(_LITERALS.sub(lambda m: "" if m[1] else "''", body).strip(" \t\r\n\f;"))


@cache
def _stem(word: str) -> str:
    w = word.casefold()
    for end, to in (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: len(w) - len(end)] + to
            break
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def _own(*texts: str | None) -> set[str]:
    out = set()
    for text in texts:
        for ident in _IDENT.findall(text or ""):
            out.add(ident.casefold())
            out.update(_stem(p) for p in _CAMEL.findall(ident))
    return out


def sections(doc: str) -> dict[str, str]:
    """Words of each section of a documentation comment by tag ('' is the main description); \u0002 stands for ``{@inheritDoc}``."""
    out: dict[str, str] = {}
    for tag, words in prose.blocks(_INHERIT.sub(" \u0002 ", doc), names=True):
        text = " ".join(t for t in words.replace("\u0001", " ").split() if t != "/")
        out[tag] = f"{out[tag]} {text}" if tag in out else text
    return out


def shown(parts: dict[str, str]) -> str:
    """A description from its sections."""
    return " ".join(f"@{tag} {words}" if tag else words for tag, words in parts.items()).replace("\u0002", " ")


def describe(doc: str | None, name: str | None, header: str | None) -> tuple[str, bool]:
    """(cleaned description, whether it says something beyond the declaration's own words)."""
    if not doc or not doc.strip():
        return "", False
    parts = sections(doc)
    return " ".join(shown(parts).split()), says(parts, name, header)


def says(parts: dict[str, str], name: str | None, header: str | None) -> bool:
    own = _own(name, header)
    for text in parts.values():
        unspaced = prose._UNSPACED.findall(_GENERIC_UNSPACED.sub("", text))
        if len(unspaced) >= 3:
            return True
        tokens, _ = prose.words_of(text)
        if len(tokens) < 2:
            continue
        lang = "ru" if prose._CYRILLIC.search(text) else "hi" if prose._DEVANAGARI.search(text) else prose._latin(text)
        idle = GENERIC if lang == "en" else GENERIC | set(prose.FUNCTION_WORDS[lang].split())
        for w in _WORD.findall(" ".join(tokens)):
            low = w.casefold()
            if len(low) > 1 and low not in idle and low not in own and _stem(low) not in own:
                return True
    return False


def open_sections(parts: dict[str, str], header: str | None, kind: str) -> list[str]:
    """Sections that a method may inherit: what is missing, or holds ``{@inheritDoc}``."""
    if kind != "METHOD":
        return []
    out = [tag for tag, words in parts.items() if "\u0002" in words]
    if "" not in parts:
        out.append("")
    m = _PARAMS.search(header or "")
    for p in (m[2].split(",") if m else ()):
        if (name := _LAST_NAME.search(p)) and f"param {name[1]}" not in parts:
            out.append(f"param {name[1]}")
    if m and m[1] != "void" and "return" not in parts:
        out.append("return")
    return out


def _clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        parts = [sections(d) if d and d.strip() else {} for d in f["doc_text"]]
        yield f[["file_id", "decl_no", "kind", "name", "start_line"]].assign(
            body=[has_statement(b) for b in f["body_inner"]], parts=parts, says=[bool(p) and says(p, n, h) for p, n, h in zip(parts, f["name"], f["header_text"])],
            open=[open_sections(p, h, k) for p, h, k in zip(parts, f["header_text"], f["kind"])])


def _methods(skim: DataFrame) -> DataFrame:
    m = skim.where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).select("file_id", "decl_no", "kind", "name", "doc_text", "header_text", "body_inner", "start_line")
    return spread(m.dropna(subset=["file_id", "decl_no", "start_line"]), "file_id", "decl_no")


def cleaned(skim: DataFrame) -> DataFrame:
    """file_id, decl_no, kind, name, start_line, body, parts, says, open of each method or constructor; repeats give repeats."""
    return _methods(skim).mapInPandas(_clean, "file_id bigint, decl_no int, kind string, name string, start_line int, body boolean, parts map<string,string>, says boolean, open array<string>")


def _say(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [bool(d) and has_statement(b) and describe(d, n, h)[1] for d, b, n, h in zip(f["doc_text"], f["body_inner"], f["name"], f["header_text"])]
        yield f.loc[keep, ["file_id", "start_line"]]


def speaking(skim: DataFrame) -> DataFrame:
    """file_id, start_line of every method or constructor whose own documentation says something: the first step of ``pairs``, which these rows pass and need no other.

    Only these two numbers leave the map tasks.
    """
    return _methods(skim.where(F.col("doc_text").isNotNull() & F.col("body_inner").isNotNull())).mapInPandas(_say, "file_id bigint, start_line int").distinct()


def _key(c) -> Column:
    """A 16-byte stand-in for a long moniker in joins."""
    return F.unhex(F.md5(c))


def _params(tail: Column) -> Column:
    """Parameter types without packages, from a moniker's ``name(types).``."""
    inner = F.regexp_extract(tail, r"\((.*)\)\.?$", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda t: F.regexp_replace(F.trim(t), r"^.*\.", "")))


def described(skim: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, decl_no, start_line, kind, name, description, origin, source: what ``pairs`` gives, without the code."""
    decls = cut(cleaned(skim))
    # Types of the repository with a supertype in it; no other type can pass documentation on.
    up = edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS") & ~F.col("dst").startswith("~")).where("src <> dst")
    up = cut(up.select(_key("src").alias("owner"), _key("dst").alias("above")).distinct())
    related = up.select("owner").union(up.select("above")).distinct()
    tail = F.regexp_extract("moniker", r"([^#/]*)$", 1)
    owner = F.expr("substring(moniker, 1, length(moniker) - length(regexp_extract(moniker, '([^#/]*)$', 1)))")
    placed = symbols.where((F.col("kind") == "METHOD") & (F.col("file_id") >= 0)).select(
        "file_id", F.col("range.start_line").alias("start_line"), F.regexp_extract(tail, r"^([^(]*)", 1).alias("plain"), _key(owner).alias("owner"), _params(tail).alias("params"))
    placed = placed.join(related, "owner", "left_semi").distinct()
    tells = F.when(F.col("says"), F.array_sort(F.map_keys(F.map_filter("parts", lambda _, words: ~F.contains(words, F.lit("\u0002"))))))
    methods = decls.where(F.col("kind") == "METHOD").select("file_id", "decl_no", "start_line", strip_space(F.col("name")).alias("plain"), "body", "open", tells.alias("tells"))
    methods = methods.join(placed, ["file_id", "start_line", "plain"])
    first = F.min(F.struct("owner", "params", "plain"))  # of several declarations in one place the least
    methods = cut(methods.groupBy("file_id", "decl_no").agg(first.alias("at"), F.max("body").alias("body"), F.max("open").alias("open"), F.max("tells").alias("tells")).select(
        "file_id", "decl_no", "at.owner", "at.params", F.xxhash64("at.plain", F.size("at.params")).alias("called"), "body", "open", "tells"))
    # What an overridden method can give: its sections with words of their own, which stay behind until it is known who takes them.
    told = methods.join(up.select(F.col("above").alias("owner")).distinct(), "owner", "left_semi")
    told = cut(told.select(F.col("owner").alias("above"), "called", F.explode("tells").alias("section"), F.col("params").alias("theirs"), F.struct(F.col("file_id").alias("f"), F.col("decl_no").alias("n")).alias("from")))
    wanted = ["file_id", "decl_no", "section"]
    carried = [*wanted, "owner", "called", "params"]
    still = methods.where("body").select("file_id", "decl_no", "owner", "called", "params", F.explode("open").alias("section"))
    alike = F.forall(F.arrays_zip("params", "theirs"), lambda p: (p["params"] == p["theirs"]) | p["theirs"].rlike("^[A-Z][A-Z0-9]?$"))
    offer = F.min(F.when(alike, F.struct((F.col("params") != F.col("theirs")).alias("differs"), "from")))["from"]
    # The types one level further above each type that has an open section, each met once; then what their methods give.
    walk, seen, answers = up, None, None
    while True:
        walk = walk.join(still.select("owner"), "owner", "left_semi")
        if seen is not None:
            walk = walk.withColumnRenamed("above", "via").join(up.select(F.col("owner").alias("via"), "above"), "via").select("owner", "above").where("owner <> above").distinct().join(seen, ["owner", "above"], "left_anti")
        walk = cut(walk, rows=F.count(F.lit(1)))
        if not walk.counts["rows"]:
            break
        seen = walk if seen is None else seen.unionByName(walk)
        level = still.join(walk, "owner").join(told, ["above", "called", "section"], "left").groupBy(*carried).agg(offer.alias("from"))
        level = cut(level, open=F.count_if(F.col("from").isNull()))
        hit = level.where(F.col("from").isNotNull()).select(*wanted, "from.f", "from.n")
        answers = hit if answers is None else answers.unionByName(hit)
        if not level.counts["open"]:
            break
        still = level.where(F.col("from").isNull()).select(*carried)
    shown_ = ["file_id", "decl_no", "start_line", "kind", "name"]
    none = F.lit(None).cast("map<string,struct<f:bigint,n:int,words:string>>").alias("given")
    rows = decls.where("body").select(*shown_, "parts", "says")
    if answers is None:
        found = rows.where("says").select("*", none)
    else:
        words = decls.where("says AND kind = 'METHOD'").select(F.col("file_id").alias("f"), F.col("decl_no").alias("n"), F.explode("parts").alias("section", "words")).where(~F.contains("words", F.lit("\u0002")))
        answers = answers.join(words, ["f", "n", "section"]).groupBy(*wanted, "f", "n").agg(F.min("words").alias("words")).withColumn("from", F.struct("f", "n", "words"))
        given = answers.groupBy("file_id", "decl_no").agg(F.map_from_entries(F.collect_list(F.struct("section", "from"))).alias("given"))
        found = rows.join(given, ["file_id", "decl_no"], "left").where("says OR given IS NOT NULL")
    return found.mapInPandas(_assemble, "file_id bigint, decl_no int, start_line int, kind string, name string, description string, origin string, source string").distinct()


def _assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Own sections with what was inherited put in; a description of inherited words only names its main source."""
    for f in frames:
        texts, origins, sources = [], [], []
        for own, says_, given in zip(f["parts"], f["says"], f["given"]):
            parts, given = dict(own or {}), {} if given is None else dict(given)
            for section in sorted(given):
                words = given[section]["words"]
                parts[section] = parts[section].replace("\u0002", words) if section in parts else words
            texts.append(" ".join(shown(dict(sorted(parts.items(), key=lambda p: p[0] != ""))).split()))
            origins.append("own" if says_ else "inherited")
            at = given[min(given)] if given and not says_ else None
            sources.append(at and f"{at['f']}:{at['n']}")
        yield f[["file_id", "decl_no", "start_line", "kind", "name"]].assign(description=texts, origin=origins, source=sources)


def pairs(skim: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, decl_no, start_line, kind, name, description, origin, source, header_text, body_inner.

    One row for each method or constructor whose body holds a statement and whose documentation says something:
    its own (origin ``own``, source null), with sections it lacks filled in, or only what overridden methods
    give (origin ``inherited``, source = file_id:decl_no of the one that gives the first section). Each section comes from
    the nearest overridden method that has it; at the same distance the one first in the least file wins. Repeated rows count once; null documentation or bodies say nothing;
    declarations without a symbol cannot inherit. Loops in the hierarchy end, since a method visits a
    type once. Empty tables give an empty result.
    """
    code = skim.where(F.col("body_inner").isNotNull()).select("file_id", "decl_no", "start_line", "header_text", "body_inner").dropDuplicates(["file_id", "decl_no", "start_line"])
    return described(skim, symbols, edges).join(code, ["file_id", "decl_no", "start_line"])
