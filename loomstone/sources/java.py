"""Parse-only extraction of facts from Java source text: text units, declarations, use sites.

A tokenizer and a declaration parser; nothing is resolved. ``facts`` runs once per file in Arrow batches and gives
all projections and what went wrong; no file leaves its partition. Text that does not parse gives what could be read
before the fault, and the fault.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.runtime import spread

_TOKEN = re.compile(
    r'(?P<text>"""(?:\\.|(?!""").)*(?:"""|\Z))|(?P<string>"(?:\\.|[^"\\\r\n])*"?)|(?P<char>\'(?:\\.|[^\'\\\r\n])*\'?)'
    r"|(?P<line>//[^\r\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<ident>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<op>::|->|\.\.\.|[-+*/%&|^=<>!]=?|\S)", re.S)
_EOL = re.compile(r"\r\n|\n|\r")

# Reserved words of the language.
KEYWORDS = set(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import
    instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try
    void volatile while true false null yield""".split()
)
PRIMITIVES = set("boolean byte char double float int long short void".split())
MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())


class Source:
    """Tokens of one file with their places."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0, *(m.end() for m in _EOL.finditer(text))]
        self.code: list[tuple[str, str, int, int]] = []  # (kind, text, start, end) without comments
        self.comments: list[tuple[str, int, int]] = []
        self.lead: dict[int, int] = {}  # code token -> the last comment before it
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind in ("line", "block"):
                self.comments.append((kind, m.start(), m.end()))
            else:
                if self.comments and (not self.code or self.comments[-1][1] >= self.code[-1][3]):
                    self.lead[len(self.code)] = len(self.comments) - 1
                self.code.append((kind, m[0], m.start(), m.end()))

    def place(self, pos: int) -> tuple[int, int]:
        line = bisect_right(self.starts, pos)
        return line, pos - self.starts[line - 1] + 1

    def span(self, a: int, b: int) -> dict[str, int]:
        (sl, sc), (el, ec) = self.place(a), self.place(b - 1)
        return {"start_line": sl, "start_col": sc, "end_line": el, "end_col": ec}

    def line_start(self, pos: int) -> int:
        """The start of the line if only white space stands before ``pos`` on it, else ``pos``."""
        a = self.starts[bisect_right(self.starts, pos) - 1]
        return a if not self.text[a:pos].strip() else pos


def text_units(src: Source) -> Iterator[tuple[str, dict, str]]:
    """(kind, range, text) of literals and comments, text without delimiters, in the order of the file."""
    found = []
    for kind, a, b in src.comments:
        raw = src.text[a:b]
        if kind == "line":
            found.append((a, "COMMENT", b, raw[2:]))
        elif raw.startswith("/**") and len(raw) > 4:
            found.append((a, "JAVADOC", b, raw[3:-2]))
        else:
            found.append((a, "COMMENT", b, raw[2:-2]))
    for kind, raw, a, b in src.code:
        if kind == "text":
            found.append((a, "STRING_LITERAL", b, raw[3:-3]))
        elif kind == "string":
            found.append((a, "STRING_LITERAL", b, raw[1:-1]))
    for a, kind, b, text in sorted(found):
        yield kind, src.span(a, b), text


class Parser:
    """Declarations of one file as flat rows, in the order they begin."""

    def __init__(self, src: Source) -> None:
        self.src, self.t, self.i, self.rows = src, src.code, 0, []
        self.names: set[int] = set()  # tokens that name a declaration
        self.failure: str | None = None
        self.line_comments = [a for k, a, _ in src.comments if k == "line"]
        try:
            self._unit()
        except IndexError:
            open_ = [r["name"] for r in self.rows if not r["end_line"]]
            self.failure = "the text ends inside " + (f"the declaration of {open_[-1]}" if open_ else "a declaration")
            for row in self.rows:  # what is still open reaches to the end of the text
                if not row["end_line"]:
                    row["end_line"], row["end_col"] = src.place(max(0, len(src.text) - 1))

    def _is(self, s: str, k: int = 0) -> bool:
        return self.i + k < len(self.t) and self.t[self.i + k][1] == s and self.t[self.i + k][0] in ("op", "ident")

    def _skip(self, opener: str, closer: str) -> None:
        """From ``opener`` to behind its partner."""
        depth = 0
        while True:
            s = self.t[self.i][1] if self.t[self.i][0] == "op" else ""
            self.i += 1
            depth += (s == opener) - (s == closer)
            if depth == 0:
                return

    def _annotation(self) -> None:
        self.i += 1
        self._name()
        if self._is("("):
            self._skip("(", ")")

    def _name(self) -> None:
        self.i += 1
        while self._is(".") and self.t[self.i + 1][0] == "ident":
            self.i += 2

    def _unit(self) -> None:
        while self.i < len(self.t):
            if self._is("package") or self._is("import"):
                while not self._is(";"):
                    self.i += 1
                self.i += 1
            elif self._is(";") or self._is("}"):
                self.i += 1
            else:
                self._member(None, "", "")

    def _row(self, first: int, kind: str, name: int, parent: int | None) -> dict:
        self.names.add(name)
        src, doc = self.src, self.src.lead.get(first)
        row = {"decl_no": len(self.rows), "parent_no": parent, "kind": kind, "name": self.t[name][1], "doc_text": None, "doc_start_line": -1, "header_text": "", "start_line": 0,
               "start_col": 0, "end_line": 0, "end_col": 0, "body_inner": None, "has_body": False, "body_has_line_comment": False}
        if doc is not None:
            k, a, b = src.comments[doc]
            if k == "block" and src.text.startswith("/**", a) and b - a > 4:
                row["doc_text"], row["doc_start_line"] = src.text[src.line_start(a) : b], src.place(a)[0]
        row["start_line"], row["start_col"] = src.place(self.t[first][2])
        self.rows.append(row)
        return row

    def _close(self, row: dict, first: int, head_end: int, body: tuple[int, int] | None, last: int) -> None:
        """Header up to ``head_end`` (an offset), body between two braces (token numbers), ``last`` token of the declaration."""
        src = self.src
        row["header_text"] = src.text[src.line_start(self.t[first][2]) : head_end].rstrip()
        row["end_line"], row["end_col"] = src.place(self.t[last][3] - 1)
        if body:
            a, b = self.t[body[0]][3], self.t[body[1]][2]
            row["has_body"] = True
            row["body_inner"] = src.text[a:b]
            row["body_has_line_comment"] = bisect_left(self.line_comments, a) < bisect_left(self.line_comments, b)

    def _member(self, parent: int | None, owner: str, owner_kind: str) -> None:
        first = self.i
        while self._is("@") and not self._is("interface", 1) or self.t[self.i][1] in MODIFIERS and self.t[self.i][0] == "ident" or self._is("non") or self._is("-"):
            self._annotation() if self._is("@") else self._advance()
        word = self.t[self.i][1]
        if self._is("@") or word in ("class", "interface", "enum") or (word == "record" and self.t[self.i + 1][0] == "ident" and self.t[self.i + 2][1] in "(<"):
            self._type(first, parent)
            return
        if self._is("{"):
            self._skip("{", "}")
            return
        if self._is("<"):
            self._skip("<", ">")
        angle, start = 0, self.i
        while True:
            s = self.t[self.i][1]
            angle += (s == "<") - (s == ">")
            if angle == 0 and self.t[self.i][0] == "op" and s in "(=;,{":
                break
            self.i += 1
        name = self.i - 1
        if self._is("{"):  # a compact constructor is no declaration of its own
            self._skip("{", "}")
            return
        if self._is("("):
            kind = "CONSTRUCTOR" if name == start and self.t[name][1] == owner else "METHOD"
            row = self._row(first, kind, name, parent)
            self._skip("(", ")")
            while not (self._is("{") or self._is(";")):
                self.i += 1
            if self._is(";"):
                self.i += 1
                self._close(row, first, self.t[self.i - 1][3], None, self.i - 1)
                return
            body = self.i
            self._skip("{", "}")
            self._close(row, first, self.t[body][2], (body, self.i - 1), self.i - 1)
            return
        rows = []
        while True:  # declarators of a field
            rows.append(self._row(first, "FIELD", name, parent))
            depth = 0
            while not (depth == 0 and self.t[self.i][0] == "op" and self.t[self.i][1] in ",;"):
                s = self.t[self.i][1] if self.t[self.i][0] == "op" else ""
                depth += (s in "([{") - (s in ")]}") if s else 0
                self.i += 1
            end = self.t[self.i][1] == ";"
            self.i += 1
            if end:
                break
            name = self.i
        for row in rows:
            self._close(row, first, self.t[self.i - 1][3], None, self.i - 1)

    def _advance(self) -> None:
        self.i += 1

    def _type(self, first: int, parent: int | None) -> None:
        kind = self.t[self.i][1].upper()
        if kind == "@":
            kind, self.i = "ANNOTATION", self.i + 1
        self.i += 1
        name = self.i
        row = self._row(first, kind, name, parent)
        no = row["decl_no"]
        if kind == "RECORD":
            while not self._is("("):
                self.i += 1
            self._components(no)
        while not self._is("{"):
            self.i += 1
        body = self.i
        self.i += 1
        if kind == "ENUM":
            self._constants(no)
        while not self._is("}"):
            if self._is(";"):
                self.i += 1
            else:
                self._member(no, self.t[name][1], kind)
        self.i += 1
        self._close(row, first, self.t[body][2], None, self.i - 1)

    def _components(self, parent: int) -> None:
        """Record components are fields."""
        self.i += 1
        while not self._is(")"):
            first, depth = self.i, 0
            while not (depth == 0 and (self._is(",") or self._is(")"))):
                s = self.t[self.i][1] if self.t[self.i][0] == "op" else ""
                depth += (s in "<([") - (s in ">)]") if s else 0
                self.i += 1
            row = self._row(first, "FIELD", self.i - 1, parent)
            self._close(row, first, self.t[self.i - 1][3], None, self.i - 1)
            row["header_text"], row["component"] = self.src.text[self.t[first][2] : self.t[self.i - 1][3]], True
            if self._is(","):
                self.i += 1
        self.i += 1

    def _constants(self, parent: int) -> None:
        while not (self._is(";") or self._is("}")):
            first = self.i
            while self._is("@"):
                self._annotation()
            name = self.i
            row = self._row(first, "ENUM_CONSTANT", name, parent)
            self.i += 1
            if self._is("("):
                self._skip("(", ")")
            head, body = self.t[self.i - 1][3], None
            if self._is("{"):
                a = self.i
                self._skip("{", "}")
                body = (a, self.i - 1)
            self._close(row, first, head, body, self.i - 1)
            if self._is(","):
                self.i += 1


def skim_rows(parser: Parser) -> list[dict]:
    """Declarations without record components, which the outline has, numbered anew."""
    rows = [r for r in parser.rows if "component" not in r]
    number = {r["decl_no"]: i for i, r in enumerate(rows)}
    return [{**r, "decl_no": i, "parent_no": number.get(r["parent_no"])} for i, r in enumerate(rows)]


def use_sites(src: Source, parser: Parser) -> Iterator[tuple[str, str, dict]]:
    """(kind, target_name, range) of use sites by their shape: calls, instantiations, method references, annotations, field accesses, type mentions."""
    t = src.code
    skip_to = 0
    for i, (kind, s, a, b) in enumerate(t):
        if kind != "ident" or i < skip_to or i in parser.names or s in KEYWORDS:
            if s in ("import", "package") and kind == "ident":
                skip_to = next((k for k in range(i, len(t)) if t[k][1] == ";"), len(t))
            continue
        before = t[i - 1][1] if i else ""
        after = t[i + 1][1] if i + 1 < len(t) else ""
        what = None
        if before == "@":
            what = "ANNOTATION"
        elif before == "new":
            k = i + 1
            if after == "<":
                depth = 0
                while k < len(t):
                    depth += (t[k][1] == "<") - (t[k][1] == ">")
                    k += 1
                    if depth == 0:
                        break
            if k < len(t) and t[k][1] == "(":
                yield "INSTANTIATION", s, src.span(a, b)
            what = "TYPE_REF"
        elif before == "::":
            what = "METHOD_REF"
        elif after == "(":
            what = "CALL" if before != "new" else None
        elif before == ".":
            what = "FIELD_ACCESS" if after != "(" else None
        elif s[:1].isupper() and after != "." and (after in ("<", ",", ">", "{", "...", "[", ")", "::", "&", ";", "=") or (i + 1 < len(t) and t[i + 1][0] == "ident")):
            typed = i + 1 < len(t) and t[i + 1][0] == "ident" and after not in ("instanceof",)
            if typed or before in ("extends", "implements", "throws", "<", ",", "instanceof", "&", "(", "|") or after == "::":
                what = "TYPE_REF"
        if what:
            yield what, s, src.span(a, b)


_RANGE = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
_SKIM = (
    "decl_no int, parent_no int, kind string, name string, doc_text string, doc_start_line int, header_text string, start_line int, end_line int, body_inner string, "
    "has_body boolean, body_has_line_comment boolean")
#: The projections of one parse and their columns.
PROJECTIONS = {
    "text_units": f"kind string, range {_RANGE}, text string", "usages": f"kind string, target_name string, range {_RANGE}", "skim_decls": _SKIM,
    "outline": f"decl_no int, parent_no int, kind string, name string, range {_RANGE}",
}


def _names(columns: str) -> list[str]:
    return [c.strip().split()[0] for c in re.sub(r"<[^<>]*>", "", columns).split(",")]


def _place(row: dict) -> dict:
    return {k: row[k] for k in ("start_line", "start_col", "end_line", "end_col")}


def parse(text: str, wanted: tuple[str, ...]) -> tuple[dict[str, list[dict]], str | None]:
    """The wanted projections of one text from one tokenization and one parse, and the failure if it does not parse."""
    src = Source(text)
    parser = Parser(src) if set(wanted) - {"text_units"} else None
    make: dict[str, Callable[[], list[dict]]] = {
        "text_units": lambda: [{"kind": k, "range": r, "text": x} for k, r, x in text_units(src)],
        "usages": lambda: [{"kind": k, "target_name": n, "range": r} for k, n, r in use_sites(src, parser)],
        "skim_decls": lambda: skim_rows(parser),
        "outline": lambda: [{**r, "range": _place(r)} for r in parser.rows],
    }
    return {w: make[w]() for w in wanted}, parser.failure if parser else None


def facts(source_files: DataFrame, wanted: tuple[str, ...] = tuple(PROJECTIONS)) -> DataFrame:
    """file_id, an array for each wanted projection, failure (null for files that parse): one row per stored file.

    A file's facts are bounded by its size. Null texts give no row. ``projection`` unfolds one of them.
    """
    keep = {w: _names(PROJECTIONS[w]) for w in wanted}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse(text, wanted) for text in f["text"]]
            out = {"file_id": f["file_id"]} | {w: [[{c: r[c] for c in keep[w]} for r in found[w]] for found, _ in parsed] for w in wanted}
            yield pd.DataFrame(out | {"failure": [failure for _, failure in parsed]})

    def struct(columns: str) -> str:
        return "array<struct<" + re.sub(r"(\w+) (int|string|boolean|struct)", r"\1:\2", columns) + ">>"

    one = spread(source_files.where(F.col("text").isNotNull()).select("file_id", "text"), "file_id")
    return one.mapInPandas(run, "file_id bigint, " + ", ".join(f"{w} {struct(PROJECTIONS[w])}" for w in wanted) + ", failure string")


def projection(found: DataFrame, name: str) -> DataFrame:
    """The rows of one projection of ``facts``; repeats count once."""
    return found.select("file_id", F.explode(name).alias("r")).select("file_id", "r.*").distinct()


def extract_text(source_files: DataFrame) -> DataFrame:
    """Text units of every file; null texts give none, repeats count once."""
    return projection(facts(source_files, ("text_units",)), "text_units")


def extract_usages(source_files: DataFrame) -> DataFrame:
    """Use sites of every file."""
    return projection(facts(source_files, ("usages",)), "usages")


def extract_skim(source_files: DataFrame) -> DataFrame:
    """Declarations of every file with their verbatim documentation, header and body."""
    return projection(facts(source_files, ("skim_decls",)), "skim_decls")


def extract_outline(source_files: DataFrame) -> DataFrame:
    """file_id, decl_no, parent_no, kind, name, range: the declaration trees."""
    return projection(facts(source_files, ("outline",)), "outline")
