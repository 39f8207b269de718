"""The eight tools of the index: arguments in, bounded text out.

    index = Index.of_tables(symbols, edges, usages, text_units, files, source_files, skim_decls)
    index.call("find_java_references", {"symbol": "Cart.total"})

A tool takes either ``symbol`` or the position ``file``, ``line``, ``col``. Unknown symbols are errors; a search
without hits is an ordinary answer. Every call can be logged and is held to a token budget.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone import schema
from loomstone.operators import closure as cl
from loomstone.operators import graph, match, search, shape
from loomstone.operators.match import SearchSpec


class ToolError(ValueError):
    """Wrong arguments, or a symbol that is not in the index."""


@dataclass
class Index:
    tables: dict[str, DataFrame]
    budget: shape.Budget = field(default_factory=shape.Budget)
    calls: list[dict] = field(default_factory=list)

    @classmethod
    def of_tables(cls, **tables: DataFrame) -> Index:
        return cls(tables)

    def call(self, tool: str, args: dict | None = None) -> str:
        """Runs a tool by name and logs it; errors are raised after they are logged."""
        tools: dict[str, Callable[..., str]] = {
            "search_java_symbols": self.search_symbols, "find_java_definition": self.definition, "find_java_references": self.references, "find_java_supertypes": lambda **k: self.hierarchy(up=True, **k),
            "find_java_subtypes": lambda **k: self.hierarchy(up=False, **k), "grep_java": self.grep, "skim_java": self.skim, "health": self.health}
        if tool not in tools:
            raise ToolError(f"no tool {tool}")
        began, text = time.time(), None
        try:
            text = tools[tool](**(args or {}))
            return text
        except TypeError as e:
            raise ToolError(str(e)) from e
        finally:
            self.calls.append({"ts": began, "tool": tool, "ok": text is not None, "latency_ms": round((time.time() - began) * 1000, 3), "resp_bytes": len((text or "").encode())})

    # ---- selection

    def _select(self, symbol: str | None, file: str | None, line: int | None, col: int | None) -> list:
        """Declarations that a typed name, or a position, stands for."""
        if (symbol is None) == (file is None or line is None or col is None) or (symbol is not None and (file, line, col) != (None, None, None)):
            raise ToolError("give either symbol, or file, line and col")
        if symbol is not None:
            found = graph.select_declarations(self.tables["symbols"], symbol)
        else:
            ids = self.tables["files"].where(F.col("path") == file).select("file_id").distinct()
            uses = graph.use_sites(self.tables["edges"]).join(ids, "file_id", "left_semi").where((F.col("line") == line) & (F.col("col") <= col) & (F.col("end_col") >= col))
            hit = uses.orderBy(F.col("role") != "CALL", F.col("end_col") - F.col("col"), "dst").select("dst").first()
            live = search.live_symbols(self.tables["symbols"])
            if hit:
                found = live.where(F.col("moniker") == hit["dst"])
            else:
                r = F.col("range")
                inside = live.join(ids, "file_id", "left_semi").where((r["start_line"] <= line) & (r["end_line"] >= line))
                found = inside.orderBy(r["end_line"] - r["start_line"], "moniker").limit(1)
        rows = match.with_path(found, self.tables["files"]).orderBy("moniker").collect()
        if not rows:
            raise ToolError(f"no such symbol: {symbol if symbol is not None else f'{file}:{line}:{col}'}")
        return rows

    # ---- tools

    def search_symbols(self, query: str, kind: str | None = None, limit: int = search.DEFAULT_LIMIT, path: str | None = None) -> str:
        if kind and kind.upper() not in schema.SYMBOL_KINDS:
            raise ToolError(f"unknown kind {kind}")
        hits = match.with_path(search.symbol_hits(self.tables["symbols"], SearchSpec(query, fixed=True), kind and kind.upper()), self.tables["files"]).where(match.path_matches(F.col("path"), path)).cache()
        total = hits.count()
        rows = hits.orderBy(*search.rank()).limit(limit).select(shape.render_symbol(F.col("path"), F.col("line"), F.col("kind"), F.col("signature"), F.col("moniker")).alias("x")).collect()
        hits.unpersist()
        return "\n".join([f"No symbols match '{query}'."] if not total else [f"Showing {len(rows)} of {total}", *(r["x"] for r in rows)])

    def definition(self, symbol: str | None = None, file: str | None = None, line: int | None = None, col: int | None = None) -> str:
        rows = self._select(symbol, file, line, col)
        wanted = self.tables["symbols"].where(F.col("moniker").isin([r["moniker"] for r in rows]))
        found = {r["moniker"]: r["snippet"] for r in graph.definitions(wanted, self.tables["source_files"]).collect()}
        return "\n".join(f"{r['path']}:{r['range']['start_line']}  {r['signature'] or r['moniker'].lstrip('~')}\n    {found.get(r['moniker']) or ''}" for r in rows)

    def references(self, symbol: str | None = None, file: str | None = None, line: int | None = None, col: int | None = None) -> str:
        """One section per declaration, and one tail for the simple name they share; details give way to the budget, no file or count does."""
        rows, out = self._select(symbol, file, line, col), []
        refs = match.with_path(graph.confirmed(self.tables["edges"]).where(F.col("dst").isin([r["moniker"] for r in rows])), self.tables["files"]).cache()
        name = next((r["name"] for r in rows if r["name"]), None)
        tail = match.with_path(graph.unconfirmed(self.tables["edges"]).where(F.col("name") == (name or "").strip()), self.tables["files"]).cache()
        cap = self.budget.cap("find_java_references")
        lines = [df.select(F.col(k).alias("k"), F.coalesce("path", F.lit("?")).alias("path"), "line", F.col(snippet).alias("snippet")) for df, k, snippet in ((refs, "dst", "src"), (tail, "name", "cause"))]
        sizes = shape.rung_sizes(lines[0].unionByName(lines[1]), "k").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("full", "locations", "rollup")])
        rung = sizes.select(shape.choose_rung(cap).alias("r")).first()["r"]
        rollup = lambda df: [f"  {x['path']}  {x['n']}" for x in df.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect()]
        for r in rows:
            mine = refs.where(F.col("dst") == r["moniker"])
            n, files = mine.agg(F.count(F.lit(1)), F.count_distinct("path")).first()
            out.append(f"{r['signature'] or r['moniker']}: Total refs: {n} across {files} file{'s' * (files != 1)}")
            if rung in ("rollup", "over"):
                out += rollup(mine)
            else:
                for x in mine.orderBy("src", "path", "line", "col").collect():
                    out.append(f"  {x['path']}:{x['line']}" + (f"  called from {x['src']}" if rung == "full" else ""))
        n, files = tail.agg(F.count(F.lit(1)), F.count_distinct("path")).first()
        if n:
            out.append(f"{n} unconfirmed across {files} file{'s' * (files != 1)}")
            if rung in ("rollup", "over"):
                out += rollup(tail)
            else:
                out += [f"  {x['path']}:{x['line']}" + (f"  [{x['cause']}]" if rung == "full" else "") for x in tail.orderBy("path", "line", "col").collect()]
        refs.unpersist()
        tail.unpersist()
        if rung == "over":
            out.append("Over the token budget even as counts per file; all files are listed.")
        elif rung != "full":
            out.append("Shortened to fit the token budget.")
        return "\n".join(out)

    def hierarchy(self, up: bool, symbol: str | None = None, file: str | None = None, line: int | None = None, col: int | None = None) -> str:
        rows, out = self._select(symbol, file, line, col), []
        spark = self.tables["edges"].sparkSession
        starts = spark.createDataFrame([(r["moniker"],) for r in rows], "start string")
        sym = search.live_symbols(self.tables["symbols"]).select(F.col("moniker").alias("node"), "signature")
        for x in cl.closure(self.tables["edges"], starts, up).join(sym, "node", "left").orderBy("start", "depth", "node").collect():
            out.append(f"{'  ' * x['depth']}{x['signature'] or x['node'].lstrip('~')}  ({x['via'].lower()}, depth {x['depth']})" + ("  …" if x["truncated"] else ""))
        return "\n".join(out) or f"No {'super' if up else 'sub'}types."

    def grep(self, query: str, fixed_string: bool = False, case_sensitive: bool = True, match_in: str = "all", kind: str | None = None, path: str | None = None, output: str = "content", limit: int = search.DEFAULT_LIMIT) -> str:
        if output not in ("content", "files", "count"):
            raise ToolError(f"output: {output}")
        spec = SearchSpec(query, fixed_string, case_sensitive)
        try:
            spec.validate(self.tables["symbols"].sparkSession)
            hits = search.grep(self.tables["symbols"], self.tables["text_units"], self.tables["files"], spec, kind, path, match_in).cache()
        except ValueError as e:
            raise ToolError(str(e)) from e
        head = search.count_header(hits).first()
        lines = [f"{head['total']} matches across {head['files']} file{'s' * (head['files'] != 1)} ({head['symbols']} symbols, {head['text']} text)"]
        if output == "count":
            pass
        elif output == "files" or search.collapses(head["total"]):
            lines += [f"  {r['path']}  {r['hits']}" for r in search.per_file(hits).orderBy("best", "path").limit(limit).collect()]
            if output != "files":
                lines += [f"  e.g. {r['path']}:{r['line']}  {(r['snippet'] or '').strip()}" for r in search.one_per_file(hits).collect()] + ["Samples, not exhaustive; narrow with path."]
        else:
            lines += [f"  {r['path']}:{r['line']}{'' if r['col'] is None else ':' + str(r['col'])} [{r['kind']}] {(r['snippet'] or r['moniker'] or '').strip()}" for r in hits.orderBy(*search.grep_rank()).limit(limit).collect()]
        hits.unpersist()
        return "\n".join(lines)

    def skim(self, path: str, inlineBodyMaxChars: int = shape.INLINE_BODY, includeDocs: bool = True) -> str:  # noqa: N803 - names of the public arguments
        ids = self.tables["files"].where(F.col("path") == path).select("file_id").distinct()
        row = shape.skim_files(self.tables["skim_decls"].join(ids, "file_id", "left_semi"), inlineBodyMaxChars, includeDocs).first()
        if row is None:
            raise ToolError(f"no such file: {path}")
        return row["text"]

    def health(self) -> str:
        return "ok: " + ", ".join(sorted(self.tables))
