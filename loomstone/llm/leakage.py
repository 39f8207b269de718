"""Held-out test items that leak into a corpus: which item stands in which document, and where.

Each shard of a partition (``SHARD`` symbols of whole documents) gets an FM-index. All windows of
all items (8 words; 20 letters or digits for Chinese and Japanese) are searched backwards in it at
once; the occurrences found are located by sampled suffix positions and merged to spans. Documents
never leave their partition, so nothing is shuffled.
"""

from __future__ import annotations

import html
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.fmindex import FMIndex
from loomstone.runtime import cut, spread

SHARD = 400_000
WORDS, LETTERS = 8, 20
#: Items are searched in blocks of so many characters of text; each block is one pass over the corpus.
ITEM_BLOCK = 4 << 20
LETTERWISE = {"zh", "ja"}

_ASIDE = regex.compile(
    r"(?m)</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>\n]*)?/?>|(?<=\])\([^()\s]*\)|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|\p{Cf}"
    r"|^[ \t]*(?:(?:>+|//+|\*+|#+|[-+•])[ \t]*)*\d{1,3}[.)](?=[ \t])")
_CLUSTER = regex.compile(r"\X")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


class _Plain:
    """A text without markup, in one Unicode form, and where its characters stand in the stored text."""

    def __init__(self, text: str) -> None:
        parts, starts, origins, size, at = [], [0], [0], 0, 0

        def put(piece: str, origin: int, width: int) -> None:
            """``piece`` for ``width`` stored characters; equal lengths keep one anchor."""
            nonlocal size
            if piece:
                starts.append(size)
                origins.append(origin)
                parts.append(piece)
                size += len(piece)

        def plain(piece: str, origin: int) -> None:
            if piece.isascii() or unicodedata.is_normalized("NFKC", piece):
                put(piece, origin, len(piece))
                return
            for m in _CLUSTER.finditer(piece):
                put(unicodedata.normalize("NFKC", m[0]), origin + m.start(), len(m[0]))

        for m in _ASIDE.finditer(text):
            plain(text[at : m.start()], at)
            if m[0][0] == "&":
                plain(html.unescape(m[0]), m.start())
            at = m.end()
        plain(text[at:], at)
        self.text, self._starts, self._origins = "".join(parts), starts, origins

    def stored(self, pos: int) -> int:
        k = bisect_right(self._starts, pos) - 1
        return self._origins[k] + pos - self._starts[k]


def _plain(text: str) -> str:
    """The plain text alone."""
    if text.isascii() and not _ASIDE.search(text):
        return text
    parts, at = [], 0

    def plain(piece: str) -> None:
        parts.append(piece if piece.isascii() or unicodedata.is_normalized("NFKC", piece) else "".join(unicodedata.normalize("NFKC", c) for c in _CLUSTER.findall(piece)))

    for m in _ASIDE.finditer(text):
        plain(text[at : m.start()])
        if m[0][0] == "&":
            plain(html.unescape(m[0]))
        at = m.end()
    plain(text[at:])
    return "".join(parts)


def words(text: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    return [w.casefold() for w in _WORD.findall(_plain(text))]


def letters(text: str) -> list[str]:
    """Letters and digits, case folded."""
    return [w.casefold() for w in _LETTER.findall(_plain(text))]


_UNIT = {words: _WORD, letters: _LETTER}


def _places(text: str, tokens) -> tuple[list[tuple[int, int]], _Plain]:
    """Where the tokens stand in the plain text, and that in the stored one; asked only for texts that hold an item."""
    plain = _Plain(text)
    return [m.span() for m in _UNIT[tokens].finditer(plain.text)], plain


class Items:
    """Windows of one kind of items: distinct patterns, and the patterns at each place of each item."""

    def __init__(self, rows: list[tuple[int, str]], window: int, tokens) -> None:
        self.window, self.tokens, self.ids, self.places, self.sizes = window, tokens, [], [], []
        index: dict[tuple[str, ...], int] = {}
        owners: list[set[int]] = []
        for item_id, text in rows:
            ws = tokens(text)
            if len(ws) < window:
                continue
            place = np.empty(len(ws) - window + 1, "int64")
            for j in range(len(place)):
                key = tuple(ws[j : j + window])
                place[j] = index.setdefault(key, len(index))
                if place[j] == len(owners):
                    owners.append(set())
                owners[place[j]].add(len(self.ids))
            self.ids.append(item_id)
            self.places.append(place)
            self.sizes.append(len(ws))
        self.patterns = list(index)
        shared = np.array([len(o) > 1 for o in owners], bool)
        # An item whose shared windows cannot cover half of it is only looked at where one of its own windows occurs.
        self.seeds: list[list[int]] = [[] for _ in owners]
        for i, place in enumerate(self.places):
            enough = 2 * self.covered(i, shared[place]) >= self.sizes[i]
            for p in np.unique(place).tolist():
                if enough or not shared[p]:
                    self.seeds[p].append(i)

    def covered(self, i: int, hit: np.ndarray) -> int:
        """Tokens of item ``i`` that lie in a window found; ``hit`` tells for each of its windows."""
        edge = np.zeros(self.sizes[i] + 1, "int64")
        at = np.flatnonzero(hit)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())


def _hits(items: Items, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(which text, patterns, their positions in it) for each of the texts of one shard that holds any."""
    vocabulary: dict[str, int] = {}
    symbols: list[int] = []
    starts = []
    for tokens in texts:
        starts.append(len(symbols))
        symbols.extend([vocabulary.setdefault(t, len(vocabulary) + 2) for t in tokens])
        symbols.append(1)
    known = [p for p, key in enumerate(items.patterns) if all(t in vocabulary for t in key)]
    if not known:
        return
    index = FMIndex(np.array([*symbols, 0], "int64"), len(vocabulary) + 2)
    matrix = np.array([[vocabulary[t] for t in items.patterns[p]] for p in known], "int64")
    which, lo, hi = index.search(matrix)
    if not len(which):
        return
    patterns = np.repeat(np.array(known)[which], hi - lo)
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(patterns))
    at = np.concatenate([index.locate(rows[k : k + 500_000]) for k in range(0, len(rows), 500_000)])
    doc = np.searchsorted(np.array(starts), at, side="right") - 1
    order = np.lexsort((at, doc))
    patterns, at, doc = patterns[order], at[order], doc[order]
    edges = np.flatnonzero(np.diff(doc)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(doc)]):
        yield int(doc[a]), patterns[a:b], at[a:b] - starts[doc[a]]


def _report(items: Items, doc_id: int, text: str, here: np.ndarray, pos: np.ndarray) -> Iterator[tuple]:
    """(doc_id, item_id, covered, size, spans) of the items that one document holds; ``here`` are the patterns found at ``pos``."""
    spans: list[tuple[int, int]] = []
    for i in sorted({i for p in np.unique(here).tolist() for i in items.seeds[p]}):
        covered = items.covered(i, np.isin(items.places[i], here))
        if 2 * covered < items.sizes[i]:
            continue
        if not spans:
            spans, plain = _places(text, items.tokens)
        merged: list[list[int]] = []
        for p in pos[np.isin(here, items.places[i])].tolist():
            if merged and p <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], p + items.window)
            else:
                merged.append([p, p + items.window])
        out = [{"start_pos": plain.stored(spans[p][0]), "end_pos": plain.stored(spans[q - 1][1] - 1) + 1} for p, q in merged]
        yield doc_id, items.ids[i], covered, items.sizes[i], out


_Doc = tuple[int, str, list[str]]  # id, text, tokens


def _search(items: Items, docs: list[_Doc]) -> Iterator[tuple]:
    """The reports of the documents of one shard."""
    for d, here, pos in _hits(items, [tokens for _, _, tokens in docs]):
        yield from _report(items, *docs[d][:2], here, pos)


def _search_long(items: Items, doc: _Doc, shard: int) -> Iterator[tuple]:
    """The report of one document larger than a shard: its parts overlap by a window less one token and are indexed one by one."""
    doc_id, text, tokens = doc
    here, pos = [], []
    for a in range(0, len(tokens), shard):
        for _, patterns, at in _hits(items, [tokens[a : a + shard + items.window - 1]]):
            here.append(patterns)
            pos.append(at + a)
    if here:
        yield from _report(items, doc_id, text, np.concatenate(here), np.concatenate(pos))


_FOUND = "doc_id bigint, item_id bigint, covered bigint, size bigint, spans array<struct<start_pos:bigint,end_pos:bigint>>"
_COLUMNS = ["doc_id", "item_id", "covered", "size", "spans"]


def _letterwise(lang: str, text: str) -> bool:
    """Whether an item is compared by letters: its language or, where that is missing or wrong, its script says so."""
    return lang in LETTERWISE or 2 * len(_CJK.findall(text)) > len(_LETTER.findall(text))


def _latin_half(text: str) -> bool:
    """Whether runs without any Chinese or Japanese character, of the window length, make up half of an item."""
    tokens = letters(text)
    runs, run = 0, 0
    for t in [*tokens, "一"]:
        if _CJK.match(t):
            runs, run = runs + (run if run >= LETTERS else 0), 0
        else:
            run += 1
    return 2 * runs >= len(tokens)


class _Block:
    """A block of items made ready for the search: by words, by letters, and whether the latter may stand in texts without Chinese or Japanese."""

    ready: tuple[str, _Block] | None = None  # one per Python worker

    def __init__(self, rows: list[tuple[int, str, str]]) -> None:
        dense = [(i, t) for i, lang, t in rows if _letterwise(lang, t)]
        self.kinds = (Items([(i, t) for i, lang, t in rows if not _letterwise(lang, t)], WORDS, words), Items(dense, LETTERS, letters))
        self.anywhere = any(_latin_half(t) for _, t in dense)

    @classmethod
    def of(cls, key: str, rows: list[tuple[int, str, str]]) -> _Block:
        """Built once in each Python worker, not in each task."""
        if cls.ready is None or cls.ready[0] != key:
            cls.ready = (key, cls(rows))
        return cls.ready[1]


def _finder(key: str, rows, shard: int):
    """``rows`` is a broadcast of (item_id, lang, text)."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _Block.of(key, rows.value)
        held: list[list[_Doc]] = [[], []]
        sizes = [0, 0]

        def run(k: int) -> pd.DataFrame:
            out = pd.DataFrame(list(_search(block.kinds[k], held[k])), columns=_COLUMNS)
            held[k], sizes[k] = [], 0
            return out

        for f in frames:
            for doc_id, text in zip(f["doc_id"], f["text"]):
                for k, items in enumerate(block.kinds):
                    if not items.ids or (k and not block.anywhere and not _CJK.search(text)):
                        continue
                    tokens = items.tokens(text)
                    if len(tokens) > shard:
                        yield pd.DataFrame(list(_search_long(items, (doc_id, text, tokens), shard)), columns=_COLUMNS)
                    elif len(tokens) >= items.window:
                        held[k].append((doc_id, text, tokens))
                        sizes[k] += len(tokens) + 1
                        if sizes[k] >= shard:
                            yield run(k)
        for k in (0, 1):
            if held[k]:
                yield run(k)

    return find


def leaks(documents: DataFrame, items: DataFrame, shard: int = SHARD, block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, covered, size, spans of every document that holds at least half of an item.

    covered and size count the item's words (letters and digits for zh and ja, and for items written mostly
    in their scripts); spans are merged code point ranges of the stored text, fit for removal. The items are the stated
    query set: they come to the driver block by block, ``block`` characters at a time, and each block is broadcast
    for one pass over the corpus, whose findings are written before the next block is fetched. Null and blank texts,
    and items shorter than one window, give nothing; equal items all match.
    """
    sc = documents.sparkSession.sparkContext
    texts = spread(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id")

    def one_pass(rows: list[tuple[int, str, str]]) -> DataFrame:
        return texts.mapInPandas(_finder(uuid.uuid4().hex, sc.broadcast(rows), shard), _FOUND)

    out, rows, size = None, [], 0
    for r in items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "lang", "text").distinct().toLocalIterator():
        if size >= block:
            found = cut(one_pass(rows))
            out = found if out is None else out.unionByName(found)
            rows, size = [], 0
        rows.append((r["item_id"], (r["lang"] or "").strip().lower()[:2], r["text"]))
        size += len(r["text"])
    last = one_pass(rows)
    return last if out is None else out.unionByName(last)
