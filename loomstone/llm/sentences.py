"""Sentence units of texts in many languages, scripts and layouts.

A text is first laid out: fenced code, headings, list items and paragraphs, with the marks at
the heads of lines set aside. Within a paragraph every place that could end a sentence is a
candidate, and semi-Markov dynamic programming picks the best sequence of whole spans. A span is
scored as a whole (``span_score``): its length, the word it opens with, the word it closes with, and whether
its quotations and brackets are balanced, where a weak closing counts less in a short span and an inverted
mark at the beginning asks for its partner at the end. Positions are code points of the text as stored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.runtime import spread

# Abbreviations, without their last full stop, in lower case.
#: Something always follows these.
NEVER_LAST = set(
    """mr mrs ms messrs dr dra prof sr sra srta st ste fig figs eq eqs abb vgl bzw ca cf e.g i.e vs viz approx aprox mme mlle hr fr frau z z.b d.h u.a o.ä sog evtl ggf inkl
    p.ex p.ej c.-à-d env véase см рис стр табл гл ср т.е т.к напр им ул акад проф डॉ श्री सुश्री ex ej págs pág pp capt gen gov sen rep lt col maj""".split()
)
#: These need a number after them, else they are ordinary words.
BEFORE_NUMBER = set("no nr nos núm num art vol rev sec sect ch chap cap par para bd abs s p pos ver v op tab anm п пп г ст №".split())
#: These may end a sentence.
MAY_BE_LAST = set("etc usw u.s.w inc ltd co corp jr a.m p.m am pm d.c u.s u.k ph.d b.c a.d и.т.д д др г гг e.u ff f al ss approx".split())
#: These follow what they belong to, so they open no sentence.
NEVER_FIRST = set("inc ltd corp co jr etc usw al ss ph.d b.c a.d d.c a.m p.m".split())
#: German words before an ordinal, whose full stop ends nothing.
BEFORE_ORDINAL = set("am der die das den dem des vom zum zur im beim ab bis seit und oder jeder jede jedes ein eine einem einen einer".split())
#: Words with which a Hindi or Japanese or Chinese sentence goes on after a quotation.
HINDI_ON = set("और तो कि लेकिन पर फिर कहा कहकर कहते पूछा बोला बोली बोले लिखा".split())

_EOL = regex.compile(r"\r\n|\n|\r|\u2028|\u2029|\x85")
_MARKS = regex.compile(r"[ \t\u00a0]*(?:(?:>+|//+[/!]?|#!|--(?= )|%%?(?= )|;;+)[ \t]*|(?<=[ \t])\*+(?=[ \t]|$)[ \t]*)*[ \t\u00a0\u3000]*")
_FENCE = regex.compile(r"(`{3,}|~{3,})")
_HEADING = regex.compile(r"#{1,6}[ \t]+(?=\S)")
_RULE = regex.compile(r"(?:=+|-{3,}|\*{3,}|_{3,}|(?:- ){2,}-|(?:\* ){2,}\*)\s*$")
_BULLET = regex.compile(r"(?:[-*+•‣◦·▪–—]|\[[ xX]\])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
_ORDERED = regex.compile(r"\(?(\d{1,3}|[a-z]|[ivx]{1,5})[.)][ \t]+(?=\S)|(\d{1,3})[、．][ \t]*(?=\S)")

_OPEN = {"(": ")", "[": "]", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "‹": "›", "‚": "‘"}
_CLOSERS = ")]»”“\"'’」』）》】›‘"
_BRACKETISH = regex.compile(r"[()\[\]«»“”„\"「」『』（）《》【】‹›]")
_TERMINAL = regex.compile(r"(?:\.{2,}|…+|[.!?।॥؟۔‼⁇⁈⁉]|[。！？．｡])(?:\.{2,}|…+|[.!?।॥؟۔‼⁇⁈⁉]|[。！？．｡])*")
_THAI_GAP = regex.compile(r"(?<=\p{Thai})\s+(?!ๆ)(?=\S)|(?<=\S)\s+(?=\p{Thai})(?!ๆ)")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー\u3000-\u303f\uff00-\uffef]")
_MARKUP_END = regex.compile(r"(?:\*{1,3}|_{1,2}|`|</\w+>)(?=\s|$)")
_LOWER_ON = regex.compile(r"[^\p{Lu}.!?]{12,}+[.!?]+\s+[^\p{Lu}]{12}")
_DOTTED = regex.compile(r"(?:\p{L}\.)*")
_ABBREVIATION = regex.compile(r"((?:\p{L}{1,4}(?:\.\p{L}){0,2})?)\.?")
_THAI = regex.compile(r"\p{Thai}")
_DEVANAGARI, _DEVANAGARI_WORD = regex.compile(r"\p{Devanagari}"), regex.compile(r"[\p{Devanagari}\p{M}]+")
_HAN, _KANA, _CAPITAL = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Lu}")
_SAYS = regex.compile(r".{0,3}[说道问写答喊]")
_FUSED_WORD = regex.compile(r"\p{Lu}?[\p{Ll}\p{M}]{2,}$|\d+$")
_FUSED_NEXT = regex.compile(r"[\"“„«(¿¡]?(?:\p{Lu}\p{Ll}*[\s’',]|\p{Lu}\p{Ll}+-)")
_HEAD_END = regex.compile(r"\s+#+$")
_CAMEL = regex.compile(r"\p{Ll}[\p{L}\p{N}]*\p{Lu}|[\p{L}\p{N}_]+(?:\(|\.\p{Ll}|_)")


class _Text:
    """Content lines joined by single blanks, and where each character stands in the stored text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.spans: list[tuple[int, int]] = []  # (offset in the joined text, offset in the stored text)
        self.size = 0

    def add(self, content: str, at: int) -> None:
        if self.parts:
            self.parts.append(" ")
            self.size += 1
        self.spans.append((self.size, at))
        self.parts.append(content)
        self.size += len(content)

    def units(self, out: list[tuple[int, int]], split: bool = True) -> None:
        joined = "".join(self.parts)
        i = 0

        def stored(pos: int) -> int:
            nonlocal i
            while i + 1 < len(self.spans) and self.spans[i + 1][0] <= pos:
                i += 1
            return self.spans[i][1] + pos - self.spans[i][0]

        for a, b in segment(joined) if split else [(0, len(joined))]:
            while a < b and joined[a].isspace():
                a += 1
            while b > a and joined[b - 1].isspace():
                b -= 1
            if a < b:
                start = stored(a)
                out.append((start, stored(b - 1) + 1))


_CLOSES: dict[str, set[str]] = {}
for _a, _b in _OPEN.items():
    _CLOSES.setdefault(_b, set()).add(_a)
_CLOSES["”"].add("„")


def _pairs(text: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Matched quotations and brackets as (open, close), and the opening of each closing place. Marks without a partner count for nothing.

    A closing mark pops what was opened after its partner, and is passed over if nothing it could close is open, so
    the work is linear. A straight quote that can only open (after white space, before a word) or only close leaves
    an unfitting partner alone, such as the inch mark of 15".
    """
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    held = dict.fromkeys(_OPEN, 0)
    straight, n = -1, len(text)
    for m in _BRACKETISH.finditer(text):
        ch, at = m[0], m.start()
        if ch == '"':
            before, after = text[at - 1] if at else " ", text[at + 1] if at + 1 < n else " "
            opens = before.isspace() or before in _OPEN
            closes = after.isspace() or not after.isalnum() and after not in _OPEN
            if straight < 0 and not (closes and not opens):
                straight = at
            elif straight >= 0 and opens and not closes:
                straight = at
            elif straight >= 0:
                found.append((straight, at))
                straight = -1
            continue
        partners = _CLOSES.get(ch)
        if partners and any(held[p] for p in partners):
            while True:
                mark, began = stack.pop()
                held[mark] -= 1
                if mark in partners:
                    break
            found.append((began, at))
        elif ch in _OPEN:
            stack.append((ch, at))
            held[ch] += 1
    return found, {b: a for a, b in found}


_DELIMITERS = set("()[]«»“”„\"「」『』（）,;:")
_LEADING = "\"'“„«‹‘([（「『《¿¡*_`"
_LONGEST = 12  # no abbreviation is longer, so longer tokens need no look-up


class _Tokens:
    """The token before a place: what reaches back to white space, a bracket, a quotation mark or a comma. Linear over rising places."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.start = text, 0, 0
        self.letters: tuple[int, int] = (-1, -1)  # a token and how far single letters with full stops go on in it

    def begin(self, at: int) -> int:
        k, text = at, self.text
        while k > self.at and not (text[k - 1] in _DELIMITERS or text[k - 1].isspace()):
            k -= 1
        self.start = self.start if k == self.at < at and k else k
        self.at = at
        return self.start

    def dotted(self, a: int, at: int) -> bool:
        """Whether text[a:at] is single letters with full stops between them."""
        if self.letters[0] != a:
            self.letters = (a, _DOTTED.match(self.text, a).end())
        return at - a >= 3 and (at - a) % 2 == 1 and self.letters[1] >= at - 1 and self.text[at - 1].isalpha()


def _before(text: str, at: int) -> int:
    """The place behind the last character before ``at`` that is no white space."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def _word_back(text: str, end: int) -> str:
    """The token that ends at ``end`` if an abbreviation could be as long, else ''."""
    k = end
    while k and end - k <= _LONGEST and not (text[k - 1] in _DELIMITERS or text[k - 1].isspace()):
        k -= 1
    return text[k:end] if end - k <= _LONGEST else ""


def _closing(text: str, tokens: _Tokens, at: int, mark: str, first: str, digit: bool) -> float:
    """How well the words before the terminal ``mark`` at ``at`` close a sentence, given the first letter that follows."""
    if mark[0] in "。！？．｡।॥؟۔":
        return 5.0
    if "!" in mark or "?" in mark or any(c in "‼⁇⁈⁉" for c in mark):
        return 3.5
    if len(mark) > 1 or mark == "…":
        return 1.0
    start = tokens.begin(at)
    a = start
    while a < at and text[a] in "'’¿¡":
        a += 1
    if tokens.dotted(a, at):
        word = text[a:at].lower() if at - a <= _LONGEST else ""
        return -7.0 if word in NEVER_LAST else 0.5
    near = text[max(a, at - _LONGEST - 1) : at].lower()  # enough to see any abbreviation, whole or behind an apostrophe
    word = near if at - a <= _LONGEST else ""
    tail, curly = near.rpartition("'")[2], near.rpartition("’")[2]
    if word in NEVER_LAST or tail != near and tail in NEVER_LAST or curly != near and curly in NEVER_LAST:
        return -7.0
    bare = tail if tail and tail != near else word
    if digit and bare in BEFORE_NUMBER:
        k = _before(text, start)
        if not (text.endswith("...", 0, k) or text.endswith("…", 0, k)):
            return -7.0
    if len(word) == 1 and word.isalpha():
        if text[start:at].isupper():
            return -6.0 if first.isupper() else -4.0
        return 0.5 if word in MAY_BE_LAST else -3.0
    if word in MAY_BE_LAST:
        return 0.5
    if word.isdigit() and len(word) <= 2 and not first.islower() and start and _word_back(text, start - 1).lower() in BEFORE_ORDINAL:
        return -6.0
    return 2.5


def _opening(text: str, at: int, after: str) -> float:
    """How well a span opens with the token at ``at``; ``after`` is the character before which leading marks were passed."""
    if at >= len(text) or text[at].isspace():
        return 1.0
    ch = text[at]
    if "." in text[at : at + 4] and _ABBREVIATION.match(text, at)[1].lower() in NEVER_FIRST:
        return -1.0
    if ch.isupper() or after in "¿¡" or _WIDE.match(ch) or ch.isdigit():
        return 1.5
    if ch.islower():
        return 0.0 if _CAMEL.match(text, at) else -5.0
    return 0.5 if ch.isalpha() else -0.5


def _goes_on(text: str, opened: int, at: int) -> bool:
    """Whether a sentence goes on at ``at`` after a quotation (opened at ``opened``) in a script without capitals."""
    if at >= len(text) or text[at].isspace():
        return False
    if text[at] in "とをはがのにでもやへ" or text.startswith("って", at):
        return True
    if _DEVANAGARI.match(text, at):
        return _DEVANAGARI_WORD.match(text, at)[0] in HINDI_ON
    if _HAN.match(text, at):
        k = _before(text, opened)
        lead = text[k - 1 : k]
        if lead in "：:，,、" and lead:
            return False
        if not lead or lead in "。！？!?.」』”》）)":
            return text[opened] not in "「『（(" and bool(_SAYS.match(text, at))
        return text[opened] in "“《「『" and not _KANA.match(lead)
    return False


class _Cut(NamedTuple):
    """A place that could end a span."""

    at: int
    closing: float  # the words before it as the end of a span
    opening: float  # the words after it as the beginning of one
    asks: bool  # a question or exclamation mark ends it
    inverted: bool  # an inverted question or exclamation mark follows


def segment(text: str) -> list[tuple[int, int]]:
    """Spans of one paragraph (joined lines), in order; they may have white space at their ends. Linear in the text."""
    n = len(text)
    last = _before(text, n)
    terminals = [m.span() for m in _TERMINAL.finditer(text)]
    thai = not text.isascii() and bool(_THAI.search(text))
    if not thai and (not terminals or terminals[0][1] == last):
        return [(0, n)]
    found, opened = _pairs(text)
    tokens = _Tokens(text)
    capitals = [m.start() for m in _CAPITAL.finditer(text)]
    cuts: list[_Cut] = []

    def small(i: int, at: int, stop: int) -> bool:
        """Whether the clauses on both sides of a terminal, or two after it, have no capitals, so that a small letter may open a sentence."""
        if _LOWER_ON.match(text, stop):
            return True
        a, b = terminals[i - 1][1] if i else 0, terminals[i + 1][0] if i + 1 < len(terminals) else n
        return at - a >= 12 and b - stop >= 3 and bisect_left(capitals, a) == bisect_left(capitals, b)

    for i, (at, end) in enumerate(terminals):
        mark = text[at:end]
        stop, quoted = end, -1
        while stop < n:
            if stop in opened:
                quoted, stop = opened[stop], stop + 1
                continue
            if text[stop] in "*_`<" and (m2 := _MARKUP_END.match(text, stop)):
                stop = m2.end()
                continue
            if text[stop].isspace():
                k = stop
                while k < n and text[k].isspace():
                    k += 1
                if k in opened and text[k] == "»":
                    quoted, stop = opened[k], k + 1
                    continue
            break
        if stop >= last:
            continue
        final = text[end - 1]
        wide = final in "。！？．｡" or (stop > end and text[stop - 1] in "」』”）》】" and final in "।。！？")
        gap = text[stop].isspace()
        k = stop
        while k < n and text[k].isspace():
            k += 1
        after = text[k]
        if not gap and not wide:
            if mark[0] == "…" or len(mark) > 1 and mark[0] == ".":
                continue
            if final in "।॥":
                pass
            elif final in "!?":
                j = k
                while j < n and text[j] in _LEADING:
                    j += 1
                if not (text[j : j + 1].isupper() or after in "¿¡«“„\"(" or _WIDE.match(after)):
                    continue
            else:
                start = tokens.begin(at)
                fused = stop > end or _FUSED_WORD.match(text, start, at)
                if not (fused and _FUSED_NEXT.match(text, stop) and (stop > end or not text[start].isdigit())):
                    continue
        if mark[0] == "…" and not gap and _WIDE.match(after):
            continue
        j = k
        while j < n and text[j] in _LEADING:
            j += 1
        opening = _opening(text, j, after)
        if opening < -1.0 and (quoted < 0 and final in "。！？．｡।॥" or small(i, at, stop)):
            opening = -1.0
        closing = _closing(text, tokens, at, mark, text[j : j + 1], after.isdigit()) - (0.0 if gap or wide else 0.5)
        if quoted >= 0 and (wide or final == "।") and _goes_on(text, quoted, j):
            closing, opening = -6.0, 0.0
        cuts.append(_Cut(stop, closing, opening, "!" in mark or "?" in mark, after in "¿¡"))
    if thai:
        cuts.extend(_Cut(m.start(), 6.0, 0.0, False, False) for m in _THAI_GAP.finditer(text))
    if not cuts:
        return [(0, n)]
    best: dict[int, _Cut] = {}
    for c in sorted(cuts, key=lambda c: c.closing + c.opening):
        best[c.at] = c
    tail = terminals[-1] if terminals else (0, 0)
    asks = any(c in "!?" for c in text[tail[0] : tail[1]]) and all(c in _CLOSERS or c.isspace() for c in text[tail[1] :])
    return _best(n, sorted(best.values()), found, text[: n - len(text.lstrip()) + 1][-1:] in "¿¡", asks)


# The score of a whole span: the words it opens and closes with, and jointly
SHORT, LONG = 12, 400  # its length: code points below and above which it is unlikely
OPEN_PAIR = 8.0  # what a quotation or bracket left open at its end costs
WEAK_SHORT = 1.0  # what a closing by a mere abbreviation costs a short span besides
INVERTED = 2.5  # what an opening ¿ or ¡ costs a span that no question or exclamation mark closes


def _length(size: int) -> float:
    """How unlikely the length of a span is: short ones the more the shorter, very long ones somewhat."""
    if size < 3:
        return -3.0
    return -0.15 * (SHORT - size) if size < SHORT else 0.0 if size <= LONG else -0.5


def span_score(size: int, opening: float, inverted: bool, closing: float, asks: bool, open_pairs: int) -> float:
    """The score of one span as a whole, in which its length, its opening, its closing and its balance meet."""
    score = opening + closing + _length(size) - OPEN_PAIR * open_pairs
    if size < SHORT and 0.0 < closing < 1.0:
        score -= WEAK_SHORT
    if inverted and not asks:
        score -= INVERTED
    return score


def _best(n: int, cuts: list[_Cut], found: list[tuple[int, int]], inverted: bool = False, asks: bool = False) -> list[tuple[int, int]]:
    """The sequence of whole spans with the largest sum of ``span_score``, by semi-Markov dynamic programming over all starts.

    Starts are kept in three ranges of span length (below SHORT one by one, up to LONG in a queue of falling totals, beyond
    by their best), apart for inverted openings, so each end costs a few steps however long the text is. Of
    equal sums the one with the earlier start, that is the longer span, wins. The last span closes without a score of its own.
    """
    ends = [c.at for c in cuts] + [n]
    broken = [0] * (len(ends) + 1)  # matched pairs open at each end, so that the spans on both sides would be unbalanced
    for a, b in found:
        broken[bisect_right(ends, a)] += 1
        broken[bisect_right(ends, b)] -= 1
    begins = [0, *ends]
    opens = [0.0, *(c.opening for c in cuts)]
    kinds = [inverted, *(c.inverted for c in cuts)]
    total, back = [0.0] * len(begins), [0] * len(begins)
    worth = [0.0] * len(begins)  # total and opening of each start
    middle: tuple[deque[int], deque[int]] = (deque(), deque())
    beyond: list[int] = [-1, -1]
    near = passed = pairs = 0
    for j, end in enumerate(ends, 1):
        worth[j - 1] = total[j - 1] + opens[j - 1]
        pairs += broken[j - 1]
        closing, asked = (cuts[j - 1].closing, cuts[j - 1].asks) if j <= len(cuts) else (0.0, asks)
        open_pairs = pairs if j <= len(cuts) else 0
        while near < j and end - begins[near] >= SHORT:
            q = middle[kinds[near]]
            while q and worth[q[-1]] < worth[near]:
                q.pop()
            q.append(near)
            near += 1
        while passed < near and end - begins[passed] > LONG:
            kind = kinds[passed]
            if beyond[kind] < 0 or worth[passed] > worth[beyond[kind]]:
                beyond[kind] = passed
            if middle[kind] and middle[kind][0] == passed:
                middle[kind].popleft()
            passed += 1
        best, frm = -math.inf, -1
        for i in (*beyond, *(q[0] for q in middle if q), *range(near, j)):
            if i < 0:
                continue
            score = total[i] + span_score(end - begins[i], opens[i], kinds[i], closing, asked, open_pairs)
            if score > best or score == best and i < frm:
                best, frm = score, i
        total[j], back[j] = best, frm
    spans, j = [], len(ends)
    while j > 0:
        spans.append((begins[back[j]], begins[j]))
        j = back[j]
    return spans[::-1]


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of ``text``; nothing for null and blank texts."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    para: _Text | None = None
    fence, fence_at, fence_end = "", 0, 0
    last_item: tuple[str, int] | None = None  # kind of list and number of the item that the paragraph is
    fresh = True  # no paragraph is open: at the start, after a blank line, a heading or a fence

    def flush() -> None:
        nonlocal para, last_item, fresh
        if para is not None:
            para.units(out)
        para, last_item, fresh = None, None, True

    at = 0
    ends = [(m.start(), m.end()) for m in _EOL.finditer(text)] + [(len(text), len(text))]
    for stop, resume in ends:
        a = _MARKS.match(text, at, stop).end()
        b = stop
        while b > a and text[b - 1].isspace():
            b -= 1
        at = resume
        line = text[a:b]
        if fence:
            fence_end = b if line else fence_end
            if line.startswith(fence) and not line.strip(fence[0]):
                out.append((fence_at, b))
                fence = ""
            continue
        if not line:
            flush()
            continue
        if m := _FENCE.match(line):
            flush()
            fence, fence_at, fence_end = m[1], a, b
            continue
        if m := _HEADING.match(line):
            flush()
            head = _HEAD_END.sub("", line[m.end() :])
            out.append((a + m.end(), a + m.end() + len(head)))
            continue
        if _RULE.match(line):
            flush()
            continue
        number = None
        if m := _BULLET.match(line):
            item = ("bullet", 0)
        elif (m := _ORDERED.match(line)) and (fresh or last_item and last_item[0] == "ordered"):
            label = m[1] or m[2]
            number = int(label) if label.isdigit() else ord(label[0]) - 96 if len(label) == 1 else 0
            item = ("ordered", number)
            if fresh:
                if not (number <= 1 or line[m.end() :][:1].isupper() or not line[m.end() :][:1].islower()):
                    m = None
            elif number != last_item[1] + 1:
                m = None
        else:
            m = None
        if m:
            flush()
            para, last_item, fresh = _Text(), item, False
            para.add(line[m.end() :], a + m.end())
            continue
        if para is None:
            para = _Text()
        para.add(line, a)
        fresh = False
    if fence:
        out.append((fence_at, fence_end))
    flush()
    return out


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ids, starts, ends = [], [], []
        for doc_id, text in zip(f["doc_id"], f["text"]):
            for a, b in units(text):
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
            if len(ids) > 100_000:
                yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": ends}, dtype="int64")
                ids, starts, ends = [], [], []
        yield pd.DataFrame({"doc_id": ids, "start_pos": starts, "end_pos": ends}, dtype="int64")


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos of every sentence unit. Map-only; null and blank texts have none, a null doc_id no row."""
    rows = spread(documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text"), "doc_id")
    return rows.mapInPandas(_split, "doc_id bigint, start_pos bigint, end_pos bigint")
