"""Comment and literal text made readable: encodings repaired, marks, tags and code taken off.

Works on single strings inside Arrow batches; everything here is linear in the text.
"""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import ahocorasick
import regex

LANGUAGES = ("en", "de", "fr", "es", "ru", "zh", "ja", "hi", "th")
#: Languages told apart from a neighbour of the same script but not reported: text of these has no language here.
OTHERS = ("uk", "mr")

# Frequent function words of each language, in its own spelling.
FUNCTION_WORDS = {
    "en": """the a an of to in on at by for from with without and or but not no nor is are was were be been being it its this that these those each every
        our your their his her we you they he she as than then when while if before after under over during once twice until unless into onto out up down off
        all any some most both few more less other such only own same so too very can will would should may must now who whom whose which what why how there here
        has have had do does did between against through across about above below again because per throughout afterwards whenever wherever whether""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren wird werden wurde sein hat haben hatte
        im in am an auf aus bei beim mit nach von vom vor zu zum zur für über unter um ohne gegen durch zwischen während solange sobald wenn falls als wie dass daß
        weil noch nur nie immer schon auch sich er sie es wir ihr ich man je jede jeder jedes jeden jedem alle allen dieser diese dieses diesen diesem was wer wo
        warum bis ab einmal zweimal höchstens danach daraus davon dafür hier dort sehr mehr zwei eins""",
    "fr": """le la les l un une des du de d et ou mais ne pas non est sont était étaient être été a ont avait avoir ce cet cette ces son sa ses leur leurs nos notre
        votre vos il elle ils elles on nous vous je tu se s qui que qu quoi dont où quand comme si dans sur sous avec sans pour par vers chez entre avant après pendant
        dès tant puis plus moins très tout toute tous toutes chaque aucun aucune même au aux en y jamais toujours encore déjà ici là fois hors""",
    "es": """el la los las un una unos unas de del y e o u pero no ni es son era eran ser está están fue ha han había haber este esta estos estas ese esa eso
        su sus nuestro nuestra mi tu se lo le les que quien cual cuyo cuando como si en con sin por para sobre bajo entre hasta desde hacia antes después mientras
        durante cada todo toda todos todas ningún ninguna mismo misma más menos muy al solo sólo ya aún siempre nunca aquí allí vez veces dos uno""",
    "ru": """и в во не на с со что он она оно они мы вы я как а но или из за к ко от до по под при о об у для без над между через после перед пока когда если
        это этот эта эти тот та те все всё весь вся каждый каждое каждая каждую раз один два был была было были есть нет же ли бы уже ещё только более чем так там
        здесь где который которая которые""",
    "hi": """का के की को से में पर और या है हैं था थे थी नहीं यह ये वह वे एक दो इस उस हर सभी केवल बार बाद पहले फिर कुछ अपने अपनी ने तक भी ही तो जो जब अगर
        लिए साथ बिना ऊपर नीचे भीतर कर करता करती गया गई हुआ हुई""",
    "uk": """і та що не на з із це як але або для від до при який яка яке які ще вже тільки лише більше його її їх ми ви він вона воно вони є був була було були під над між через після перед якщо коли""",
    "mr": """आणि आहे आहेत हे ते या नाही मध्ये होते होता होती करून त्या त्याच्या आपल्या सर्व एका किंवा पण तर की म्हणून साठी असे असते""",
}

_MOJIBAKE = regex.compile(r"[À-ßà-ô\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")
_RUN = regex.compile(r"[^\x00-\x7f]+")
_SURROGATE = regex.compile("[\ud800-\udfff]")
_SPACE_ESC, _QUOTE_ESC = regex.compile(r"\\+[nrtf]"), regex.compile(r"\\+([\"'])")
_UESC = regex.compile(r"\\+u+([0-9A-Fa-f]{4})")


def _bytes(run: str) -> bytes | None:
    out = bytearray()
    for ch in run:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return None
            out.append(ord(ch))
    return bytes(out)


def _redecode(m) -> str:
    raw = _bytes(m[0])
    try:
        return m[0] if raw is None else raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repair(text: str) -> str:
    r"""Escapes, entities and UTF-8 read as Latin text turned back into the characters meant."""
    if "\\" in text:
        text = _UESC.sub(lambda m: chr(int(m[1], 16)), text)
        if _SURROGATE.search(text):
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        text = _QUOTE_ESC.sub(r"\1", _SPACE_ESC.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    while _MOJIBAKE.search(text):  # some texts were damaged more than once; each repair shortens the text
        before, text = text, _RUN.sub(_redecode, text)
        if text == before:
            break
    return text


_BRACED = regex.compile(r"\{@\w+[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")
_CODE = regex.compile(r"<(pre|code|tt|kbd|samp|script|style)\b[^>]*>.*?</\1\s*>|```.*?```|`[^`\n]*`|<!--.*?-->", regex.S | regex.I)
_HTML = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_URL = regex.compile(r"\b(?:[a-z][a-z0-9+.-]{1,12}://|www\.)\S+", regex.I)
_HEAD = regex.compile(r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+(?=\s)|>+)[ \t]*")
_MARK = regex.compile(r"(?:(?<=^)|(?<=\s))(?:TODO|FIXME|XXX|HACK|NOTE|NOTICE|NOLINT|NOSONAR|BUG|WARNING|TBD)\b(?:\([^)]*\))?:?")
_TAG = regex.compile(r"(?m)(?:^|(?<=\s))@([A-Za-z][\w.:-]*)")
_ENDS, _FIRST = regex.compile(r"^\s*/\*+|\*+/\s*$"), regex.compile(r"^\S+")
_HOLE = regex.compile(r"[(\[]?(?:\{\d*\}|\$\{[^}]*\}|%(?:\d+\$)?[-+#0,]*\d*(?:\.\d+)?[sdfxgn])[)\]]?")

#: Block tags whose first word is a name, and those that carry no running words at all.
NAMED = {"param", "throws", "exception"}
SILENT = {"see", "author", "since", "version", "serial", "serialField", "serialData", "hidden", "uses", "provides"}


def blocks(text: str, names: bool = False) -> list[tuple[str, str]]:
    """(tag, words): the main description (tag '') and each block tag, without marks, markup, links and code.

    With ``names`` the name that a block tag is about stands behind its tag (``param slot``).
    """
    text = repair(text).replace("\r\n", "\n").replace("\r", "\n")
    text = _ENDS.sub("", text)
    text = _CODE.sub(" \u0001 ", text)
    text = _BRACED.sub(" \u0001 ", text)
    text = _HTML.sub(" ", _HEAD.sub("", text))
    text = _URL.sub(" \u0001 ", text)
    out, tag, at = [], "", 0
    for m in _TAG.finditer(text):
        out.append((tag, text[at : m.start()]))
        tag, at = m[1], m.end()
    out.append((tag, text[at:]))
    done = []
    for tag, words in out:
        if tag in SILENT or ":" in tag:
            continue
        words = _HOLE.sub(" ", _MARK.sub(" ", words)).strip()
        if tag in NAMED:
            if names and words:
                tag += " " + _FIRST.match(words)[0]
            words = _FIRST.sub("", words)
        if words:
            done.append((tag, " ".join(words.split())))
    return done


# A whitespace-separated token that is a word as written in prose, with punctuation around it.
_PROSE = regex.compile(r"^[(\[«„“”\"'‘¿¡「『‹—–-]*(\p{Lu}?[\p{Ll}\p{Lo}\p{M}\p{Lm}]+|\p{Lu}[\p{Lu}\p{M}]*)(?:['’-]\p{L}[\p{L}\p{M}]*)*[)\].,;:!?…»“”\"'’」』›।、。-]*$")
_TOKENISH = regex.compile(r"[\p{L}\p{N}=<>{}();\\/$#@\u0001]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]")
_CODEISH = regex.compile(r"[=!<>]=|&&|\|\||\+\+|--\s*[;)]|->|::|;\s*(?:\}|$)|\w\(\)\s*;|^\s*[\w.]+\s*[-+*/]?=\s*\S|^\s*[\w.]+\([^)]*\)\s*;?$|^\s*\{.*\}\s*$", regex.M)
_SQL = regex.compile(r"\b(?:SELECT\b.*\bFROM|INSERT\s+INTO|UPDATE\b.*\bSET|DELETE\s+FROM|(?:CREATE|ALTER|DROP)\s+(?:TABLE|INDEX|VIEW)|WITH\s+\w+\s+AS\s*\()\b", regex.S)
_SIGNATURE = regex.compile(r"^\s*(?:import|package|return|throw|public|private|protected|static|final|new|class|var|int|long|boolean|String)\b[^.!?]*[;{]\s*$")


def words_of(text: str) -> tuple[list[str], int]:
    """Prose tokens of spaced scripts, and how many tokens there are that carry anything."""
    tokens = [t for t in text.split() if _TOKENISH.search(t) and t != "\u0001"]
    return [t for t in tokens if _PROSE.match(t) and (t.isascii() or not _UNSPACED.search(t))], len(tokens)


@cache
def _automaton():
    """Function words of all languages in one automaton, each also without accents, since many files are plain ASCII."""
    table: dict[str, set[str]] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            forms = {w, "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) if lang not in ("ru", "hi", "uk", "mr") else w}
            if lang == "de":
                forms.add(w.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))
            for f in forms:
                table.setdefault(f, set()).add(lang)
    a = ahocorasick.Automaton()
    for w, langs in table.items():
        a.add_word(f" {w} ", tuple(sorted(langs)))  # with the boundaries, so no other place matches
    a.make_automaton()
    return a


_BETWEEN = regex.compile(r"[^\p{L}\p{M}\p{N}_]+")


def votes(text: str) -> dict[str, float]:
    """One pass of the automaton: each function word at word boundaries votes 1 / (languages that have it)."""
    out: dict[str, float] = {}
    for _, langs in _automaton().iter(f" {_BETWEEN.sub(' ', text.lower())} "):
        for lang in langs:
            out[lang] = out.get(lang, 0.0) + 1 / len(langs)
    return out


_DEVANAGARI, _CYRILLIC = regex.compile(r"\p{Devanagari}"), regex.compile(r"\p{Cyrillic}")
_PROSELIKE = regex.compile(r"^\W*\p{Lu}\p{Ll}|[\p{Ll}][.!?]$")
_HAN, _KANA, _THAI = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Thai}")
_ACCENTS = (("de", regex.compile("[äöüß]")), ("es", regex.compile("[ñ¿¡áíóú]")), ("fr", regex.compile("[éèêëàâçîïôùûœ]")))
#: The spaced languages of each script, and those that may stand beside them; the first is what a text without any function word is taken for.
_OF_SCRIPT = {"hi": ("hi", "mr"), "ru": ("ru", "uk"), "": ("en", "de", "fr", "es")}


def _latin(text: str, v: dict[str, float] | None = None) -> str:
    """Inverse-language-frequency vote among the Latin-script languages; accents settle ties."""
    v = votes(text) if v is None else v
    low = "" if text.isascii() else text.lower()
    score = {lang: v.get(lang, 0.0) + 0.3 * min(3, len(p.findall(low))) for lang, p in _ACCENTS} | {"en": v.get("en", 0.0) + 0.01}
    return max(_OF_SCRIPT[""], key=lambda k: score[k])


def language(text: str, least: int = 3) -> str | None:
    """The language of ``text`` (one block, already undressed) if it is natural language, else None.

    Spaced scripts need ``least`` running words, which make up most of the tokens; one pass of the automaton votes for
    their language, among those of the script that most words have. Script ranges settle the unspaced: Han and kana need 5 letters, Thai 8
    characters. Code, queries, paths, patterns and keys are none, nor is a language outside ``LANGUAGES``.
    """
    plain = text.isascii()
    if not plain:
        kana, han, thai = len(_KANA.findall(text)), len(_HAN.findall(text)), len(_THAI.findall(text))
        if kana + han >= 5 and kana + han >= thai and not (_SQL.search(text) and not _UNSPACED.search(text)):
            return "ja" if kana else "zh"
        if thai >= 8:
            return "th"
    words, tokens = words_of(text)
    if len(words) < least or _SQL.search(text) and (plain or not _UNSPACED.search(text)):
        return None
    spaced = {"hi": 0, "ru": 0, "": 0}
    for w in words:
        spaced["" if w.isascii() else "hi" if _DEVANAGARI.search(w) else "ru" if _CYRILLIC.search(w) else ""] += 1
    script = max(("hi", "ru"), key=lambda k: spaced[k])
    if spaced[script] >= least:
        v = votes(text)
        found = max(_OF_SCRIPT[script], key=lambda k: v.get(k, 0.0))
        return found if found in LANGUAGES else None
    if spaced[""] < least or len(words) < 0.6 * tokens or _CODEISH.search(text) or _SIGNATURE.match(text):
        return None
    v = votes(text)
    if not v and not _PROSELIKE.search(text):
        return None
    return _latin(text, v)


def unit_language(text: str | None) -> str | None:
    """Language of a whole text unit: that of its block with most running words; None if no block is natural language."""
    if not text or not text.strip():
        return None
    best: dict[str, int] = {}
    for _, words in blocks(text):
        if lang := language(words):
            best[lang] = best.get(lang, 0) + len(words)
    return max(best, key=lambda k: best[k]) if best else None
