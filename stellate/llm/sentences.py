"""Sentences of texts in many languages and scripts.

A text is cut into blocks at blank lines, headings, list items and code fences. In a block, places where a sentence may
end are found by its marks, and by spaces between Thai letters. A semi-Markov dynamic programme then chooses the best
sequence of whole spans; a span is scored by its length, the word it opens with, the word and mark it closes with, and
its quotations and brackets, all at once: whether a quotation ends its sentence, for one, depends on where the span
began. All weights stand in one table. A place whose evidence outweighs all that spans can differ by otherwise is an end in
any best sequence, one that can't win is none; only such places are settled beforehand, so that the time is near linear.

Defined results: a null, empty or blank text has no sentences; positions count code points; white space around a
sentence isn't part of it, and everything else is in exactly one; quotation marks without a partner bind nothing; a
fence that isn't closed goes to the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread

# Abbreviations, in lower case and without the last full stop.
#: A sentence doesn't end with these.
_BOUND = frozenset(
    "mr mrs ms dr prof rev gen col lt sgt capt st mt hon sen rep gov pres messrs mx ft e.g i.e cf vs viz approx resp incl excl esp est a.k.a ca c ver "
    "bzw vgl z.b d.h z.t u.a u.u ggf evtl inkl exkl sog bd hrn fr dipl i.d.r s.o s.u o.ä abb "
    "mm mme mmes mlle mgr c.-à-d p.ex chap réf éd "
    "sra srta dra dña ud uds p.ej pág págs aprox núm ee e.d "
    "напр см рис табл т.е т.к т.н стр гл ул проф им ок т.о "
    "π.χ κ κα κος δηλ βλ σελ αρ αριθμ δρ "
    "डॉ श्री श्रीमती प्रो د أ أ.د م".split()
)
#: Nor with these before a number.
_NUMBERED = frozenset("no nos nr fig figs tab eq eqs ch sec art vol vols pp p pg para par ex app abs kap s n num cap с г п ч".split())
#: A sentence may end with these if the next begins like one.
_OPEN = frozenset(
    "etc usw al inc ltd co corp llc plc bros jr sr a.m p.m u.s e.u u.k u.n min hr hrs env uu ee.uu т.д т.п др гг r.v ff ecc ste dept "
    "jan feb mar apr jun jul aug sept sep oct nov dec κ.λπ κλπ κ.ά".split()
)
#: Words that begin sentences more often than names.
_OPENERS = frozenset("the a an it its this that these those we you they he she i in on at if when while there here our their his her my no not do does did is are was were what why how who where and but or so for from to".split())
#: Words before a single capital that make it a name of its own, not an initial.
_LETTERED = frozenset("plan option type class group part step vitamin team grade section appendix model variant node point exhibit version column row".split())
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
_ARTICLES = frozenset("der die das den dem des am im vom zum zur beim jeder jede jedes jeden ein eine einen einem einer eines seit bis und oder".split())
_SAID = re.compile(r"[.,]*(said|says|asked|asks|replied|answered|wrote|shouted|added|explained)[.,]*", re.A | re.I)
#: What follows up to a Thai letter or the line's end, and in it the first mark that closes a sentence.
_FOREIGN = re.compile(r"[^฀-๿\n\r]*")
_CLOSED = re.compile(r".*?[.!?](?=\s|$)", re.S)

_KNOWN = _BOUND | _OPEN | _NUMBERED | _MONTHS

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "〔": "〕", "“": "”", "‘": "’", "«": "»", "‹": "›", "„": "“", "‚": "‘", "»": "«", '"': '"', "`": "`", "＂": "＂"}
_BRACKETS = frozenset("([{（［【〔")
_MARK = re.compile(r"[()\[\]{}（）［］【】「」『』《》〈〉〔〕“”‘’«»‹›„‚\"`＂]")
_CLOSERS = frozenset(")]}）］】」』》〉〕”’»›\"'＂")
_EDGES = frozenset("）］】」』》〉〕。！？，、：；…”»")
_STRONG = "。！？｡।॥؟۔‼⁇⁈⁉．።။།។៕։"
_TERM = re.compile(rf"[.!?…{_STRONG}]+|[;;]|(?<=[฀-๿])\s+(?=\S)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEAD = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_ITEM = re.compile(r"\s*(?:[-*+•‣◦▪●○·–]|(\d{1,4})[.)]|\(?[a-zA-Z]\))(?=\s)\s*")
_LINE = re.compile(r"[^\r\n  \x0b\x0c\x85]*(?:\r\n|[\r\n  \x0b\x0c\x85]|$)")
_SPEAKER = re.compile(r"[\w.\-]{1,24}(?: [\w.\-]{1,24})?\s?[:：]\s+")
_WORD = re.compile(r"[^\s]+")
#: What the parts of a span weigh. Closings: how its last word or mark speaks for an end, given the word that opens the next
#: span; openings: what it begins with; shapes: the span as a whole.
WEIGHTS = {
    # Closings by a full stop.
    "word": 4.0, "unit": 4.0, "bracketed": 4.0, "bare": 1.0, "abbreviation": -6.0, "numbered": -6.0, "initial": -4.0, "lettered": 3.0,
    "may end": 2.5, "may end, number": -4.0, "list, number": 1.0, "title": 1.0, "place": -1.0, "ordinal": -5.0,
    "short, small letter": -6.0, "ordinal, small letter": -6.0, "word, small letter": 1.0,
    # Closings by other marks.
    "strong": 5.0, "question": 4.0, "question, small letter": 1.0, "question, joined": -6.0, "semicolon": 4.0, "semicolon, small letter": -4.0,
    "dots, low": -6.0, "dots, name": -1.0, "dots, digit": -1.0, "dots": 2.0, "dots apart": -1.0, "dots, joined": 1.0, "dots, han": 4.0, "dots, within": -6.0,
    "mixed": 4.0, "mixed, within": -6.0, "space": 4.0,
    # Closings by a quotation or bracket that ends with a mark of its own.
    "bracket after a sentence": 3.0, "bracket within one": -2.0, "bracket, joined": -6.0, "announced": 4.0, "quotation": 3.0, "said": 3.0, "said at the start": 1.0, "quotation, joined": -4.0,
    # Openings: a span that begins with the quotation that ends it.
    "opens: bracket": 4.0, "opens: joined": -4.0, "opens: announced": 4.0, "opens: said": -4.0, "opens: quotation": 1.5, "opens: no case": -2.0,
    # Shapes.
    "one letter": -1.0, "few letters": -0.4, "no word": -1.5, "longest": -0.8,
}
#: From so many letters on a span counts as long, and from the last number on all weigh alike.
_USUAL, _LONG = 400, 2000
#: An end of less evidence can't win.
_NEVER = -3.0


def _script(c: str) -> str:
    n = ord(c)
    if 0xE00 <= n <= 0xE7F:
        return "thai"
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "greek"
    if 0x3040 <= n <= 0x30FF or 0x3400 <= n <= 0x9FFF or 0xF900 <= n <= 0xFAFF or 0x20000 <= n <= 0x3FFFF:
        return "han"
    if n < 0x250 or 0x1E00 <= n <= 0x1EFF:
        return "latin"
    return "other"


def blocks(text: str) -> list[tuple[int, int, int, bool]]:
    """(begin, end, begin of what may be split, whether it may be) of each block."""
    out: list[tuple[int, int, int, bool]] = []
    begin, inner, fence, at, size, previous, last = -1, -1, "", 0, len(text), "blank", ""

    def flush(end: int) -> None:
        nonlocal begin
        if begin >= 0:
            out.append((begin, end, inner, True))
            begin = -1

    while at < size:
        m = _LINE.match(text, at)
        end = m.end()
        line = text[at:end]
        body = line.strip()
        if fence:
            if body.startswith(fence) and not body.strip(fence[0]):
                out.append((begin, end, end, False))
                begin, fence, previous = -1, "", "fence"
            at = end
            continue
        if not body:
            flush(at)
            previous = "blank"
        elif (f := _FENCE.match(line)) and not (f[1][0] == "`" and "`" in line[f.end() :]):
            flush(at)
            begin, fence = at, f[1]
        elif _HEAD.match(line):
            flush(at)
            out.append((at, end, end, False))
            previous = "head"
        else:
            item = _ITEM.match(line)
            if item and item[1] and previous == "text":
                # A number in running text is no mark of a list, unless a sentence ends before it.
                if item[1] != "1" and last not in ".!?:：。！？":
                    item = None
                elif begin >= 0 and not item[0].rstrip().endswith(")") and last not in ".!?:：。！？":
                    item = None
            if item:
                flush(at)
                begin, inner, previous = at, at + item.end(), "item"
            elif begin < 0:
                begin = inner = at
                previous = "text"
        last, at = body[-1:] or last, end
    if fence:
        out.append((begin, size, size, False))
    else:
        flush(size)
    return out


def _pairs(s: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(open, close) of matched quotation marks and brackets; inner ones included."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how often each closing mark is on the stack
    out = []
    for m in _MARK.finditer(s, begin, end):
        c, at = m[0], m.start()
        after = s[at + 1] if at + 1 < end else " "
        if waiting.get(c) and not (c == "’" and after.isalnum()):
            while True:
                closer, start = stack.pop()
                waiting[closer] -= 1
                if closer == c:
                    break
            out.append((start, at))
        elif c in _PAIRS:
            if c in '"`＂' and after.isspace():
                continue
            if c == '"' and at > begin and s[at - 1].isdigit() and not after.isalpha():
                continue  # inches
            closer = _PAIRS[c]
            stack.append((closer, at))
            waiting[closer] = waiting.get(closer, 0) + 1
    return out


_BEGIN = re.compile(r"[^\W_]|[<$#@]")
_PARTS = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{0,2}")


@lru_cache(maxsize=1 << 16)
def _kind(word: str) -> tuple[str, str]:
    """The kind of a word, and its core: low, up, digit, name (like a file's or a setting's), none (without case)."""
    core = word.rstrip(".,;:!?…)]}»”’\"'。，！？")
    c = word[0]
    if c.isdigit():
        return "digit", core
    if c.islower():
        odd = any(x.isdigit() or x in "_./\\@=" or x.isupper() for x in core[1:]) and not _PARTS.fullmatch(core + ("." if word[len(core) : len(core) + 1] == "." else ""))
        return ("name" if odd else "low"), core
    return ("up" if c.isupper() else "none"), core


def _next(s: str, at: int, end: int) -> tuple[str, str]:
    """The kind of the word that begins at or behind a place, and the word; end if there is none."""
    if at < end and s[at].isalnum():
        return _kind(_WORD.match(s, at, end)[0])
    m = _BEGIN.search(s, at, end)
    return _kind(_WORD.match(s, m.start(), end)[0]) if m else ("end", "")


_TAIL = re.compile(rf"[^\s{re.escape(''.join(sorted(_EDGES)))}]*\Z")


def _before(s: str, begin: int, at: int) -> str:
    """The word that ends at a place; it begins behind white space, a mark of another script, or a sentence joined to it."""
    word = s[max(begin, at - 40) : at].rpartition(" ")[2]
    if word.isalnum():
        return word
    word = _TAIL.search(word)[0]
    joined = word.rfind(".")
    if joined > 1 and word[joined - 2 : joined].isalpha() and word[joined - 2 : joined].islower() and word[joined + 1 : joined + 2].isupper():
        word = word[joined + 1 :]
    first = _BEGINS.search(word)
    return word[first.start() :] if first else ""


_BEGINS = re.compile(r"[^\W_]")


def _lowly(low: str, joint: str, previous: str) -> str:
    """As _full_stop, before a small letter: the end of a sentence only after an ordinary word or number."""
    if low in _OPEN or joint in _OPEN or low in _NUMBERED or len(low) < 3 and low.isalpha() or "." in low.strip(".") and not low[:1].isdigit() and len(low) < 8:
        return "short, small letter"
    if low[:1].isdigit():
        return "ordinal, small letter" if previous in _ARTICLES or len(low) < 2 else "word, small letter"
    return "word, small letter"


def _full_stop(s: str, begin: int, at: int, after: int, end: int) -> str:
    """How the full stop at a place closes a sentence; after: where the next word begins."""
    word = _before(s, begin, at)
    kind, nxt = _next(s, after, end)
    low = word.lower()
    if kind == "up" and len(word) > 4 and low == word and word.isascii() and word.isalpha() and low not in _KNOWN:
        return "word"
    a = at - len(word)
    while a > begin and s[a - 1].isspace():
        a -= 1
    previous = _before(s, begin, a - 1 if a > begin and s[a - 1] == "." else a).lower() if a > begin else ""
    stopped = a > begin and s[a - 1] == "."
    joint = f"{previous}.{low}" if stopped else ""
    ahead = f"{low}.{nxt.lower().rstrip('.')}"
    if low == "ms" and previous[:1].isdigit():
        return "unit"
    if low in _BOUND or joint in _BOUND or ahead in _BOUND or ahead in _OPEN and len(nxt) <= 3:
        return "abbreviation"
    if low in _NUMBERED and kind == "digit" and not (previous[:1].isdigit() and len(low) == 1):
        return "numbered"
    if kind == "low":
        return _lowly(low, joint, previous)
    if len(word) == 1 and word.isupper() and word.isalpha():
        return "lettered" if previous in _LETTERED and not stopped else "initial"
    if low in _OPEN or joint in _OPEN:
        listed, titled = low in ("etc", "usw", "κλπ") or joint in ("т.д", "т.п"), low in ("uu", "inc", "co", "ltd", "corp", "jr", "sr")
        if kind in ("digit", "name"):
            return "list, number" if listed else "may end, number"
        if (titled or low in ("u.s", "e.u", "u.k", "u.n")) and nxt.lower() not in _OPENERS:
            return "title" if titled else "place"
        return "may end"
    if word.isdigit() or re.fullmatch(r"\d{1,2}\.\d{1,2}", word):
        if nxt.lower() in _MONTHS or word.isdigit() and len(word) <= 2 and previous in _ARTICLES and kind == "up":
            return "ordinal"
    if not word:
        return "bracketed" if a < at else "bare"
    return "word"


def _joined(s: str, begin: int, at: int, after: int, end: int) -> bool:
    """Whether a full stop without a space behind it may end a sentence: a word's or number's, before a capital or in a script without case."""
    c = s[after]
    if not (c.isupper() or c in "¿¡«„“\"（「" or c.isalpha() and not c.islower()):
        return False
    a = at
    while a > begin and (s[a - 1].isalnum() or s[a - 1] in "_-"):
        a -= 1
    word = s[a:at]
    if not word:
        return at > begin and s[at - 1] in _CLOSERS and (c.isupper() or c in "¿¡«„“\"（「")
    if c in "¿¡«„“「（":
        return len(word) > 1
    if c.isupper():
        n = s[after + 1 : after + 2]
        initial = n == "." and s[after + 2 : after + 3].isspace() and s[after + 3 : after + 4].isupper()
        return (len(word) > 1 or word.isdigit()) and not word.isupper() and (initial or n.islower() or n.isspace() or n in "'’" or _script(c) != "latin")
    if c.isalpha() and not c.islower() and not c.isdigit():
        same = _script(s[at - 1]) == _script(c) != "latin" and not s[at - 1].isdigit()
        return same or len(word) > 2 and word.isalpha() and word.islower() and "." not in _before(s, begin, at)
    return False


def _candidates(s: str, begin: int, end: int) -> list[tuple[int, float, float, int]]:
    """(end of a span, weight of its closing, and if the span began with the quotation that ends here, where that opens or -1)."""
    pairs = _pairs(s, begin, end)
    closing = {c for _, c in pairs}
    outer: list[tuple[int, int, int]] = []  # opening mark, closing mark, end of what is said between them
    for o, c in sorted(pairs):
        if not outer or o > outer[-1][1]:
            inner = c
            while inner > o and (s[inner - 1].isspace() or s[inner - 1] in _CLOSERS):
                inner -= 1
            outer.append((o, c, inner))
    opens = [o for o, _, _ in outer]
    words: list[tuple[int, int]] = []  # of the whole block, once they are asked for
    out = []
    skip = begin
    for m in _TERM.finditer(s, begin, end):
        at, stop = m.span()
        if at < skip:
            continue
        mark = m[0]
        inside = bisect_right(opens, at) - 1 if opens else -1
        within = outer[inside] if inside >= 0 and outer[inside][1] > at else None
        if mark.isspace():
            if within is None:
                out += _thai(s, begin, at, stop, end)
            continue
        opener = -1
        if within is not None:
            # Only at the very end of the outermost quotation can a sentence end; what follows decides.
            if stop < within[2]:
                continue
            opener, stop = within[0], within[1] + 1
            skip = stop
        while stop < end and s[stop] in _CLOSERS and stop not in closing and s[stop] not in "\"'":
            stop += 1
        after = stop
        while after < end and s[after].isspace():
            after += 1
        if after >= end:
            continue
        spaced = after > stop
        if opener >= 0:
            if s[after] in f".!?{_STRONG}" + ",;:、，；：،":
                continue
            words = words or [w.span() for w in _WORD.finditer(s, begin, end)]
            score = _quoted(s, begin, opener, stop, after, *_next(s, after, end), spaced, words)
            if score:
                out.append((stop, WEIGHTS[score[0]], WEIGHTS[score[1]], opener))
            continue
        closed = _closed(s, begin, at, mark, after, spaced, end)
        if closed:
            score = WEIGHTS[closed]
            if closed.startswith("dots") and spaced and at > begin and s[at - 1].isspace():
                score += WEIGHTS["dots apart"]
            if score > _NEVER:
                out.append((stop, score, score, -1))
    return out


def _closed(s: str, begin: int, at: int, mark: str, after: int, spaced: bool, end: int) -> str | None:
    """How a mark outside of quotations closes a sentence, given what opens the next; None if it can't."""
    c = mark[-1]
    if mark == ".":
        return _full_stop(s, begin, at, after, end) if spaced or _joined(s, begin, at, after, end) else None
    if c in ";;":
        if at == begin or _script(s[at - 1]) != "greek" or not spaced and not s[after].isupper():
            return None
        return "semicolon" if _next(s, after, end)[0] != "low" else "semicolon, small letter"
    if c in _STRONG:
        return "strong"
    if c == "…" or len(mark) > 1 and set(mark) == {"."}:
        if spaced:
            kind = _next(s, after, end)[0]
            return f"dots, {kind}" if kind in ("low", "name", "digit") else "dots"
        if c == "…" and at > begin and _script(s[at - 1]) == "han":
            return "dots, han"
        return "dots, joined" if s[after].isupper() and s[after + 1 : after + 2].islower() else "dots, within"
    if c in "!?":
        kind = _next(s, after, end)[0]
        if spaced:
            return "question, small letter" if kind == "low" else "question"
        good = _script(s[after]) in ("han", "thai") or s[after] in "“「『（《¿¡«„" or s[after].isupper() or kind == "none" and _script(s[after]) != "latin"
        return "question" if good else "question, joined"
    return "mixed" if spaced and _next(s, after, end)[0] != "low" else "mixed, within"


def _quoted(s: str, begin: int, opener: int, stop: int, after: int, kind: str, nxt: str, spaced: bool, words: list[tuple[int, int]]) -> tuple[str, str] | None:
    """How a quotation or bracket that itself ends with a mark closes a span; else and if the span began with it."""
    if kind == "low" or kind == "end":
        return None
    if s[after] in "—–-" and spaced:
        return None
    a = opener
    while a > begin and s[a - 1].isspace():
        a -= 1
    lead = s[a - 1 : a] if a > begin else ""
    if s[opener] in _BRACKETS:
        if spaced:
            return ("bracket after a sentence" if lead in f".!?…{_STRONG}" else "bracket within one"), "opens: bracket"
        return ("bracket after a sentence" if lead in _STRONG else "bracket, joined"), "opens: bracket"
    if not spaced and kind != "up":
        # A particle or a verb of saying goes on, unless the quotation was announced.
        if s[after] in "とってでがをはにのもやなかだ、라고하는며은는이가을를도":
            return None
        return ("announced" if lead in ":：,，" else "quotation, joined"), "opens: joined"
    if lead in ":：,，،":
        return "announced", "opens: announced"
    first = bisect_right(words, after, key=lambda w: w[1])
    if any(_SAID.fullmatch(s, max(after, a), b) for a, b in words[first : first + 3]):
        return ("said" if lead else "said at the start"), "opens: said"
    return "quotation", ("opens: no case" if kind == "none" and _script(s[after]) != "han" else "opens: quotation")


def _thai(s: str, begin: int, at: int, stop: int, end: int) -> list[tuple[int, float, float, int]]:
    """A space after a Thai letter ends a sentence unless a number or a Latin word stands beside it."""
    if s[at - 1] in "ๆฯ" or stop >= end:
        return []
    c = s[stop]
    if c in "“\"'(（«「[" and stop + 1 < end:
        c = s[stop + 1]
    kind = _script(c)
    if kind == "thai":
        return [(at, WEIGHTS["space"], WEIGHTS["space"], -1)]
    if not c.isalnum():
        return []
    if c.isdigit() or kind == "latin":
        # A whole sentence in another language: several words, a capital first, its own mark at the end.
        # No other Thai space lies within, so every run is searched once.
        closed = _CLOSED.match(_FOREIGN.match(s, stop, end)[0]) if c.isupper() else None
        if closed and len(closed[0].split()) >= 3:
            return [(at, WEIGHTS["space"], WEIGHTS["space"], -1)]
        return []
    return [(at, WEIGHTS["space"], WEIGHTS["space"], -1)]


def _shape(size: int, word: bool) -> float:
    """What a span weighs as a whole: very short and very long ones are less likely, and those without a word."""
    length = WEIGHTS["one letter"] if size < 2 else WEIGHTS["few letters"] if size < 4 else 0.0 if size < _USUAL else max(WEIGHTS["longest"], WEIGHTS["longest"] * (size - _USUAL) / (_LONG - _USUAL))
    return length if word else length + WEIGHTS["no word"]


def spans(text: str | None) -> list[tuple[int, int]]:
    """(begin, end) of each sentence."""
    if not text:
        return []
    out = []
    for begin, end, inner, splits in blocks(text):
        cuts = [begin, *(_choose(text, begin, inner, end) if splits else ()), end]
        for a, b in zip(cuts, cuts[1:]):
            part = text[a:b]
            left = len(part) - len(part.lstrip())
            if left < len(part):
                out.append((a + left, a + len(part.rstrip())))
    return out


_SPACE, _LETTER = re.compile(r"\s*"), re.compile(r"[^\W\d_]")


def _choose(s: str, begin: int, inner: int, end: int) -> list[int]:
    """The ends of spans in a block, but for the last, by dynamic programming over whole spans.

    A span weighs what its closing does, given how it opens: a closing quotation weighs otherwise where the span began with
    it. To this comes its shape. Where it begins is thus decided together with where it ends.
    """
    places = _candidates(s, inner, end)
    if not places:
        return []
    ends = [begin, *[p[0] for p in places], end]
    size = len(ends)
    word = [m.start() if (m := _LETTER.search(s, a, end)) else end for a in ends]  # where the first letter behind each end is
    label = _SPEAKER.match(s, inner, end)
    heads = [-1] * size  # where a span begins with the quotation that ends here
    more = [0.0] * size  # what a closing quotation could weigh more if no span began at an end
    for j in range(1, size - 1):
        plain, opening, opener = places[j - 1][1:]
        if opener >= 0:
            head = bisect_right(ends, opener, 0, j) - 1
            start = ends[head] if head else min(label.end(), opener) if label else inner
            if _SPACE.match(s, start, opener).end() == opener:
                heads[j] = head
                more[head] = max(more[head], max(0.0, plain) - max(0.0, opening))
    # The least that the shortest span, or any longer one, between two neighbouring ends can weigh.
    least = [0.0, *[min(_shape(ends[j] - ends[j - 1], word[j - 1] < ends[j]), WEIGHTS["longest"]) for j in range(1, size)], 0.0]
    sure = [min(p[1], p[2]) > more[j] - least[j] - least[j + 1] for j, p in enumerate(places, 1)]
    if all(sure):
        return ends[1:-1]  # no other sequence can weigh more
    best, back = [0.0] + [float("-inf")] * (size - 1), [0] * size
    firm = 0  # the last place at which every best sequence has an end
    near, far = 0, -1  # spans from before near are so long that they differ no more by shape; far is the best of their begins
    for j in range(1, size):
        plain, opening = places[j - 1][1:3] if j < size - 1 else (0.0, 0.0)
        while near < j and ends[j] - ends[near] >= _LONG:
            if far < 0 or best[near] > best[far]:
                far = near
            near += 1
        begins, head = [*range(max(near, firm), j)], heads[j]
        if far >= firm:
            begins.append(far)
        if head >= firm:
            begins.append(head)
        for i in begins:
            score = best[i] + _shape(ends[j] - ends[i], word[i] < ends[j]) + (opening if i == head else plain)
            if score > best[j]:
                best[j], back[j] = score, i
        if j < size - 1 and sure[j - 1]:
            firm, near, far = j, j, -1
    cuts = []
    j = back[size - 1]
    while j > 0:
        cuts.append(ends[j])
        j = back[j]
    return cuts[::-1]


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char): a row for each sentence of each text."""
    schema = pa.schema([(key, pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())])

    def split(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for a, b in spans(value.as_py()):
                    ids.append(n)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=schema)

    return spread(docs.select(key, text)).mapInArrow(split, f"{key} long, start_char long, end_char long")
