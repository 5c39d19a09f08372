"""Sentence boundaries across languages and scripts.

The standard character properties of text segmentation (Sentence_Break: STerm, ATerm, Close, SContinue, Upper, Lower, OLetter) find the candidate ends in all scripts;
rules then tailor them: paragraph separators end a unit unless the text is hard-wrapped there; full stops of abbreviations, initials, numbers, list numbers, addresses
and file names are suppressed, abbreviations by the language that the text's script and small words tell; an ellipsis goes on before a small letter; quotations and brackets are whole: nothing inside ends the unit, and one that
closes with a terminator ends it only if it stands alone or a new sentence visibly starts. Thai, without terminators, ends units at blanks between Thai phrases, except
around numerals and after the repetition mark.

Header lines (``****``) and theme lines (``-*``) are no units. A unit starts with its first visible character.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _property(value: str) -> str:
    return "".join(regex.findall(rf"\p{{Sentence_Break={value}}}", _ALL))


_STERM, _ATERM = _property("STerm"), _property("ATerm")
_ELLIPSIS = "…‥"
_STRONG = frozenset(_STERM)
_CONTINUES = frozenset(_property("SContinue"))
#: Quotation marks and brackets that open and what closes them.
_CLOSES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "‹": "›", "‚": "‘’"}
#: Brackets of all scripts: the opening marks of property Close whose closing mark follows them in the code charts.
_CLOSES |= {c: chr(ord(c) + k) for c in _property("Close") for k in (2, 1) if unicodedata.category(c) == "Ps" and unicodedata.category(chr(ord(c) + k)) == "Pe"} | _CLOSES
_OPENERS = frozenset(_CLOSES) | frozenset("¿¡\"'‘")
_CLOSERS = "".join(dict.fromkeys("".join(_CLOSES.values()))) + "\"'"
_PAIRED = frozenset("".join(_CLOSES) + "".join(_CLOSES.values()))
_TERMINATORS = frozenset(_STERM + _ATERM + _ELLIPSIS)


@lru_cache(maxsize=4096)
def _patterns(ends: str, marks: str) -> tuple[re.Pattern | None, re.Pattern | None]:
    """Patterns for runs of terminators with their closing marks and for paired marks, of those characters only that the text has: small classes match faster."""
    closers = re.escape("".join(c for c in _CLOSERS if c in marks or c in "\"'"))
    end = re.compile(rf"([{re.escape(ends)}]+)((?:[\u00a0\u202f]?»)?[{closers}]*)") if ends else None
    return end, re.compile(f"[{re.escape(marks)}]") if marks else None


_VISIBLE = re.compile(r"[^\s\u200b-\u200f\u2060\ufeff\u00ad]")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_THAI = re.compile(r"[\u0e00-\u0e7f]")
#: A blank between Thai phrases, or between Thai and another script.
_THAI_BLANK = re.compile(r"(?<=[ก-ๅ\u0e47-๛])[ \u00a0\u3000]+(?=\S)|(?<=[^\s\u0e00-\u0e7f])[ \u00a0]+(?=[\u0e00-\u0e7f])")
#: What a line starts with that can't be the middle of a sentence: bullets, list and article numbers, time marks, speaker labels.
_LEAD = re.compile(
    r"\s*(?:[-–*•·▪◦]\s|—\s(?=[A-ZÀ-ÞА-ЯΆ-Ϋ“«¿¡])|\d+(?:\.\d+)*[.)]\s|\(?[a-zа-я]\)\s|[IVXLC]+\s[–—-]\s|\[\d+:\d|§|Art\.\s\d|(?:[A-ZÀ-ÞА-Я]{1,20}\d{0,2}|[A-ZÀ-Þ]\w{2,20}\(\w\)):\s)"
)
#: A list or article number that opens a unit: its full stop ends nothing.
_NUMBER = re.compile(r"\W*(?:\d+(?:\.\d+)*|[a-zA-Z]|[IVXLC]+)\.$")

#: Abbreviations by language that are followed by what they belong to.
ABBREVIATIONS = {
    "pt": "sr sra srta dr dra drs prof profa profª eng exmo exma ex exa v vs d dª pe cap gen cel sgt rev art arts pág págs p pp cf av tel séc vol n nº núm aprox obs fig cap op cit al r pç ed min máx",
    "es": "sr sra srta dr dra d dña ing lic prof profa gral cap art arts pág págs núm s vol aprox p ej cf av tel fig ed vs",
    "fr": "m mm mme mlle mgr dr pr me st ste art vol p pp ex env av cf tél fig éd chap réf no vs",
    "en": "mr mrs ms dr st gen capt lt col sgt rev prof hon messrs no nos p pp vol sec fig eq ch cf e.g i.e vs approx ca viz al ed eds dept",
    "de": "hr fr hl dr prof dipl ing dipl.-ing nr bd s z u a b d h vgl ca bzw abs art st str tel ggf evtl sog inkl kap abb hrsg jh",
    "ru": "г гг им акад проф доц д-р рис стр см табл т е к п ок ст ул др напр пр гл тыс млн млрд руб кв",
    "el": "κ κα κος δρ καθ αρ σελ βλ δηλ π.χ π χ τηλ οδ αι παρ",
    "ar": "د أ م ص",
    "hi": "ड\u0949 श\u094dर\u0940 श\u094dर\u0940मत\u0940 प\u094dर\u094b स\u0902",
}
#: Abbreviations that may end a sentence; one does if a capital follows.
FINAL = {
    "pt": "etc ltda cia s.a jr",
    "es": "etc cía sl s.l hnos",
    "fr": "etc j.-c cie",
    "en": "etc inc ltd co corp jr sr p.m a.m",
    "de": "usw etc ä co u.a u.ä gmbh o.ä",
    "ru": "д др пр т.д т.п п",
    "el": "κ.λπ κ.ά λπ",
}
_POOLED = frozenset(w for words in ABBREVIATIONS.values() for w in words.split())
_MAY_END = frozenset(w for words in FINAL.values() for w in words.split())
#: Abbreviations that are words of their own language too; in any language they suppress a full stop before a number, and only there.
BEFORE_NUMBERS = frozenset("no nos art arts".split())
#: Abbreviations of one language that are words, or letters, of another; they hold in their own language only. Titles and the like hold wherever they are met,
#: as texts quote names across languages.
ELSEWHERE_WORDS = frozenset("me al min max gen col sec fig pe ex cap av hon rev ed est app ch obs am as".split())
#: Small words that tell languages of the Latin script apart.
SMALL_WORDS = {
    "pt": "o os as um uma em no na nos nas do da dos das ao aos que não com para por mais foi ele ela eu seu sua e também já é são",
    "es": "el los las un una en del al que no con para por más fue él ella yo su sus y también ya es son dije pero como",
    "fr": "le les un une des en dans du au aux que ne pas avec pour par plus fut il elle je son sa ses et aussi est sont nous vous",
    "en": "the a an of in on to and that not with for by more was he she i his her it is are we you said then me my at",
    "de": "der die das ein eine den dem des in im zu und dass nicht mit für von mehr war er sie ich sein ihr es ist sind wir meine auf",
}
_SMALL = {k: frozenset(v.split()) for k, v in SMALL_WORDS.items()}
_WORDS = re.compile(r"[^\W\d_]+")
#: How many times as often the small words of one language must come as those of another to rule the other out, and how many tell without the hint.
CLEARLY, ENOUGH = 1.5, 3


@lru_cache(maxsize=64)
def _abbreviations(latin: frozenset[str]) -> frozenset[str]:
    """Abbreviations of some languages of the Latin script and of all other scripts, whose letters keep them apart."""
    return frozenset(w for k, words in ABBREVIATIONS.items() if k in latin or k not in _SMALL for w in words.split())


def languages(text: str, lang: str | None = None) -> frozenset[str]:
    """The languages of the Latin script that the text may be in: those whose small words are most frequent. Where these say little, ``lang`` counts too; where nothing is
    known, all. ``lang`` may be wrong or null."""
    counts = dict.fromkeys(_SMALL, 0)
    for w in _WORDS.findall(text.lower()):
        for k, words in _SMALL.items():
            counts[k] += w in words
    best = max(counts.values())
    found = {k for k, n in counts.items() if n and n * CLEARLY >= best}
    hint = (lang or "").strip().lower()[:2]
    if best < ENOUGH and hint in _SMALL:
        found.add(hint)
    return frozenset(found or _SMALL)
#: Words after a quotation that report it, in scripts or styles where letter case doesn't tell.
REPORTING = frozenset(
    "disse perguntou respondeu contou falou afirmou explicou dijo preguntó respondió contó explicó dit demanda demande répondit raconta said asked told replied answered "
    "sagte fragte antwortete erzählte сказал сказала спросил спросила ответил ответила рассказал рассказала είπε ρώτησε απάντησε διηγήθηκε "
    "قال قالت سأل سألت أجاب أجابت न\u0947 አለ አለች አሉ ጠየቀ ጠየቀች".split()
)
_WORD_BEFORE = re.compile(r"[\w.\-ºª\u0300-\u036f\u0900-ॿ]+$")
_WORD_AFTER = re.compile(r"[\w\u0300-\u036f\u0900-ॿ]+")
_A_NUMBER = re.compile(r"[\d#(°º]|[IVXLC]+\b")
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]")
#: Spaced abbreviations that are no initials of a person: a company's form, or three letters and more after a small word that is no title.
_COMPANY = re.compile(r"[a-zà-ÿα-ώа-я]\s(?:[Ss]\.\s[Aa]|(?!D\.)(?:[^\W\d_]\.\s){2,}[^\W\d_])$")
_SMALL_START = re.compile(r"[a-zß-öø-ÿа-яα-ωά-ώ]{4,}[.!?]\s+([^\W\d_])")


def small_style(text: str) -> bool:
    """Whether sentences of the text start with small letters."""
    small = capital = 0
    for c in _SMALL_START.findall(text):
        if c.islower():
            small += 1
        elif c.isupper():
            capital += 1
    return small > capital


def _lines(text: str) -> list[list[tuple[int, int]]]:
    """Blocks of adjacent lines that aren't blank, header or theme lines, as spans."""
    blocks: list[list[tuple[int, int]]] = []
    last = None
    for m in _LINE.finditer(text):
        a, b = m.span()
        line = m.group()
        if not _VISIBLE.search(line) or line.startswith("****") or line.startswith("-*"):
            last = None
            continue
        gap = text[last:a] if last is not None else "\n\n"
        if last is None or len(gap.replace("\r\n", "\n")) > 1:
            blocks.append([])
        blocks[-1].append((a, b))
        last = b
    return blocks


def _wrapped(text: str, blocks: list[list[tuple[int, int]]]) -> bool:
    """Whether lines were broken at a width: nearly every line is about as long as it could be, and lines end in mid-sentence."""
    pairs = [(x, y) for lines in blocks for x, y in zip(lines, lines[1:])]
    if not pairs:
        return False
    width = max(b - a for lines in blocks for a, b in lines)
    if not 30 <= width <= 130:
        return False
    full = small = open_ = capital = n = 0
    for (a, b), (c, d) in pairs:
        line, following = text[a:b].rstrip(), text[c:d].lstrip()
        if _LEAD.match(following):
            continue
        n += 1
        full += len(line) + 1 + len(following.split(None, 1)[0]) >= 0.78 * width
        small += following[0].islower()
        capital += following[0].isupper() and not following[:3].isupper()
        open_ += line[-1] not in _STRONG and line[-1] not in _ATERM and line[-1] not in _CLOSERS
    if not n or full < 0.7 * n:
        return False
    return small >= 0.4 * n or (n > 1 and not capital and open_ >= 0.5 * n and full == n)


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans within which a line break is no boundary."""
    blocks = _lines(text)
    wrapped = _wrapped(text, blocks)
    for lines in blocks:
        if not wrapped:
            yield from lines
            continue
        start = lines[0][0]
        for (_, b), (c, _) in zip(lines, lines[1:]):
            if _LEAD.match(text, c):
                yield start, b
                start = c
        yield start, lines[-1][1]


def _spans(x: str, marks: re.Pattern | None) -> dict[int, tuple[int, int]]:
    """Matched quotations and brackets: the position of the closing mark -> (opening mark, closing mark), outermost ones by nesting."""
    stack: list[tuple[str, int]] = []
    closed: dict[int, tuple[int, int]] = {}
    for m in marks.finditer(x) if marks else ():
        c, at = m.group(), m.start()
        for k in range(len(stack) - 1, -1, -1):
            if c in _CLOSES[stack[k][0]]:
                closed[at] = (stack[k][1], at)
                del stack[k:]
                break
        else:
            if c in _CLOSES:
                stack.append((c, at))
    return closed


def _ends(x: str, small: bool, known: frozenset[str], patterns: tuple[re.Pattern | None, re.Pattern | None], thai: bool) -> list[int]:
    """Offsets at which new units start within a paragraph, after the first."""
    starts: list[int] = []
    end, marks = patterns
    cover = sorted(_spans(x, marks).values())
    merged: list[tuple[int, int]] = []
    for a, b in cover:
        if merged and a < merged[-1][1]:
            continue
        merged.append((a, b))
    which = 0
    first = _VISIBLE.search(x)
    begin = first.start() if first else 0
    ends = [(m.start(), m.end(1), m.end()) for m in (end.finditer(x) if end else ())]
    if thai:
        ends = sorted(ends + [(m.start(), -1, m.end()) for m in _THAI_BLANK.finditer(x)])
    for at, term, after in ends:
        if after <= begin:
            continue
        if term == -1:
            prev, nxt = x[at - 1], x[after]
            if prev.isdigit() or nxt.isdigit() or prev in _CONTINUES or nxt in _CONTINUES or prev in _STRONG or prev in "([«“" or nxt in ")]»”":
                continue
            if not _THAI.match(prev) and prev not in _ATERM and not x[begin:at].strip():
                continue
            if not _THAI.match(prev) and (prev in _ATERM or not prev.isalnum()):
                continue
            if any(a < at < b for a, b in merged) or _LEAD.fullmatch(x, begin, after):
                continue
            starts.append(after)
            begin = after
            continue
        # trailing closers that close nothing here belong to the unit too
        while which < len(merged) and merged[which][1] < at:
            which += 1
        outer = merged[which] if which < len(merged) and merged[which][0] < at else None
        if outer and after <= outer[1]:
            continue
        seen = _VISIBLE.search(x, after)
        if not seen:
            break
        k = seen.start()
        nxt, gap = x[k], k > after
        if _boundary(x, begin, at, term, after, k, nxt, gap, outer, small, known):
            starts.append(k)
            begin = k
    return starts


def _boundary(x: str, begin: int, at: int, term: int, after: int, k: int, nxt: str, gap: bool, outer: tuple[int, int] | None, small: bool, known: frozenset[str]) -> bool:
    marks = x[at:term]
    if nxt in _CONTINUES or nxt in "–—·=/%" and not (nxt in "–—" and outer is None and gap):
        return False
    if nxt in _STRONG or nxt in _ATERM or nxt in _ELLIPSIS or nxt in _CLOSERS and nxt not in _OPENERS:
        return False
    word = _WORD_AFTER.match(x, k)
    following = word.group() if word else ""
    cased = nxt.isupper() or nxt.islower()
    loud = len(following) > 1 and following.isupper() and _loud_before(x, at)
    if outer is not None:
        lead = _LEAD.match(x, begin)
        alone = outer[0] == begin or bool(lead and not x[lead.end() : outer[0]].strip())
        if x[outer[0]] in "([（【":
            return alone and (small or not nxt.islower())
        if following.casefold() in REPORTING or nxt == "と" and x[outer[0]] in "「『":
            return False
        if nxt.islower():
            return small and alone
        if nxt.isupper() and not loud:
            return True
        if alone:
            return True
        before = x[begin : outer[0]].rstrip()
        if before[-1:] in (":", "："):
            return True
        return not cased and not nxt.isalpha() and not nxt.isdigit()
    if any(c in _STRONG for c in marks):
        return gap or not nxt.isascii() or nxt.isalpha() and not _address(x, at)
    if len(marks) > 1 or marks in _ELLIPSIS:
        if not gap and nxt.isalpha() and nxt.islower():
            return False
        if "...." in marks or "…." in marks or ".…" in marks:
            return True
        if at and x[at - 1].isspace():
            return False
        if nxt.islower():
            return small
        return not loud
    return _full_stop(x, begin, at, k, nxt, gap, loud, small, known)


def _full_stop(x: str, begin: int, at: int, k: int, nxt: str, gap: bool, loud: bool, small: bool, known: frozenset[str]) -> bool:
    """Whether the single full stop at ``at`` ends a unit; ``nxt`` is the next visible character, ``known`` are the abbreviations of the text's languages."""

    def suppressed(key: str) -> bool:
        if key not in _POOLED or key in BEFORE_NUMBERS:
            return key in BEFORE_NUMBERS and bool(_A_NUMBER.match(x, k))
        if key in known or len(key) > 1 and key not in ELSEWHERE_WORDS:
            return True
        return key in _abbreviations(languages(x[begin : k + 60]))  # the sentence may be in another language than the text

    if x[at] != ".":
        return gap or not nxt.isalnum()
    before = _WORD_BEFORE.search(x, max(begin, at - 40), at)
    w = before.group() if before else ""
    if not gap:
        if nxt.isascii() and not nxt.isalpha():
            return nxt in _OPENERS and len(w) > 2
        if not nxt.isalpha():
            return nxt in _OPENERS
        if w and w[-1].isascii() != nxt.isascii() and not (nxt.isupper() or nxt.islower()):
            return True
        if suppressed(w.casefold()) or "." in w or len(w) < 3 or "_" in w:
            return False
        tail = x[k + 1 : k + 3]
        return nxt.isupper() and (w[-1].islower() or w[-1].isdigit()) and not tail[:1].isupper() and tail[:1] != "."
    if _NUMBER.fullmatch(x, begin, at + 1):
        return False
    key = w.casefold().lstrip(".-")
    if key in _MAY_END or w.split(".")[-1].casefold() in ("ä",):
        if key not in _POOLED:
            return not nxt.islower() and not loud and not nxt.isdigit()
        head = x[max(begin, at - 8) : at]
        if re.search(r"(?:[тu]\. ?[дпÄä]|и (?:др|пр))$", head):
            return not nxt.islower() and not loud
        if key == "co":
            return not nxt.islower() and not loud
    if key in ("г", "гг") and re.search(r"\d\s*гг?$", x[max(begin, at - 8) : at]):
        return not nxt.islower()
    if suppressed(key):
        return False
    if len(w) == 1 and w.isalpha() and (w.isupper() or small):
        company = _COMPANY.search(x, max(begin, at - 60), at)
        return bool(company) and (small or not nxt.islower()) and not loud
    if "." in w and _ACRONYM.fullmatch(w):
        return not nxt.islower() and not nxt.isdigit() and not loud and not small
    if nxt.islower():
        return small
    return True


def _loud_before(x: str, at: int) -> bool:
    """Whether the word before a mark is in capitals."""
    m = re.search(r"[^\W\d_]{2,}(?=[\W\d_]*$)", x[max(0, at - 30) : at])
    return bool(m) and m.group().isupper()


def _address(x: str, at: int) -> bool:
    """Whether a mark without a blank after it stands in an address."""
    start = max(x.rfind(" ", 0, at), x.rfind("\n", 0, at)) + 1
    return "://" in x[start:at] or x[start : at].lower().startswith("www.")


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of each unit, in code points; the end is after its last visible character. Null and blank texts have none.
    ``lang`` is a hint that may be wrong."""
    if not text:
        return []
    small = small_style(text)
    chars = set(text)
    patterns = _patterns("".join(sorted(chars & _TERMINATORS)), "".join(sorted(chars & _PAIRED)))
    thai = bool(_THAI.search(text))
    known = _abbreviations(languages(text, lang)) if "." in chars else _abbreviations(frozenset())
    out: list[tuple[int, int]] = []
    for a, b in _paragraphs(text):
        x = text[a:b]
        first = _VISIBLE.search(x)
        if not first:
            continue
        starts = [first.start(), *_ends(x, small, known, patterns, thai)]
        for s, e in zip(starts, [*starts[1:], len(x)]):
            out.append((a + s, a + s + len(x[s:e].rstrip())))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, unit, starts, ends = [], [], [], []
        for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for k, (a, b) in enumerate(sentence_spans(text, lang)):
                ids.append(doc)
                unit.append(k)
                starts.append(a)
                ends.append(b)
        arrays = [pa.array(ids, pa.int64()), pa.array(unit, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "unit", "start_pos", "end_pos"])


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, unit, start_pos, end_pos``: the sentence units of every ``text`` of ``docs`` in order.

    Positions are in code points from 0, the end exclusive. Null, empty and blank texts and texts of header lines only give no unit; a null ``doc_id`` and repeated rows
    are kept. ``lang``, if the table has it, is a hint. Other columns aren't read. No shuffle but to spread a scan of few partitions.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return spread(docs.select("doc_id", "text", lang.alias("lang"))).mapInArrow(_units, "doc_id bigint, unit int, start_pos bigint, end_pos bigint")
