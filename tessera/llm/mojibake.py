"""Garbled text from wrong character encoding: find it, and restore the original where possible.

1. Adjacent character pairs of the corpus' distinct texts are counted (combined per batch, then summed), so copies of a text don't vouch for each other. A pair's score is its share in the corpus' mutual information,
   p(xy) log2(p(xy) / p(x)p(y)): pairs below ``LOW_SHARE`` score positive, others negative, on a clipped log scale.
2. In each text the maximum-scoring segments of pair scores (Ruzzo-Tompa) are the improbable runs; a run is widened to the tokens it touches.
3. Inside the runs the inverse mappings are tested: text read in a wrong charset is encoded back and read in the right one. A mapping holds if the pairs it yields
   are known and their log-likelihood under the corpus gains enough bits over those found. Tokens with UTF-8 sequences are tested for these wherever they stand, so a corpus
   in which garbling is usual hides none. Texts with replacement characters or control codes anywhere, or question marks for letters in a run, are garbled too, though beyond restoring.

What goes to the workers is bounded whatever the corpus: pairs with p(xy) >= ``FLOOR``, at most 1 / ``FLOOR`` of them. Counts, margins and total are over all pairs, and
``FLOOR`` is so low that every rarer pair has the highest score, the same as an unseen one (its share is at most p log2(1 / p) < ``LOW_SHARE`` / 16), so no score depends on it.
For likelihoods a pair of probability below ``RARE`` is as good as unseen: garbling repeats itself, so a few occurrences say little, in a corpus of any size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread, written

#: Probability below which a pair has the highest score whatever its count; bounds the table to 1 / FLOOR pairs.
FLOOR = 2.5e-7
#: Probability below which a pair vouches for no text.
RARE = 2e-6
#: Share in the mutual information (bits) below which a pair is improbable.
LOW_SHARE = 1e-4
#: Bits a mapping must gain over a text's runs (little where the form of UTF-8 speaks for it too), and log2 p(y|x) that pairs it makes must have on average.
GAIN_UTF8, GAIN, KNOWN = 0.5, 9.0, -11.0
#: Bits a mapping must gain where no character is out of place, so that only rarity speaks for it.
GAIN_UNSEEN = 60.0
#: log2 p(y|x) of an unseen pair.
UNSEEN = -20.0

#: Charsets in which UTF-8 may have been read.
UTF8_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp1254", "cp1257", "cp852", "iso8859-7", "mac_greek", "mac_cyrillic", "gb18030", "shift_jis", "big5")
#: Those of them where a character takes several bytes.
WIDE = ("gb18030", "shift_jis", "big5")
#: Pairs (read as, written in) of charsets of one byte a character.
READ_AS = (
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp1253"),
    ("cp1252", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("mac_roman", "cp1251"),
    ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_roman", "cp850"),
    ("cp850", "mac_roman"), ("mac_roman", "cp1253"), ("cp850", "cp1253"), ("cp437", "cp1253"), ("cp437", "cp1251"), ("cp850", "cp1251"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("cp1252", "cp1254"), ("cp437", "mac_roman"), ("cp1251", "cp1253"), ("cp1253", "cp1251"),
)
#: Pairs (read as, written in) where a character takes several bytes.
WIDE_READ_AS = tuple((a, b) for a in ("cp1252", "mac_roman", "cp850", "cp437", "cp1251") for b in ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr"))


def charset(name: str) -> str:
    """The 128 characters of the upper half of a one-byte charset; bytes without a character stand for themselves, as lenient readers have it."""
    return "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(128, 256))


@lru_cache(maxsize=None)
def _to_bytes(name: str) -> dict[int, int]:
    table = {ord(c): 128 + k for k, c in enumerate(charset(name))}
    for b in range(128, 160):  # control codes pass as bytes
        table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def _utf8_runs(name: str, small: bool) -> re.Pattern:
    """UTF-8 sequences of two bytes and more as they look when read in a charset, also after being put in small letters."""
    upper = charset(name)

    def chars(a: int, b: int) -> str:
        found = {upper[x - 128] for x in range(a, b + 1)} | ({chr(x) for x in range(a, b + 1) if x < 160} if name != "latin-1" else set())
        if small:
            found |= {c.lower() for c in found if len(c.lower()) == 1}
        return "[" + re.escape("".join(sorted(found))) + "]"

    tail = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(maxsize=None)
def _single(read: str, written: str) -> dict[int, str]:
    right = charset(written)
    return {c: right[b - 128] for c, b in _to_bytes(read).items()}


#: Unicode blanks that a garbled text holds in place of a byte, so no token ends there.
_TOKEN = re.compile(r"[^ \t\n\r\f\v]+")
_LOST = re.compile(r"�|[\x80-\x84\x86-\x9f]")
_BROKEN = re.compile(r"[\x80-\x9f\ufffd]")
_ASKED = re.compile(r"[^\W\d_]\?+[^\W\d_]")
#: Whole words lost: tokens of question marks side by side.
_ASKED_WORDS = re.compile(r"(?<![^\s(«“\"'])\?{2,}[,;]? \?{2,}(?![^\s.,;:!)»”\"'])")


def _asked(text: str, runs: list[tuple[int, int]]) -> bool:
    """Whether question marks stand for letters: before a small letter in a run, or for two words and more anywhere."""
    inside = any(m.group()[-1].islower() or not m.group()[-1].isupper() and m.group()[0] > "\x7f" for a, b in runs for m in _ASKED.finditer(text, a, b))
    return inside or bool(_ASKED_WORDS.search(text))


@lru_cache(maxsize=None)
def _utf8_pairs() -> re.Pattern:
    """What a UTF-8 sequence read in one of the charsets may start with; which one, if any, the mappings tell."""
    return re.compile(rf"(?=[^\x00-\x7f])(?:{'|'.join(dict.fromkeys(_utf8_pair(r) for r in UTF8_READ_AS if r not in WIDE))})")


def _utf8_pair(name: str) -> str:
    """A lead of a UTF-8 sequence and the first of its tail, as they look when read in a charset, also in small letters."""
    upper = charset(name)
    sides = []
    for a, b in ((0xC2, 0xF4), (0x80, 0xBF)):
        found = {upper[x - 128] for x in range(a, b + 1)} | ({chr(x) for x in range(a, b + 1) if x < 160} if name != "latin-1" else set())
        sides.append(found | {c.lower() for c in found if len(c.lower()) == 1})
    return "".join("[" + re.escape("".join(sorted(x))) + "]" for x in sides)


class PairModel:
    """Scores of adjacent character pairs: ``pairs`` with their counts out of ``total``; ``left`` and ``right`` are the margins over all pairs, by default over the given ones."""

    def __init__(self, pairs: dict[str, int], total: int, left: dict[str, int] | None = None, right: dict[str, int] | None = None):
        if left is None or right is None:
            left, right = Counter(), Counter()
            for xy, n in pairs.items():
                left[xy[0]] += n
                right[xy[1]] += n
        self.score: dict[str, float] = {}
        self.likely: dict[str, float] = {}
        for xy, n in pairs.items():
            # an occurrence doesn't vouch for itself, so one is left out
            share = (n - 1) / total * math.log2(n * total / (left[xy[0]] * right[xy[1]]))
            self.score[xy] = max(-3.0, min(4.0, math.log2(LOW_SHARE / share))) if share > 0 else 4.0
            if n >= RARE * total:
                self.likely[xy] = max(UNSEEN, math.log2(n / left[xy[0]]))
        for xy in [k for k in self.likely if k.islower()]:  # pairs of capitals are as likely as those of small letters, but for the style
            for other in (xy.upper(), xy[0].upper() + xy[1]):
                if len(other) == 2:
                    self.likely[other] = max(self.likely.get(other, UNSEEN), self.likely[xy] - 4.0)
                    self.score[other] = min(self.score.get(other, 4.0), self.score[xy] + 1.0)

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Spans of tokens touched by the maximum-scoring segments of improbable pairs."""
        score = self.score
        scores = [0.0 if x in " \n" and y < "\x80" else score.get(x + y, 4.0) for x, y in zip(text, text[1:])]
        touched: list[tuple[int, int]] = []
        for a, b in maximal_segments(scores):
            start = a
            while start > 0 and text[start - 1] not in " \t\n\r":
                start -= 1
            end = b + 1
            while end < len(text) and text[end] not in " \t\n\r":
                end += 1
            if touched and start <= touched[-1][1] + 1:
                touched[-1] = (touched[-1][0], max(end, touched[-1][1]))
            else:
                touched.append((start, end))
        return touched

    def bits(self, text: str) -> float:
        """log2 likelihood of a text's pairs."""
        likely = self.likely
        return sum(likely.get(x + y, UNSEEN) for x, y in zip(text, text[1:]))


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring subsequences (Ruzzo-Tompa), as spans of the scored positions, the end exclusive; linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (k, k + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b) for a, b, *_ in found]


def _as_bytes(text: str, read: str) -> bytes | None:
    table = _to_bytes(read)
    try:
        return bytes(c if c < 128 else table[c] for c in map(ord, text))
    except KeyError:
        return None


def undo_utf8(text: str, read: str) -> str:
    """UTF-8 sequences within a text that was read in ``read`` made characters again."""
    if read in WIDE:
        return _undo_wide(text, read)

    def back(m: re.Match) -> str:
        raw = _as_bytes(m.group(), read)
        if raw is None and (folded := _fold(m.group(), read)) is not None:
            raw = folded
        try:
            return raw.decode() if raw else m.group()
        except UnicodeDecodeError:
            folded = _fold(m.group(), read)
            try:
                return folded.decode() if folded else m.group()
            except UnicodeDecodeError:
                return m.group()

    once = _utf8_runs(read, False).sub(back, text)
    return once if once != text else _utf8_runs(read, True).sub(back, text)


def _fold(text: str, read: str) -> bytes | None:
    """The bytes of a run whose letters were put in small ones after it was garbled: lead bytes are capitals there in most charsets."""
    table, out, left = _to_bytes(read), bytearray(), 0
    for c in text:
        options = [table[ord(x)] for x in (c, c.upper()) if len(x) == 1 and ord(x) in table]
        fits = [b for b in options if (0x80 <= b <= 0xBF) == (left > 0)]
        fits = [b for b in fits if left or 0xC2 <= b <= 0xF4]
        if not fits:
            return None
        b = fits[-1] if not left else fits[0]
        left = left - 1 if left else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        out.append(b)
    return bytes(out)


_NOT_ASCII = re.compile(r"[^\x00-\x7f]+[\x00-\x7f]?")


def _undo_wide(text: str, read: str) -> str:
    def back(m: re.Match) -> str:
        for part in (m.group(), m.group()[:-1]):
            try:
                return part.encode(read).decode() + m.group()[len(part) :]
            except UnicodeError:
                continue
        return m.group()

    return _NOT_ASCII.sub(back, text)


def _undo_single(text: str, read: str, written: str) -> str:
    return text.translate(_single(read, written))


def _undo_to_wide(text: str, read: str, written: str) -> str:
    raw = _as_bytes(text, read)
    try:
        return raw.decode(written) if raw else text
    except UnicodeDecodeError:
        return text


def _twice(text: str, read: str) -> str:
    once = undo_utf8(text, read)
    return undo_utf8(once, read) if once != text else text


def _leads(read: str) -> frozenset[str]:
    """Characters that a UTF-8 sequence read in a charset can start with."""
    if read in WIDE:
        return frozenset(map(chr, range(0x2E80, 0xFFEF)))
    leads = charset(read)[0x42:0x75]
    return frozenset(leads + leads.lower())


#: name -> (characters it takes, function that undoes one wrong reading).
MAPPINGS = {f"utf-8 as {r}": (_leads(r), lambda t, r=r: undo_utf8(t, r)) for r in UTF8_READ_AS}
MAPPINGS |= {f"utf-8 as {r} twice": (_leads(r), lambda t, r=r: _twice(t, r)) for r in UTF8_READ_AS[:7]}
MAPPINGS |= {f"{w} as {r}": (frozenset(charset(r)), lambda t, r=r, w=w: _undo_single(t, r, w)) for r, w in READ_AS}
MAPPINGS |= {f"{w} as {r}": (frozenset(charset(r)) | frozenset(map(chr, range(128, 160))), lambda t, r=r, w=w: _undo_to_wide(t, r, w)) for r, w in WIDE_READ_AS}

#: Those that don't look for UTF-8 in a charset of one byte a character.
NOT_UTF8 = {k: v for k, v in MAPPINGS.items() if k[:5] != "utf-8" or k.split()[2] in WIDE}


def _odd(token: str) -> int:
    """Characters that don't belong where they stand: symbols or control codes between letters, a capital after a small letter, scripts mixed in a word."""
    n, worded = 0, any(map(str.isalpha, token))
    for x, y, z in zip(" " + token, token, token[1:] + " "):
        if y < "\x80":
            continue
        letter = y.isalpha() or "\u0300" <= y <= "\u036f"
        beside = x.isalpha() or z.isalpha()
        if "\x80" <= y < "\xa0":
            n += 1
        elif not letter:
            n += x.isalpha() and z.isalpha() or worded and y in _SYMBOLS
        elif y.isupper() and x.islower() or x > "\x7f" and x.islower() and z.isupper():
            n += 1
        elif beside and _script(y) and any(_script(c) and _script(c) != _script(y) for c in (x, z) if c.isalpha()):
            n += 1
    return n


#: Symbols that don't stand in a word of running text.
_SYMBOLS = frozenset("√≈∂ƒ∆Ωπ∫∑∏◊¬¦¨¯´¸¤¢£¥§¶†‡•°±²³¹½¼¾÷×µ©®™ˆ˜˘˙˚˝˛ˇ") | frozenset(map(chr, [*range(0x2300, 0x2400), *range(0x2500, 0x25A1)])) | {"\uf8ff"}


def _script(c: str) -> str:
    """A coarse script of a letter; empty for others."""
    o = ord(c)
    if not c.isalpha():
        return ""
    return "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "cyrillic" if 0x400 <= o < 0x530 else "wide" if o >= 0x2E80 else "other"


class Judge:
    """Tests of the inverse mappings on the tokens of improbable runs; results are kept, as tokens repeat."""

    def __init__(self, model: PairModel):
        self.model = model
        self.known: dict[str, dict[str, tuple[str, float, int]]] = {}

    def options(self, token: str) -> dict[str, tuple[str, float, int]]:
        """mapping -> (token after it, bits gained, odd characters mended), for the mappings that gain."""
        found = self.known.get(token)
        if found is None:
            found = {}
            chars = {c for c in token if c > "\x7f"}
            before = _odd(token)
            # without a lead and a tail side by side no mapping of UTF-8 changes anything
            mappings = MAPPINGS if _utf8_pairs().search(token) else NOT_UTF8
            for name, (alphabet, undo) in mappings.items():
                if (chars <= alphabet) if " twice" not in name and name[:5] != "utf-8" else (chars & alphabet):
                    after = undo(token)
                    if after != token:
                        gain = self.gain(token, after)
                        if gain > 0:
                            found[name] = (after, gain, before - _odd(after))
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = found
        return found

    def gain(self, before: str, after: str) -> float:
        """Bits gained by a change; 0 if what it makes is itself improbable. The blanks around the token count."""
        if not after or _BROKEN.search(after):
            return 0.0
        a, b = f" {before} ", f" {after} "
        i = 1
        while i < min(len(a), len(b)) - 1 and a[i] == b[i]:
            i += 1
        j = 1
        while a[-j] == b[-j] and len(b) - j > i and len(a) - j > i:
            j += 1
        a, b = a[i - 1 : len(a) - j + 2], b[i - 1 : len(b) - j + 2]
        new = self.model.bits(b)
        if new < KNOWN * (len(b) - 1):
            return 0.0
        return new - self.model.bits(a)

    def utf8_options(self, token: str) -> dict[str, tuple[str, float, int]]:
        """The options of a token outside the runs: UTF-8 sequences. Those that mend no odd character gain nothing by themselves; they go with others."""
        return {k: v if v[2] > 0 else (v[0], 0.0, v[2]) for k, v in self.options(token).items() if k[:5] == "utf-8"}

    def tokens(self, text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str, bool]]:
        """``start, end, token, in a run`` of the tokens to test, in order."""
        found = {m.start(): (m.start(), m.end(), m.group(), True) for a, b in runs for m in _TOKEN.finditer(text, a, b) if not m.group().isascii()}
        pairs = _utf8_pairs()
        for m in _TOKEN.finditer(text) if pairs.search(text) else ():
            if m.start() not in found and pairs.search(m.group()) and self.utf8_options(m.group()):
                found[m.start()] = (m.start(), m.end(), m.group(), False)
        return [found[k] for k in sorted(found)]

    def best(self, tokens: list[tuple[int, int, str, bool]]) -> tuple[str, list[tuple[int, int, str]]] | None:
        """The mapping that gains most over a stretch of the tokens, and what it makes of them; None if none gains enough."""
        options = [self.options(t) if inside else self.utf8_options(t) for *_, t, inside in tokens]
        best, most, pieces = "", 0.0, []
        for name in dict.fromkeys(k for o in options for k in o):
            total, mended, start, top = 0.0, 0, 0, (0.0, 0, 0, 0)
            for k, o in enumerate(options):
                hit = o.get(name)
                total, mended = (total + hit[1], mended + hit[2]) if hit else (total - 4.0 * tokens[k][3], mended)
                if total <= 0:
                    total, mended, start = 0.0, 0, k + 1
                elif total > top[0]:
                    top = (total, mended, start, k + 1)
            total, mended, a, b = top
            enough = (GAIN_UTF8 if name[:5] == "utf-8" else GAIN) if mended > 0 else GAIN_UNSEEN
            if total >= enough and total > most:
                best, most = name, total
                pieces = [(x, y, o[name][0]) for k, ((x, y, _, inside), o) in enumerate(zip(tokens, options)) if name in o and (a <= k < b or mended > 0 and not inside)]
        return (best, pieces) if best else None

    def inspect(self, text: str | None) -> tuple[str, str | None] | None:
        """``(kind, restored)`` of a garbled text, the restored text null if it can't be had; None for a text without garbling."""
        if not text or text.isascii() and "?" not in text:
            return None
        runs = self.model.runs(text)
        kinds: list[str] = []
        restored = text
        for _ in range(3):  # a text may be garbled twice, or in two ways
            tokens = self.tokens(restored, runs)
            found = self.best(tokens) if tokens else None
            if not found:
                break
            kinds.append(found[0])
            out, at = [], 0
            for a, b, after in found[1]:
                out += [restored[at:a], after]
                at = b
            restored = "".join([*out, restored[at:]])
            runs = self.model.runs(restored)
        if _LOST.search(restored):
            kinds.append("lost characters")
        elif _asked(restored, runs):
            kinds.append("question marks for letters")
        if not kinds:
            return None
        return "; ".join(kinds), None if kinds[-1][:4] in ("lost", "ques") else restored


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                text = f" {text} "
                counts.update(map(str.__add__, text, text[1:]))
        if len(counts) > 1_000_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])


def pair_model(texts: DataFrame) -> PairModel:
    """The model of the distinct texts in the first column."""
    counts = written(spread(texts.distinct()).mapInArrow(_count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    total = int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    named = F.col("n") >= F.lit(FLOOR * total)
    kept = counts.where(named).toPandas()  # at most 1 / FLOOR rows
    x, y = F.substring("pair", 1, 1).alias("c"), F.substring("pair", 2, 1).alias("c")
    left, right = (counts.groupBy(c).agg(F.sum("n").alias("n")).toPandas() for c in (x, y))  # a row a code point
    margins = [dict(zip(m.c, map(int, m.n))) for m in (left, right)]
    return PairModel(dict(zip(kept.pair, map(int, kept.n))), max(total, 1), *margins)


def garbled(rows: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """``tab, row_key, text_hash, kind, restored`` of the garbled rows of ``rows`` (``tab string, row_key bigint, text string``); ``text_hash`` is ``xxhash64(text)``.

    ``corpus`` is the one-column frame the pair statistics are taken from, by default all texts of ``rows``. Null, empty and ASCII texts without question marks aren't
    garbled. Repeated rows come out as often as they are there. Other columns are not read. Texts are judged whole, whatever their length.
    """
    texts = spread(rows.select("tab", "row_key", "text", F.xxhash64("text").alias("text_hash")))
    model = pair_model(spread(corpus) if corpus is not None else texts.select("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judgement = Judge(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for tab, key, text, mark in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = judgement.inspect(text)
                if found:
                    out.append((tab, key, mark, *found))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["tab", "row_key", "text_hash", "kind", "restored"])

    return texts.mapInArrow(judge, "tab string, row_key bigint, text_hash bigint, kind string, restored string")


def restored_tokens(tokens: Column, text: Column, restored: Column) -> Column:
    """The tokens that were cut from ``text`` at blanks, as they read in ``restored``; unchanged where the two differ in their number of tokens."""
    old, new = F.split(text, " "), F.split(restored, " ")
    pairs = F.arrays_zip(old.alias("old"), new.alias("new"))
    found = F.transform(tokens, lambda t: F.coalesce(F.get(F.filter(pairs, lambda p: (p["old"] == t) & (p["new"] != t)), F.lit(0))["new"], t))
    return F.when(F.size(old) == F.size(new), found).otherwise(tokens)
