"""Sentence units of articles in many languages and scripts.

Running text is taken block by block. The terminators of a block form a lattice
of possible boundaries; each is kept or dropped by what stands around it. In
scripts with spaces that is the token before it (abbreviation, initial, ordinal,
plain word), the quotation or bracket it is in, and the token after it. In
scripts without spaces the text around every gap, be it after a terminator or a
mere blank, is segmented by a lattice of dictionary words, and the gap is
classified through the final words before and the opening words after it. Text
with neither a terminator nor a blank has no gap and is not split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.spaceless import CONNECTIVES, CONTINUING, DICTIONARY, ENDING, JOINING, OPENERS, PARTICLES, QUOTING

# Abbreviations that a sentence does not end with, in lower case.
NEVER_LAST = frozenset(
    """dr prof mr mrs ms mx st rev hon gen col capt lt sgt messrs mme mlle mlles drs hr fr frau dipl ing sr sra srta dña lic
    fig figs eq eqs eqn eqns sec secs sect tab tabs app apps ref refs def defs thm lem prop cor ch chap chaps vol vols no nos nr art para pt ex
    abb abschn abs bd bzw ca evtl ggf inkl insb kap m.e o.ä s.o s.u sog tel u.a usf vgl z.b z.t d.h i.d.r i.allg nr
    cf vs viz approx e.g i.e resp incl esp ibid op cit ed eds trans pp p ver v
    éq \\'eq env c.-à-d c.-\\`a-d p.ex pag pág p\\'ag p\\'ags págs núm n\\'um cap ej aprox art ee.uu
    рис табл гл см ср с им проф акад стр пп ул св тыс млн млрд обр
    د أ م ص ق डॉ सं श्री पृ क्र""".split()
)
# Abbreviations that may be the last token of a sentence.
MAY_BE_LAST = frozenset("etc u.s u.k u.n e.u u.s.a a.m p.m al ff f jr sr inc ltd co corp bros usw u.s.w etcétera д др г гг в вв н.э т.д т.п т.е к ph.d b.c a.d d.c".split())
# Those of them that mostly go before a name, and the words that begin a sentence after them.
STATES = frozenset("u.s u.k u.n e.u u.s.a".split())
SENTENCE_WORDS = frozenset(
    """the a an this that these those it its he she they we you i his her their our my there here in on at by for from with without to of as if when while where after before since because although however but and or so then
    thus hence therefore moreover furthermore further also still yet all both each every many most some several such no not none another other others once only even today now later earlier first second third finally what who why how
    which whether during under over between among through despite unlike like according given using based both either neither until instead nevertheless nonetheless meanwhile similarly conversely overall""".split()
)
# Names of months after an ordinal number.
MONTHS = frozenset("Januar Jänner Februar März Maerz April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sep Sept Okt Nov Dez M\\\"arz Jahrhundert Jh".split())
_LONGEST = max(map(len, DICTIONARY))
#: Characters on each side of a gap that the lattice sees.
_REACH = 16

_BLOCK = re.compile(r"(?:[^\n]*[^\n \t\r][^\n]*\n?)+")
_OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "``": "''", "„": "“", "‹": "›", "《": "》", "\\glqq": "\\grqq", "\\og": "\\fg"}
#: Quotation signs, brackets and terminators; a point inside a number, a name or an address is none.
_TOKEN = re.compile(r"``|''|\\(?:glqq|grqq|og|fg)(?![a-zA-Z])(?:\{\})?|[“”„«»「」『』《》（）()\[\]‹›]|[.]+(?:[!?]+|(?=[\s)\]'”»“›（）」』]|$|\\grqq|\\fg))|[!?…።፧։。！？．｡។៕။؟।॥۔]+[.!?…]*")
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Khmer}\p{Lao}\p{Myanmar}ー]")
_WIDE = frozenset("。！？．｡។៕။")
_ENDS = _WIDE | frozenset(".!?…؟।॥۔።፧։")
#: A blank between two characters of scripts without spaces.
_BLANK_GAP = regex.compile(rf"(?<={_SPACELESS.pattern})\s+(?={_SPACELESS.pattern})")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
#: The sign that closes a span right after a terminator, with the blank French puts before it.
_CLOSERS = re.compile(r"\s?(?:''|[”“»」』》）)\]›]|\\grqq(?:\{\})?|\\fg(?:\{\})?)")
_SPACE = re.compile(r"\s*")
_OPENING = re.compile(r"(?:``|\\glqq(?:\{\})?|\\og(?:\{\})?|\\[a-zA-Z]+\*?\s*\{|\\[`'^\"~=.]\{?|«\s?|[“„「『（(\[\"'‘¿¡{‹])*")
_BEFORE = re.compile(r"[^\s~(\[{«“„\"`—–]*$")
_NEXT = re.compile(r"[^\s~]*")


def lattice_words(text: str) -> list[str]:
    """The cheapest path of dictionary words through a short text; other characters cost most alone."""
    n = len(text)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        for k in range(1, min(_LONGEST, n - i) + 1):
            w = text[i : i + k]
            c = 1.0 / k if w in DICTIONARY else (2.0 if k == 1 else 1e9)
            if cost[i] + c < cost[i + k]:
                cost[i + k], back[i + k] = cost[i] + c, i
    out = []
    while n:
        out.append(text[back[n] : n])
        n = back[n]
    return out[::-1]


@lru_cache(65536)
def _goes_on(right: str, quoted: bool) -> bool:
    """Whether a sentence in a script without spaces goes on after a terminator, or the quotation it closes, before the text."""
    after = lattice_words(right)
    if not quoted:
        return after[0] in QUOTING
    return after[0] in CONTINUING or after[0] in PARTICLES and after[0] not in OPENERS


@lru_cache(65536)
def _blank_ends(left: str, right: str) -> bool:
    """Whether a blank without a terminator ends a sentence in a script without spaces."""
    after, before = lattice_words(right)[0], lattice_words(left)[-1]
    if _CJK.match(right):
        return before in ENDING and after in CONNECTIVES
    return after in CONNECTIVES or before in ENDING and after not in JOINING


def _spans(block: str, tokens: list) -> list[tuple[int, int]]:
    """Matched quotations and brackets as (start of the opening, end of the closing sign)."""
    stack: list[tuple[str, int]] = []
    out = []
    for m in tokens:
        g = m.group().removesuffix("{}")
        if stack and g == stack[-1][0]:
            out.append((stack.pop()[1], m.end()))
        elif g in _OPEN:
            stack.append((_OPEN[g], m.start()))
        else:
            for k in range(len(stack) - 1, -1, -1):  # an opening sign that is never closed counts for nothing
                if stack[k][0] == g:
                    out.append((stack[k][1], m.end()))
                    del stack[k:]
                    break
    return out


def _starts_sentence(block: str, at: int) -> str:
    """How the token at a place begins: upper, lower, digit, sign, caseless or empty."""
    at = _OPENING.match(block, at).end()
    if at >= len(block):
        return "empty"
    c = block[at]
    if c.isdigit():
        return "digit"
    if c in "$\\":
        return "sign"
    if not c.isalpha():
        return "sign"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        token = _NEXT.match(block, at).group()
        # pH, iTrace: a capital inside marks a name; its small first letter stays small.
        return "upper" if any(x.isupper() for x in token[1:3]) else "lower"
    return "caseless"


def _ends(block: str, m, end: int, nxt: int, quoted: bool, led_in: bool, bracket: bool) -> bool:
    """Whether the terminator m, whose closing signs end at ``end``, ends a sentence before ``nxt``."""
    sign = m.group()
    begins = _starts_sentence(block, nxt)
    if begins == "empty":
        return False
    if sign[0] in _WIDE:
        if sign == "．" and block[nxt].isdigit() and block[m.start() - 1 : m.start()].isdigit():
            return False
        return not _goes_on(block[nxt : nxt + _REACH], quoted and not (bracket and not led_in))
    if set(sign) <= {"…"} or sign.startswith("..") or sign.endswith("…"):
        return begins in ("upper", "digit") and end < nxt
    if end == nxt:  # no blank after it: a number, an address or an abbreviation
        return sign[-1] in "!?؟।॥۔" and _SPACELESS.match(block, nxt) is not None
    if quoted and led_in and begins in ("caseless", "lower", "sign"):
        return False
    if sign[0] in "।॥؟۔።፧։":
        return not (quoted and begins == "lower")
    if sign != ".":
        return begins != "lower"
    token = _BEFORE.search(block[max(0, m.start() - 24) : m.start()]).group()
    plain = token.lower()
    if end > m.end() and not quoted:
        plain = ""
    if begins == "lower":
        return False
    if plain in NEVER_LAST:
        return end > m.end()
    short = plain.replace("\\,", "").rsplit(".", 1)[-1]
    if plain in STATES and begins == "upper" and not led_in:
        return _NEXT.match(block, nxt).group().lower().rstrip(".,;:") in SENTENCE_WORDS
    if plain in MAY_BE_LAST or plain.replace("\\,", "") in MAY_BE_LAST:
        return True
    if short in NEVER_LAST and "." in plain:
        return False
    if len(token) == 1 and token.isalpha() and not token.islower():  # an initial
        return False
    if "\\," in token and len(short) == 1:
        return False
    if token.isdigit() and begins == "upper" and _NEXT.match(block, nxt).group().rstrip(".,;:") in MONTHS:
        return False
    return True


def block_starts(block: str) -> list[int]:
    """Where the sentences of a block begin; the first is 0."""
    tokens = list(_TOKEN.finditer(block))
    marks = [m for m in tokens if m.group()[0] in _ENDS]
    blanks = list(_BLANK_GAP.finditer(block)) if _SPACELESS.search(block) else []
    if not marks and not blanks:
        return [0]
    spans = _spans(block, [m for m in tokens if m.group()[0] not in _ENDS])
    closing = {b: a for a, b in spans}
    if blanks:
        marks = sorted(marks + blanks, key=lambda m: m.start())
    spans.sort()
    starts = [0]
    k, open_until, within = 0, -1, []
    for m in marks:
        at, end = m.start(), m.end()
        while k < len(spans) and spans[k][0] < at:
            within.append(spans[k])
            k += 1
        within = [s for s in within if s[1] > at]
        if m.group().isspace():
            if not within and _blank_ends(block[max(0, at - _REACH) : at], block[end : end + _REACH]):
                starts.append(end)
            continue
        # The signs that close right after the terminator.
        quoted, led_in, bracket = False, False, False
        inner = {s[1]: s[0] for s in within}
        while True:
            stop = end
            if stop not in inner:
                for b in inner:
                    if b > end and b - end <= 8 and _CLOSERS.fullmatch(block, end, b):
                        stop = b
                        break
            if stop == end:
                break
            quoted = True
            bracket = block[inner[stop]] in "（(["
            # Led in: there is text of the same sentence before the quotation.
            led_in = led_in or inner[stop] > starts[-1] and bool(block[starts[-1] : inner[stop]].strip())
            del inner[stop]
            end = stop
        if inner:
            continue
        nxt = _SPACE.match(block, end).end()
        if nxt >= len(block):
            break
        if _ends(block, m, end, nxt, quoted, led_in, bracket):
            starts.append(nxt)
    return starts


def sentence_starts(text: str) -> list[int]:
    """0-based character offsets of the sentences of an article's running text.

    Running text is every block of lines between empty lines whose first
    character is neither a backslash nor a percent sign. The empty text has none.
    """
    out = []
    for m in _BLOCK.finditer(text):
        block = m.group()
        if block[0] in "\\%":
            continue
        out += [m.start() + s for s in block_starts(block.rstrip())]
    return out


def split_sentences(df: DataFrame, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """id, start_pos, end_pos (exclusive) and, unless left out, sentence of every sentence unit.

    Null and empty texts, and texts of markup only, give no rows; rows are not
    reduced to one an id. Other columns are ignored. Each text is handled as a
    whole, in memory of a few times its size; there is no exchange.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                of, starts, ends, texts = [], [], [], []
                for k, t in enumerate(part["text"].to_pylist()):
                    for m in _BLOCK.finditer(t):
                        block = m.group()
                        if block[0] in "\\%":
                            continue
                        block = block.rstrip()
                        at = block_starts(block)
                        for s, e in zip(at, [*at[1:], len(block)]):
                            sentence = block[s:e].rstrip()
                            of.append(k)
                            starts.append(m.start() + s)
                            ends.append(m.start() + s + len(sentence))
                            if with_text:
                                texts.append(sentence)
                columns = [part["id"].take(pa.array(np.array(of, np.int64))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                names = ["id", "start_pos", "end_pos"]
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("sentence")
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start_pos int, end_pos int" + ", sentence string" * with_text)
