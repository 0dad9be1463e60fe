"""Text that looks the same but differs in its characters.

Every word (run of letters) gets the intersection of its characters' script
sets; an empty intersection is a mixed-script word. It is spelled anew in the
script for which every character is of that script or has a look-alike in it.
A word wholly in one alphabet that could be spelled in another is a
whole-script confusable; it is respelled only where the text around it is in
the other alphabet. Compatibility forms, marks, invisible characters and blanks
are brought to their plain form.

A cheap expression in the JVM passes only rows that hold such a character at
all to the Python workers; all others are in their consistent form already.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.fields import long_fields

# Letters of other alphabets and the Latin letters they look like, in the order of the alphabets.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜавгеіјкмнопрстухһԁԛԝӏүѵѕ", "ABESIJKMHOPCTYXYQWabreijkmhonpctyxhdqwlyvs"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαβγεηικνορτυχωϲϵ", "ABEZHIKMNOPTYXCjaßyenikvoptuxwce"))
ARMENIAN = dict(zip("ՍՏՕԼհոսօզյցք", "USOLhnuoqjgf"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHYGZbWVSLCPK"))
COPTIC = dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
# Latin letters of phonetic writing and the plain ones they look like.
PHONETIC = dict(zip("ɑɡɩɪʀɴʙʜʟ", "agiIRNBHL"))

#: Forms of letters, digits and ASCII signs: full-width, ligatures, mathematical alphabets.
_FORMS = (
    r"！-～ﬀ-ﬆﬓ-ﬗĲĳℂℇℊ-ℓℕℙ-ℝℤℨℬℭℯ-ℱ"
    r"ℳ-ℴℼ-ℿⅅ-ⅉ"
)
#: Java's pattern of every character that may make a text a case.
GATE = r"[" + _FORMS + r"\x{1D400}-\x{1D7FF}\p{M}\p{Cf}\p{IsGreek}\p{IsCyrillic}\p{IsArmenian}\p{IsCherokee}\p{IsCoptic}\p{IsLisu}ɑɡɩɪʀɴʙʜʟⅠ-ⅿ]|[\p{Zs}&&[^ ]]"

_FORM = regex.compile("[" + _FORMS + r"\U0001D400-\U0001D7FF]")
_MARK, _FORMAT, _BLANK, _WORD = regex.compile(r"\p{M}"), regex.compile(r"\p{Cf}"), regex.compile(r"(?! )\p{Zs}"), regex.compile(r"\p{L}+")
#: A Roman numeral of one letter inside a word.
_NUMERAL = regex.compile(r"(?<=\p{Latin})[ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ]|[ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ](?=\p{Latin})")
#: A word of ASCII letters but for some of phonetic writing.
_PHONETIC_WORD = regex.compile(rf"[A-Za-z{''.join(PHONETIC)}]+")
_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Lisu")}
#: The alphabets whose mixture makes a text a case; a mixture with others is told apart.
FOUR = frozenset(("Latin", "Greek", "Cyrillic", "Armenian"))
_ALL = frozenset(_SCRIPTS)
_TO_LATIN = {**CYRILLIC, **GREEK, **ARMENIAN, **CHEROKEE, **COPTIC, **LISU}
#: (script, Latin letter) to the letter of that script that looks like it.
_FROM_LATIN: dict[tuple[str, str], str] = {}
for _s, _t in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN), ("Cherokee", CHEROKEE), ("Coptic", COPTIC), ("Lisu", LISU)):
    for _c, _l in _t.items():
        _FROM_LATIN.setdefault((_s, _l), _c)
#: Scripts whose words need joiners as they stand.
_JOINED = regex.compile(r"[\p{Script=Arabic}\p{Script=Devanagari}\p{Script=Bengali}\p{Script=Tamil}\p{Script=Telugu}\p{Script=Kannada}\p{Script=Malayalam}\p{Script=Sinhala}\p{Script=Khmer}\p{Script=Myanmar}\p{Emoji}--[0-9#*]]", regex.V1)


@lru_cache(65536)
def scripts(c: str) -> frozenset[str]:
    """The scripts a letter can belong to; all for letters outside the four alphabets."""
    own = frozenset(s for s, p in _SCRIPTS.items() if p.match(c))
    return own or _ALL


@lru_cache(65536)
def spelled(c: str, script: str) -> str | None:
    """The letter that looks like c in a script, or None."""
    if script in scripts(c):
        return c
    latin = _TO_LATIN.get(c, c)
    if script == "Latin":
        return latin if "Latin" in scripts(latin) and latin != c else None
    return _FROM_LATIN.get((script, latin))


def resolved(word: str) -> frozenset[str]:
    """The intersection of the script sets of a word's letters."""
    out = _ALL
    for c in word:
        out &= scripts(c)
        if not out:
            break
    return out


@lru_cache(65536)
def consistent(word: str, around: str | None = None) -> str:
    """The word in one script: the one that spells all of it and holds most of its letters as they are.

    A word in one script is kept unless ``around`` names another one that spells
    all of it. A mixed word that no script can spell is kept.
    """
    sets = resolved(word)
    if not sets and word[0] == "μ" and word[1:].isascii():  # a unit: the micro sign is the form beside Latin letters
        return "µ" + word[1:]
    options = []
    for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu"):
        letters = [spelled(c, s) for c in word]
        if all(letters):
            options.append((s == around, sum(s in scripts(c) and scripts(c) != _ALL for c in word), s == "Latin", "".join(letters)))
    if sets and (around is None or around in sets):
        return word
    if sets:
        return next((o[3] for o in options if o[0]), word)
    return max((o[1:] for o in options), default=(0, 0, word))[2]


def kinds(text: str) -> list[str]:
    """What makes the text a case: form, mark, invisible, blank, mixed; a mixture with an alphabet beyond the four is ``other``."""
    out = [k for k, p in (("form", _FORM), ("mark", _MARK), ("invisible", _FORMAT), ("blank", _BLANK)) if p.search(text)]
    if not text.isascii() and (mixtures := [w for w in _WORD.findall(text) if not resolved(w)]):
        if any(len({s for c in w if len(own := scripts(c)) == 1 for s in own & FOUR}) > 1 for w in mixtures):
            out.append("mixed")
        if any({s for c in w if len(own := scripts(c)) == 1 for s in own} - FOUR for w in mixtures):
            out.append("other")
    return out


def plain_forms(text: str) -> str:
    """The text without compatibility forms, invisible characters, odd blanks and separate accents."""
    text = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _NUMERAL.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _FORMAT.search(text):
        text = _FORMAT.sub(lambda m: m.group() if m.group() in "‌‍" and m.start() and _JOINED.match(text[m.start() - 1]) else "", text)
    return unicodedata.normalize("NFC", _BLANK.sub(" ", text))


def normalize(text: str) -> str:
    """The consistent form of a text. Idempotent; micro and degree signs, superscripts, fractions, quotes and dashes stay."""
    if text.isascii():
        return text
    text = plain_forms(text)
    words = _WORD.findall(text)
    single = [next(iter(r)) for r in map(resolved, words) if len(r) == 1]
    most = max(set(single), key=lambda s: (single.count(s), s)) if single else None
    # Whole-script confusables are respelled only in a text clearly in another script.
    around = most if most and single.count(most) >= 4 * (len(single) - single.count(most)) else None

    def one(m) -> str:
        w = m.group()
        if w.isascii():
            return w
        if sum(c in PHONETIC for c in w) == 1 and len(w) > 3 and _PHONETIC_WORD.fullmatch(w):
            return "".join(PHONETIC.get(c, c) for c in w)
        if len(w) > 1 and around and resolved(w) and around not in resolved(w):
            return consistent(w, around)
        return consistent(w)

    return _WORD.sub(one, text)


def gated(c: Column) -> Column:
    """Whether a text holds any character that may make it a case."""
    return c.rlike(r"[^\x00-\x7F]") & c.rlike(GATE)


def find_lookalikes(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field, kinds and the consistent text of each field that is a case.

    ``kinds`` holds form (full-width, ligature or mathematical), mark (combining),
    invisible (format character), blank (other than U+0020), mixed (a word with
    letters of several of Latin, Greek, Cyrillic and Armenian) and other (a word
    that mixes another alphabet in). Null and empty texts and rows without an id are
    no cases. Repeated rows give one row; deliveries with different texts give one
    each. The input's other columns are ignored.
    """
    rows = long_fields(df, id_col, fields).where(gated(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            found = [kinds(t) for t in texts]
            at = [k for k, x in enumerate(found) if x]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(take), b["field"].take(take), pa.array([found[k] for k in at], pa.list_(pa.string())), pa.array([normalize(texts[k]) for k in at], pa.string())],
                ["id", "field", "kinds", "text"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, field string, kinds array<string>, text string").distinct()


def normalize_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """id, field and consistent text of every non-null field of every row; texts without an odd character stay in the JVM."""
    rows = long_fields(df, id_col, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], b["field"], pa.array([normalize(t) for t in b["text"].to_pylist()], pa.string())], ["id", "field", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    odd = rows.where(gated(F.col("text"))).mapInArrow(run, f"id {kind}, field string, text string")
    return rows.where(~gated(F.col("text"))).unionByName(odd)
