"""Text that was decoded with the wrong character encoding.

Windows of words around non-ASCII characters, and whole sentences, are stripped
of their non-ASCII characters; garbled and clean texts with the same rest are
twins. Twins are aligned character by character at the ASCII characters they
share, and each aligned pair of runs tells which wrong reading turned one into
the other. What is learned - the readings with their support, the characters
that clean text holds, and the runs that lost their characters - is applied to
all remaining records. Only characters that clean text holds are restored, so
correct text that happens to be decodable stays.
"""

from __future__ import annotations

import encodings.aliases
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.fields import long_fields
from palimp.runtime import checkpoint

LOST = "�"
#: Encodings that UTF-8 is mostly read in, tried first; :func:`all_encodings` has the others.
READINGS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "koi8_r", "cp866", "iso8859_15")
#: Single-byte encodings that may have been confused with each other.
CONFUSED = [(a, b) for a in ("cp1252", "cp1251", "koi8_r", "cp866", "cp1250", "mac_roman", "cp850") for b in ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp850", "cp866") if a != b]


@lru_cache(1)
def all_encodings() -> tuple[str, ...]:
    """READINGS and every other single-byte encoding of the standard library that leaves ASCII as it is."""
    out = list(READINGS)
    plain = "".join(map(chr, range(0x20, 0x7F)))
    for codec in sorted(set(encodings.aliases.aliases.values())):
        try:
            if codec not in out and len("é1".encode(codec, "replace")) == 2 and plain.encode(codec).decode("ascii") == plain and codec not in ("ascii", "latin_1"):
                out.append(codec)
        except (LookupError, UnicodeError, ValueError):
            pass
    return tuple(out)


@lru_cache(None)
def table(codec: str) -> dict[str, int]:
    """Characters to bytes; bytes an encoding leaves open are read as control characters, for the western reading also those of Latin-1."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        out |= {chr(b): b for b in range(128, 256)}
    return {c: b for c, b in out.items() if not c.isascii()}


@lru_cache(None)
def sequence(codec: str) -> regex.Pattern:
    """The pattern of one character of UTF-8 read in an encoding."""
    cls = lambda lo, hi: "[" + "".join(regex.escape(c) for c, b in table(codec).items() if lo <= b <= hi) + "]"
    more = cls(0x80, 0xBF)
    return regex.compile(f"{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{{2}}|{cls(0xF0, 0xF4)}{more}{{3}}")


@lru_cache(None)
def runs(codec: str) -> regex.Pattern:
    return regex.compile(f"(?:{sequence(codec).pattern})+")


_PARTS = regex.compile(r"[^\x00-\x7F]+")


@lru_cache(16)
def lone_leads(readings: tuple[str, ...]) -> dict[str, str]:
    """First characters of two whose second, a no-break space, was made a blank, with the character they were.

    Such a pair is left alone between words of capitals, where it may be meant.
    """
    out = {}
    for codec in readings:
        t = {} if ">" in codec else table(codec)
        if t.get("\xa0") == 0xA0:
            out |= {c: bytes([b, 0xA0]).decode() for c, b in t.items() if 0xC3 <= b <= 0xDF}
    return out


def undo(text: str, codec: str) -> str | None:
    """The text whose UTF-8 was read as ``codec`` into this one, or None."""
    t = table(codec)
    try:
        return bytes(t[c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


@lru_cache(1 << 16)
def explain(garbled: str, clean: str) -> tuple[str, ...] | None:
    """The wrong readings, last first, that turned one run into the other; () for lost characters.

    Each reading undone makes a run shorter, so the search ends by itself however
    many there were. Encodings beyond the usual ones are tried for the last reading.
    """
    if set(garbled) == {LOST} and clean and LOST not in clean:
        return ()
    frontier = [((), garbled)]
    while frontier:
        nxt = []
        for chain, text in frontier:
            for codec in READINGS if chain else all_encodings():
                back = undo(text, codec)
                if back is None:
                    continue
                if back == clean:
                    return (*chain, codec)
                if len(back) > len(clean):
                    nxt.append(((*chain, codec), back))
        frontier = nxt
    return None


def confusion(different: list[tuple[str, str]]) -> str | None:
    """The confusion of two single-byte encodings that explains all differing runs, which must be more than one character."""
    if sum(len(y) for _, y in different) > 1:
        for a, b in CONFUSED:
            try:
                if all(y.encode(a).decode(b) == x for x, y in different):
                    return f"{a}>{b}"
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
    return None


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The differing runs between the ASCII characters that two twins share."""
    a, b = [_PARTS.findall(t) for t in (garbled, clean)]
    if len(a) != len(b) or _PARTS.split(garbled) != _PARTS.split(clean):
        return _loosely(garbled, clean)
    return [(x, y) for x, y in zip(a, b) if x != y]


def _loosely(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs slot by slot, where only one of the twins has a run between two characters."""
    slots = []
    for t in (garbled, clean):
        runs: dict[int, str] = {}
        n = 0
        for c in t:
            if c.isascii():
                n += 1
            else:
                runs[n] = runs.get(n, "") + c
        slots.append(runs)
    return [(x, slots[1].get(k, "")) for k, x in slots[0].items() if x != slots[1].get(k, "")]


def suspect(text: str) -> bool:
    """Whether a text has a lost character or a run that some reading decodes."""
    return LOST in text or any(sequence(c).search(text) for c in READINGS)


_WINDOW = r"(?<![^ \n])(?:[^ \n]+ )?[^ \n]*[^\x00-\x7F][^ \n]*(?: [^ \n]+)?"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def windows(texts: DataFrame) -> DataFrame:
    """skeleton, text and count of word windows (digits masked) and of sentences around non-ASCII characters.

    The skeleton is null where too little of it is left to tell twins by.
    """
    odd = F.col("text").rlike(r"[^\x00-\x7F]")
    near = F.transform(F.regexp_extract_all("text", F.lit(_WINDOW), F.lit(0)), lambda w: F.regexp_replace(w, r"[0-9]+", "0"))
    # Sentences have few letters left in scripts other than Latin; their numbers and codes tell them apart.
    whole = F.filter(F.split("text", r"\n|(?<=[.;!?])\s+"), lambda s: s.rlike(r"[^\x00-\x7F]{3}"))
    whole = F.when(F.col("text").rlike(r"[^\x00-\x7F]{3}"), F.transform(whole, lambda s: F.concat(F.lit("\1"), s))).otherwise(F.array().cast("array<string>"))
    each = texts.where(odd).select(F.explode(F.concat(near, whole)).alias("text")).groupBy("text").count()
    kept = each.select(_stripped(F.col("text")).alias("skeleton"), "text", "count")
    is_whole = F.col("text").startswith("\1")
    enough = F.when(is_whole, F.regexp_count("skeleton", F.lit("[A-Za-z0-9]")) >= 7).otherwise(F.regexp_count("skeleton", F.lit("[A-Za-z]")) >= 4)
    return kept.select(F.when(enough, F.col("skeleton")).alias("skeleton"), F.ltrim("text", F.lit("\1")).alias("text"), "count")


def _flag_suspects(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([not t.isascii() and suspect(t) for t in b["text"].to_pylist()])], [*b.schema.names, "suspect"])

    return rows.mapInArrow(run, "skeleton string, text string, count long, suspect boolean")


def learn(texts: DataFrame, least: int = 2) -> tuple[list[str], set[str], DataFrame]:
    """Readings with support, characters of clean text, and windows with lost characters beside their twins.

    What comes to the driver is bounded by the encodings and the characters in
    use, not by the records: readings are a few chains, characters at most those
    of Unicode that occur at least ``least`` times. The windows (w, clean) stay
    a table.
    """
    rows = checkpoint(_flag_suspects(windows(texts)))
    twins = rows.where(F.col("skeleton").isNotNull()).groupBy("skeleton").agg(F.max_by("text", F.struct(~F.col("suspect"), "count")).alias("clean"), F.count("*").alias("_texts"), (~F.min("suspect")).alias("sure"))
    pairs = rows.join(twins.where("_texts > 1"), "skeleton").where(F.col("text") != F.col("clean")).select("text", "clean", "count", "sure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for text, clean, n, sure in zip(*(b[c].to_pylist() for c in ("text", "clean", "count", "sure"))):
                different = aligned(text, clean)
                chains = [explain(x, y) for x, y in different]
                if sure and different and not any(c is not None for c in chains) and (confused := confusion(different)):
                    chains = [(confused,)] * len(different)
                for (x, y), chain in zip(different, chains):
                    if chain is None or LOST in y:
                        continue
                    if chain and ">" in chain[0]:  # such a twin passed for clean text
                        for c in x:
                            found["char", c, ""] -= n
                    for reading in chain:
                        found["reading", reading, ""] += n
                    for c in y if chain else ():
                        found["char", c, ""] += n
                    if not chain:
                        found["lost", text, clean] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([found[k] for k in keys], pa.int64())], ["what", "a", "b", "n"])

    learned = checkpoint(pairs.mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n")))
    clean_chars = (
        rows.where(~F.col("suspect")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("a"), "count")
        .groupBy("a").agg(F.sum("count").alias("n")).select(F.lit("char").alias("what"), "a", F.lit("").alias("b"), "n")
    )
    readings, chars = [], set()
    for r in learned.where("what <> 'lost'").unionByName(clean_chars).groupBy("what", "a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect():
        if r.what == "reading":
            readings.append((r.n, r.a))
        else:
            chars.add(r.a)
    lost = learned.where("what = 'lost'").groupBy(F.col("a").alias("w")).agg(F.max_by("b", F.struct("n", "b")).alias("clean"))
    return [r for _, r in sorted(readings, reverse=True)], chars, lost


#: Scripts whose characters are too many for each to be seen in clean text.
_MANY = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Cyrillic}、。（）「」]")


def repair(text: str, readings: list[str], chars: set[str]) -> str:
    """The text with every run restored that a learned reading decodes into characters of clean text."""
    leads = lone_leads(tuple(readings))
    if leads:
        text = regex.sub(rf"(?<=\p{{Ll}}|[{''.join(leads)}].)([{''.join(leads)}]) (?=( ?)\p{{Ll}})", lambda m: (leads[m[1]] + ("" if m[2] else " ")) if leads[m[1]] in chars else m[0], text)
    while True:
        before = text
        for codec in readings:
            if ">" in codec:
                continue

            def one(m) -> str:
                back = undo(m.group(), codec)
                if back is None:
                    return m.group()
                # A run may be several garbled characters of which some are chance.
                if all(c in chars or (len(back) > 1 and _MANY.match(c)) for c in back) or deeper(back):
                    return back
                return m.group()

            def deeper(back: str) -> bool:
                """Whether undoing more readings ends in characters of clean text; each makes the run shorter."""
                return any((x := undo(back, c)) is not None and (all(y in chars or _MANY.match(y) for y in x) or deeper(x)) for c in readings if ">" not in c)

            if sequence(codec).search(text):
                text = runs(codec).sub(one, text)
        if text == before:
            return text
    return text


def _confused_words(text: str, readings: list[str], chars: set[str]) -> str:
    """Runs restored from a learned confusion of two single-byte encodings.

    A run of many characters must come back in a script of many, as it was not
    before. A text whose non-ASCII characters are not all those of clean text is
    turned as a whole, if all of them then are.
    """
    for r in readings:
        if ">" in r:
            a, b = r.split(">")

            def one(m) -> str:
                try:
                    back = m.group().encode(b).decode(a)
                except (UnicodeEncodeError, UnicodeDecodeError):
                    return m.group()
                return back if len(back) > 2 and all(_MANY.match(c) for c in back) and not all(_MANY.match(c) for c in m.group()) else m.group()

            text = _PARTS.sub(one, text)
            odd = set("".join(_PARTS.findall(text)))
            if len(odd) > 1 and not odd <= chars and LOST not in odd:
                try:
                    turned = _PARTS.sub(lambda m: m.group().encode(b).decode(a), text)
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                if set("".join(_PARTS.findall(turned))) <= chars:
                    text = turned
    return text


def strays(readings: list[str], chars: set[str]) -> str:
    """The characters that learned confusions make of those of clean text, and that clean text lacks."""
    out = set()
    for r in readings:
        if ">" in r:
            a, b = r.split(">")
            out |= {c.encode(a, "ignore").decode(b, "ignore") for c in chars if not _MANY.match(c)}
    return "".join(sorted(c for c in out - chars if len(c) == 1 and not c.isascii()))


def gated(text: Column, readings: list[str], chars: set[str]) -> Column:
    """Whether anything learned may change a text: it has two non-ASCII characters in a row, a lost one, a first character left
    alone, or one that only a confusion of encodings makes."""
    pattern = r"\x{FFFD}|[^\x00-\x7F]{2}"
    if leads := lone_leads(tuple(readings)):
        pattern += "|[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(leads)) + "] "
    out = text.rlike(pattern)
    if stray := strays(readings, chars):
        out = out | (F.translate(text, stray, "") != text)
    return text.rlike(r"[^\x00-\x7F]") & out


def find_garbled(df: DataFrame, id_col: str, fields: list[str], least: int = 2) -> DataFrame:
    """id, field, stored text, restored text and whether nothing garbled is left, for every affected field.

    A field is affected if a learned reading decodes a part of it into characters
    of clean text, or if it holds U+FFFD. Lost characters are restored where the
    same words occur undamaged elsewhere; else U+FFFD stays and ``whole`` is false.
    Null and empty texts are no cases; repeated rows give one row; other columns
    are ignored. A table without any pair of twins teaches no reading, so only
    lost characters are found in it.
    """
    texts = long_fields(df, id_col, fields)
    readings, chars, lost = learn(texts.select("text"), least)
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, t in enumerate(b["text"].to_pylist()):
                f = _confused_words(repair(t, readings, chars), readings, chars)
                if f != t or LOST in t:
                    out.append((k, f))
            take = pa.array([k for k, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"].take(take), b["field"].take(take), b["text"].take(take), pa.array([f for _, f in out], pa.string())], ["id", "field", "text", "restored"])

    found = texts.where(gated(F.col("text"), readings, chars)).mapInArrow(run, f"id {kind}, field string, text string, restored string")
    found = checkpoint(found.distinct())
    hurt = F.contains("restored", F.lit(LOST))
    # Each text with a lost character gets the twins of its own windows; a text has few.
    masked = F.transform(F.regexp_extract_all("restored", F.lit(_WINDOW), F.lit(0)), lambda w: F.regexp_replace(w, r"[0-9]+", "0"))
    own = found.where(hurt).select("*", F.explode(F.array_distinct(F.filter(masked, lambda w: F.contains(w, F.lit(LOST))))).alias("w")).join(lost, "w")
    own = own.groupBy("id", "field", "text", "restored").agg(F.map_from_entries(F.collect_list(F.struct("w", "clean"))).alias("twins"))
    window = re.compile(_WINDOW)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, twins in zip(b["restored"].to_pylist(), b["twins"].to_pylist()):
                twins = {w: repair(c, readings, chars) for w, c in twins}  # a twin may itself be garbled in another way

                def one(m) -> str:
                    numbers = iter(re.findall(r"[0-9]+", m.group()))
                    clean = twins.get(re.sub(r"[0-9]+", "0", m.group()))
                    return m.group() if clean is None or suspect(clean) else re.sub("0", lambda _: next(numbers, "0"), clean)

                out.append(window.sub(one, text))
            yield pa.RecordBatch.from_arrays([b["id"], b["field"], b["text"], pa.array(out, pa.string())], ["id", "field", "text", "filled"])

    filled = own.mapInArrow(fill, f"id {kind}, field string, text string, filled string")
    best = found.join(filled, ["id", "field", "text"], "left").withColumn("restored", F.coalesce("filled", "restored"))
    return best.select("id", "field", "text", "restored", (~hurt).alias("whole"))
