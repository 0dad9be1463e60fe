import pytest

from palimp.llm.confusables import find_lookalikes, kinds, normalize, normalize_fields

CASES = [
    ("ﬁle", "file", ["form"]), ("０．６１", "0.61", ["form"]), ("𝗐𝗂𝗍𝗁", "with", ["form"]), ("cοrridоr", "corridor", ["mixed"]), ("Pսrpοse", "Purpose", ["mixed"]),
    ("über", "über", ["mark"]), ("un​der", "under", ["invisible"]), ("a b", "a b", ["blank"]), ("a　b", "a b", ["blank"]), ("μL", "µL", ["mixed"]),
]
PLAIN = ["m² cm³ ½ turn", "5 °C ± 2 µg", "“quoted” – don’t", "Перед вскрытием", "αβγ", "ロットB", "a\tb\nc\r d", "Œuvre", "", "β-lactam", "€ № ℃"]


@pytest.mark.parametrize("text,want,what", CASES)
def test_cases(text, want, what):
    assert kinds(text) == what
    assert normalize(text) == want
    assert normalize(want) == want


@pytest.mark.parametrize("text", PLAIN)
def test_no_cases(text):
    assert kinds(text) == [] and normalize(text) == text


OTHERS = [("Ꭺpple", "Apple"), ("ɑpple", "apple"), ("ʀussia", "Russia"), ("ⲟpen", "open"), ("gооgⅼe", "google"), ("ꓮlarm", "Alarm"), ("Xⅼ", "Xl")]


@pytest.mark.parametrize("text,want", OTHERS)
def test_other_alphabets(text, want):
    assert normalize(text) == want and normalize(want) == want
    assert "mixed" not in kinds(text) or "о" in text


@pytest.mark.parametrize("text", ["[ɡɪt] [ʀ]", "kʰæt ʃɪp", "ᏣᎳᎩ", "ⲕⲟⲡⲧ", "Kapitel Ⅳ"])
def test_words_in_those_alphabets_stay(text):
    assert normalize(text) == text and "mixed" not in kinds(text)


def test_spellings_against_all_scripts():
    """The script taken for a mixed word spells all of it; of several, it keeps the most letters as they are."""
    from palimp.llm.confusables import _ALL, _FROM_LATIN, _TO_LATIN, consistent, resolved, scripts

    letters = ["о", "р", "с", "a", "b", "ο", "ν", "n", "ո", "h"]
    for a in letters:
        for b in letters:
            for c in letters:
                w = a + b + c
                got = consistent(w)
                if resolved(w):
                    assert got == w
                    continue
                best = {}
                for s in sorted(_ALL):
                    spelling = [x if s in scripts(x) else _TO_LATIN.get(x) if s == "Latin" else _FROM_LATIN.get((s, _TO_LATIN.get(x, x))) for x in w]
                    if all(spelling):
                        best["".join(spelling)] = max(best.get("".join(spelling), 0), sum(s in scripts(x) for x in w))
                assert got == w if not best else best.get(got) == max(best.values()), (w, got, best)


def test_whole_script_confusable_in_latin_text():
    assert normalize("the сор was in the house and stayed there") == "the cop was in the house and stayed there"
    assert normalize("сор был") == "сор был"


SCHEMA = "id string, old_text string, new_text string, kinds string, field string, text string"


def test_table(spark):
    rows = [(f"c{k}", t, None) for k, (t, _, _) in enumerate(CASES)] + [(f"p{k}", t, None) for k, t in enumerate(PLAIN)]
    rows += [("long", "x " * 100_000 + "ﬁ", "ok"), ("null", None, None), (None, "ﬁ", None)] + rows[:3]
    df = spark.createDataFrame([(i, a, b, "k", "f", "t") for i, a, b in rows], SCHEMA)
    got = find_lookalikes(df, "id", ["old_text", "new_text"]).collect()
    assert sorted((r.id, r.field) for r in got) == sorted([(f"c{k}", "old_text") for k in range(len(CASES))] + [("long", "old_text")])
    every = {(r.id, r.field): r.text for r in normalize_fields(df, "id", ["old_text", "new_text"]).collect()}
    assert every["c0", "old_text"] == "file" and every["p0", "old_text"] == PLAIN[0] and ("null", "old_text") not in every
    assert find_lookalikes(df.limit(0), "id", ["old_text"]).count() == 0
