from palimp.llm import mojibake
from palimp.llm.mojibake import aligned, explain, find_garbled, repair, undo


def read_as(text, codec):
    back = {b: c for c, b in mojibake.table(codec).items()}
    if codec == "cp1252":
        back |= {b: bytes([b]).decode("cp1252") for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return "".join(chr(b) if b < 128 else back[b] for b in text.encode())


def test_alignment_explains_readings():
    for codec in ("cp1252", "mac_roman", "cp850", "cp437"):
        chain = explain(read_as("ü", codec), "ü")  # encodings that agree on these characters are as good
        assert chain and undo(read_as("ü", codec), chain[0]) == "ü"
    twice = read_as(read_as("°", "cp1252"), "cp1252")
    assert explain(twice, "°") == ("cp1252", "cp1252")
    assert explain("�", "é") == ()
    assert explain("x́", "é") is None
    assert aligned("Ã¼ber den FluÃŸ", "über den Fluß") == [("Ã¼", "ü"), ("ÃŸ", "ß")]


def test_correct_text_stays():
    chars = set("’éàÇÃ°µ")
    readings = ["cp1252", "mac_roman", "cp850"]
    for t in ("l’été", "ATENÇÃO", "NÃO ABRIR", "Âge", "5 °C ± 1", "Symbols ¬, √ and ∞"):
        assert repair(t, readings, chars) == t
    assert repair("dâ€™Ã©tÃ©", readings, chars) == "d’été"


def test_undo_is_exact_round_trip():
    for codec in mojibake.READINGS:
        for t in ("für", "naïve", "Серия", "洗浄"):
            back = {b: c for c, b in mojibake.table(codec).items()}
            garbled = "".join(chr(b) if b < 128 else back[b] for b in t.encode())
            if all(c.isascii() for c in garbled) or codec == "cp1252":
                continue
            for run in mojibake._PARTS.findall(garbled):
                assert undo(run, codec) is not None


SCHEMA = "id string, old_text string, new_text string, text string, suspect boolean, count long"


def test_learned_from_twins_and_applied_elsewhere(spark):
    clean = "Der Prüfer wäscht den Behälter für 5 Minuten bei 20 °C."
    rows = [(f"a{k}", clean.replace("5", str(k)), read_as(clean.replace("5", str(k)), "cp1252")) for k in range(6)]
    rows += [("far", None, "La tempÃ©rature fÃ¼r"), ("ok", "l’été à Ålesund, ATENÇÃO", None), ("lost", "Der Pr�fer wäscht den", ""), ("long", "x" * 200_000 + " " + read_as("für", "cp1252"), None)]
    rows += [("none", None, None), ("empty", "", ""), (None, "Ã¼", None)] + rows[:2]
    rows += [("e", "température", "é é")] * 2
    df = spark.createDataFrame([(i, a, b, "t", True, 1) for i, a, b in rows], SCHEMA)
    got = {(r.id, r.field): r for r in find_garbled(df, "id", ["old_text", "new_text"]).collect()}
    assert set(got) == {(f"a{k}", "new_text") for k in range(6)} | {("far", "new_text"), ("lost", "old_text"), ("long", "old_text")}
    assert got["a1", "new_text"].restored == clean.replace("5", "1") and got["a1", "new_text"].whole
    assert got["far", "new_text"].restored == "La température für"


def found(spark, texts):
    df = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "id string, old_text string")
    return {r.id: r.restored for r in find_garbled(df, "id", ["old_text"]).collect()}


def test_any_number_of_readings_is_undone():
    chars = set("éü°")
    for depth in range(1, 6):
        t = "café für 5 °C"
        for _ in range(depth):
            t = read_as(t, "cp1252") if depth < 3 else read_as(t, "cp850")
        assert repair(t, ["cp1252", "cp850"], chars) == "café für 5 °C"
    four = "é"
    for _ in range(4):
        four = read_as(four, "cp850")
    assert explain(four, "é") == ("cp850",) * 4


def test_unlisted_encoding_is_learned(spark):
    assert "mac_latin2" not in mojibake.READINGS and "mac_latin2" in mojibake.all_encodings()
    clean = ["Der Prüfer öffnet den grünen Behälter früh.", "Die Tür schließt für fünf Gäste."]
    bad = [read_as(t, "mac_latin2") for t in clean]
    got = found(spark, [*clean, *clean, *bad, read_as("Ein kühler Tag", "mac_latin2")])
    assert got == {"i4": clean[0], "i5": clean[1], "i6": "Ein kühler Tag"}


def test_confused_latin_encodings(spark):
    clean = ["La télé était à côté du château", "Une fenêtre fermée près du café"]
    bad = [t.encode("cp1252").decode("mac_roman") for t in clean]
    got = found(spark, [*clean, *clean, bad[0], bad[1], "Le côté gauche".encode("cp1252").decode("mac_roman"), "Ålesund ist schön"])
    assert got == {"i4": clean[0], "i5": clean[1], "i6": "Le côté gauche"}


def test_no_break_space_made_a_blank(spark):
    clean = ["Voilà un été déjà passé", "Il est là depuis février"]
    twins = [read_as(t, "cp1252") for t in clean]
    blank = lambda t: t.replace("\xa0", " ")
    got = found(spark, [*clean, *clean, *twins, blank(read_as("voilà tout", "cp1252")), "voilÃ tout", "IRMÃ DE MARIA"])
    assert got == {"i4": clean[0], "i5": clean[1], "i6": "voilà tout", "i7": "voilà tout"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, old_text string")
    assert find_garbled(df, "id", ["old_text"]).count() == 0
