import pytest

from palimp.llm.sentences import lattice_words, sentence_starts, split_sentences

# Sentences of one block each, in order.
BLOCKS = [
    ["The run took approx. 4.1 h vs. 5.2 h on it.", "pH values above 7.2 were kept.", "iTrace was used."],
    ["As Fig.~3 shows, it falls, i.e.\\ long before.", "(A proof appears in Sec.~7.)", "Dr. Velk and Prof. Lor met."],
    ["He noted: ``No lens broke. We stopped.'' in the log of run 5.", "``It never ends,'' she wrote."],
    ["The site in the U.K. saw 3, the one in the U.S. only 4.", "52 of them were kept.", "$T_c$ rises by 3.1."],
    ["We tried a lens, a horn, etc.", "This yields 5.", "Chips from J. K. Lor, M. Vel, etc. were kept."],
    ["Well... the lens broke!", "Why at all?!", "Hence it was."],
    ["Am 24. Oktober wurde die Probe Nr. 3 gemessen.", "„Die Messung ist ungültig.“ stand im Protokoll von Dr. Lor.", "Er bleibt i.\\,d.\\,R. klein."],
    ["« Le signal disparaît. » note le carnet, p. 4.", "Quel écart !", "M. Lor et Mme Vel ont mesuré l’échantillon n° 2."],
    ["¿Se cumple también?", "«No hay señal.» dice el cuaderno.", "El Dr. Lor y la Sra. Vel midieron la muestra núm. 4.", "¡Desaparece!"],
    ["А. Б. Велков и М. Тасков измерили образец № 5.", "Решётки, каналы и т. д. описаны ниже.", "«Сигнал исчез. Мы остановились.» записано на с. 3.", "В 264 г. опыт повторили."],
    ["査読者は「信号が消えた。実験を止めた。」と書いたが、記録はない。", "（証明は第4節にある。）", "膜、格子…は付録で述べる。", "Ver. 3.5を用いた。", "本当か？"],
    ["审稿人写道：“信号消失了。我们停止了。”但记录并不完整。", "（证明见第5节。）", "样品……都在附录中。", "成立吗？"],
    ["प्रतिवेदन में लिखा है, “संकेत नहीं मिला।” और बात वहीं रुकी।", "डॉ. वेल्क ने नमूना सं. 4 को मापा।", "क्या यह सही है?"],
    ["كتب المحكم: «لا توجد إشارة.» في الصفحة 5.", "هل يصح ذلك؟", "قاس د. فيلك العينة مرتين."],
]


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("gap", [" ", "\n", "  "])
def test_blocks(block, gap):
    text = gap.join(block)
    want, at = [], 0
    for s in block:
        want.append(at)
        at += len(s) + len(gap)
    assert sentence_starts(text) == want
    assert sentence_starts("\\section{A}\n\n% no. No.\n\n" + text + "\n\n\\[ x. Y \\]\n") == [w + 24 for w in want]


def test_spaceless_without_blanks():
    block = BLOCKS[10][:3]
    assert sentence_starts("".join(block)) == [0, len(block[0]), len(block[0] + block[1])]


def test_lattice_prefers_longer_words():
    assert lattice_words("といった事") == ["といった", "事"]


def test_table(spark):
    rows = [(1, "A b. C d.\n\nE f"), (2, None), (3, ""), (4, "\\begin{x}\nA. B."), (5, "Q r. " * 50_000), (1, "A b. C d.\n\nE f"), (None, "A. B.")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start_pos int, sentence string")
    got = split_sentences(df, "doc_id", "text").collect()
    assert sorted((r.start_pos, r.end_pos, r.sentence) for r in got if r.id == 1) == sorted([(0, 4, "A b."), (5, 9, "C d."), (11, 14, "E f")] * 2)
    assert sum(r.id == 5 for r in got) == 50_000
    assert {r.id for r in got} == {1, 5}
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0
