import numpy as np
import pytest

from palimp.llm import pii
from palimp.llm.pii import ALLOWED, ALLOWED_FIRST, KINDS, LABELS, decode, emissions, find_personal, spans_of, token_labels, tokenize, train, viterbi
from palimp.llm.pii_table import labelled_rows
from tests.llm.pii_heldout import held_out


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_training_is_repeatable_and_learns(tmp_path):
    rows = labelled_rows(600)
    one, two = train(rows, epochs=2), train(labelled_rows(600), epochs=2)
    assert all(np.array_equal(a, b) for a, b in zip(vars(one).values(), vars(two).values()))
    t = tokenize([x for x, _ in rows])
    assert (decode(one, t) == token_labels(t, [s for _, s in rows])).mean() > 0.95
    pii.save(one, str(tmp_path / "m.npz"))
    back = pii.load(str(tmp_path / "m.npz"))
    assert all(np.abs(a - b).max() <= np.abs(a).max() / 250 for a, b in zip(vars(one).values(), vars(back).values()))


def test_passages_of_another_hand(model):
    """The stored model on passages that the labelled table's generator did not make; the figures are those of the README."""
    rows = held_out()
    t = tokenize([x for x, _ in rows])
    a, b = found(t, decode(model, t)), found(t, token_labels(t, [s for _, s in rows]).astype(np.int8))
    for k, kind in enumerate(KINDS):
        x, y = ({of for of, n in s if n == k} for s in (a, b))
        assert len(x & y) / len(x) >= 0.9, kind
        assert len(x & y) / len(y) >= (0.65 if kind == "name" else 0.85), kind


def found(t, labels):
    of, _, _, kind = spans_of(t, labels)
    return set(zip(of.tolist(), kind.tolist()))


def test_held_out_accuracy(model):
    rows = labelled_rows(600, seed=1234)
    t = tokenize([x for x, _ in rows])
    gold = token_labels(t, [s for _, s in rows])
    got = decode(model, t)
    assert (got == gold).mean() > 0.98
    a, b = found(t, got), found(t, gold.astype(np.int8))
    assert len(a & b) / len(a) > 0.97 and len(a & b) / len(b) > 0.97


def test_stretches_decode_as_the_whole(model):
    rows = labelled_rows(400, seed=55)
    t = tokenize([x for x, _ in rows])
    begin = np.flatnonzero(np.append(True, t.text[1:] != t.text[:-1]))
    f = np.float32
    whole = viterbi(emissions(model, t), begin, np.diff(np.append(begin, len(t.text))), np.where(ALLOWED, model.transition, -1e4).astype(f), np.where(ALLOWED_FIRST, model.first, -1e4).astype(f))
    assert (whole == decode(model, t)).all()


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(0)
    n = len(LABELS)
    scores, trans, first = rng.normal(size=(3, n)).astype("f"), rng.normal(size=(n, n)).astype("f"), rng.normal(size=n).astype("f")
    got = viterbi(scores, np.array([0]), np.array([3]), trans, first)
    total = first[:, None, None] + scores[0][:, None, None] + trans[:, :, None] + scores[1][None, :, None] + trans[None] + scores[2][None, None]
    assert tuple(got) == np.unravel_index(total.argmax(), total.shape)


def test_tokens():
    t = tokenize(["Ab12 c,\nd", "", "ｅé"])
    assert [(int(x), int(a), int(b)) for x, a, b in zip(t.text, t.start, t.end)] == [(0, 0, 2), (0, 2, 4), (0, 5, 6), (0, 6, 7), (0, 8, 9), (2, 0, 2)]
    assert len(tokenize([]).text) == 0 and len(tokenize([""]).text) == 0


SCHEMA = "id string, note string, old_text string, kinds string, field string, text string"


def test_table(spark, model):
    rows = [("a", "Spoke to Ms Thornholt, fine.", None), ("b", "pls mail ingrid.velkton@example.org before accepting", "called (202) 555-0172, no answer"), ("c", "ok", "")]
    rows += [("long", None, "Weigh 12.3 mg of Zetoraquin-B2 on balance F45355. " * 3000 + "Tel. +44 20 7946 0551."), ("null", None, None), (None, "Spoke to Ms Thornholt, fine.", None)] + rows[:1]
    df = spark.createDataFrame([(i, a, b, "k", "f", "t") for i, a, b in rows], SCHEMA)
    got = {(r.id, r.field): r for r in find_personal(df, "id", ["note", "old_text"], model).collect()}
    assert got["a", "note"].kinds == ["name"] and "[NAME]" in got["a", "note"].text and "Thornholt" not in got["a", "note"].text
    assert got["b", "note"].kinds == ["email"] and got["b", "old_text"].kinds == ["phone"]
    assert got["b", "note"].text.startswith("pls mail [EMAIL]")
    assert got["long", "old_text"].kinds == ["phone"]
    assert {i for i, _ in got} == {"a", "b", "long"}
    assert find_personal(df.limit(0), "id", ["note"], model).count() == 0
    assert pii.PLACEHOLDERS == ["[" + k.upper() + "]" for k in KINDS]
