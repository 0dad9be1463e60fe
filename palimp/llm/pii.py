"""Personal information in free text, by a linear-chain conditional random field.

Texts of a batch become one array of code points; tokens, word shapes, affixes
and hashes come from array operations over it. A token's features are hashed;
those of its own word are scored once per distinct word of the batch and then
taken at five offsets. The best label sequence is found by Viterbi in numpy
batches. Tokens whose label no neighbour could change are decided at once -
their lead exceeds all that transitions can give - which cuts the texts into
short stretches with the same best sequence as the whole.

The model is trained from a labelled table (see ``pii_table``; its size is the
documented bound) by stochastic gradients of the log-likelihood, the same for
the same table and seed. ``python -m palimp.llm.pii`` trains it and stores it
beside this module; queries load the stored one.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm.fields import long_fields
from palimp.llm.pii_table import KINDS, labelled_rows
from palimp.llm.words import mix

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N = len(LABELS)
OFFSETS = (-2, -1, 0, 1, 2)
#: Sizes of the hashed feature space, per offset and for the features across tokens.
WORD_BITS, CROSS_BITS = 15, 15
_WORD_SLOTS, _CROSS_SLOTS = 6, 4
#: The slots that tell a word's spelling; bucket 0 is that of no spelling.
_SPELLING = (0, 2, 3, 4)
#: Characters that are held as arrays at once.
SLICE_CHARS = 1 << 19

SPACE, LOWER, UPPER, DIGIT, OTHER, SIGN = range(6)


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded value of each code point; full-width and mathematical forms are as their plain ones.

    Code points beyond the first two planes are letters without case.
    """
    kind = np.full(0x20000, OTHER, np.uint8)
    fold = np.arange(0x20000, dtype=np.uint32)
    for cp in range(0x20000):
        if 0x10000 <= cp < 0x1D400 or cp > 0x1D7FF:
            continue
        c = chr(cp)
        if cp > 0xFF00:
            plain = unicodedata.normalize("NFKC", c)
            c = plain if len(plain) == 1 else c
        cat = unicodedata.category(c)
        if c.isspace() or cat == "Zs":
            kind[cp] = SPACE
        elif cat == "Nd":
            kind[cp] = DIGIT
        elif cat in ("Ll", "Cf", "Mn"):
            kind[cp] = LOWER
        elif cat in ("Lu", "Lt"):
            kind[cp] = UPPER
        elif cat[0] == "L":
            kind[cp] = OTHER
        else:
            kind[cp] = SIGN
        low = c.lower()
        if len(low) == 1 and kind[cp] != SIGN:
            fold[cp] = ord(low)
        if kind[cp] == DIGIT:
            fold[cp] = ord("0")
    return kind, fold


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    return _class_table()


@dataclass
class Tokens:
    """Tokens of a slice of texts, in order: text number, start and end in it, and features."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray  # features of the token's word: slots x tokens
    group: np.ndarray  # number of the distinct word
    distinct: np.ndarray  # first token of each distinct word
    shape: np.ndarray
    folded: np.ndarray


def tokenize(texts: list[str]) -> Tokens:
    """Runs of letters, runs of digits and single signs; a line break or the end of a text separates."""
    kind_of, fold_of = tables()
    joined = "\x00".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    low = np.minimum(cp, 0x1FFFF)
    kind, fold = kind_of[low], fold_of[low]
    kind[begin[1:-1] - 1] = SPACE
    group = np.array([0, 1, 1, 2, 3, 4], np.uint8)[kind]
    first = np.empty(len(cp), bool)
    first[:1] = True
    first[1:] = (group[1:] != group[:-1]) | (group[1:] == 4)
    first &= group > 0
    start = np.flatnonzero(first)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, np.zeros((_WORD_SLOTS, 0), np.int64), z, z, z, z)
    bound = np.flatnonzero(np.append((group[1:] != group[:-1]) | (group[1:] == 4) | (group[1:] == 0), True)) + 1
    end = bound[np.searchsorted(bound, start, "right")]
    text = np.searchsorted(begin, start, "right") - 1
    length = end - start
    # Prefix sums give a hash of any run; the mix of place and value makes order count.
    inside = np.arange(len(cp)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(cp)]])))
    powers = mix(np.arange(1, int(inside.max()) + 2, dtype=np.uint64)) | np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((fold.astype(np.uint64) + np.uint64(1)) * powers[inside])])
    folded = mix(sums[end] - sums[start])

    def affix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
        h = np.full(len(a), salt, np.uint64)
        for k in range(4):
            at = a + k
            h = np.where(at < b, mix(h + fold[np.minimum(at, len(cp) - 1)].astype(np.uint64) * np.uint64(31) + np.uint64(k)), h)
        return h

    # Shape: class of the first, second and last character, whether mixed, and length.
    k0, k1, k2 = kind[start], kind[np.minimum(start + 1, end - 1)], kind[end - 1]
    digits = kind[start] == DIGIT
    sign = np.where(k0 == SIGN, low[start], 0)
    shape = (((k0 * np.uint64(7) + k1) * np.uint64(7) + k2) * np.uint64(32) + np.where(digits, np.minimum(length, 14), np.minimum(length, 3)).astype(np.uint64)).astype(np.uint64) + sign.astype(np.uint64) * np.uint64(100003)
    exact = mix(folded + shape * np.uint64(17))
    _, distinct, number = np.unique(exact, return_index=True, return_inverse=True)
    s, e = start[distinct], end[distinct]
    f, sh, ln = folded[distinct], shape[distinct], length[distinct]
    one = np.where(digits[distinct], mix(sh), f)
    slots = [one, mix(sh + np.uint64(1)), affix(s, e, 3), affix(np.maximum(s, e - 3), e, 5), affix(np.maximum(s, e - 4), e, 7), mix(np.minimum(ln, 12).astype(np.uint64) * np.uint64(8) + k0[distinct] + np.uint64(977))]
    word = np.stack([(mix(x + np.uint64(1 + i)) >> np.uint64(64 - WORD_BITS)).astype(np.int64) for i, x in enumerate(slots)])
    return Tokens(text, start - begin[text], end - begin[text], word, number, distinct, mix(shape), np.where(digits, mix(shape), folded))


def cross_features(t: Tokens) -> np.ndarray:
    """Features over neighbouring tokens of a text: slots x tokens."""
    n = len(t.text)
    pad = lambda x, k: _shifted(x, t.text, k)
    before, after, before2, after2 = pad(t.folded, -1), pad(t.folded, 1), pad(t.shape, -1), pad(t.shape, 1)
    space = np.zeros(n, np.uint64)
    space[1:] = ((t.start[1:] > t.end[:-1]) & (t.text[1:] == t.text[:-1])).astype(np.uint64)
    slots = [
        mix(before * np.uint64(3) + t.shape), mix(t.shape * np.uint64(5) + after), mix(before2 * np.uint64(7) + t.shape * np.uint64(11) + after2), mix(before2 * np.uint64(13) + t.shape * np.uint64(3) + space),
    ]
    return np.stack([(mix(x + np.uint64(101 + i)) >> np.uint64(64 - CROSS_BITS)).astype(np.int64) for i, x in enumerate(slots)])


def _shifted(x: np.ndarray, text: np.ndarray, k: int, outside: int = 1) -> np.ndarray:
    """x of the token k places further in the same text."""
    out = np.full(len(x), outside, x.dtype)
    if len(x) <= abs(k):
        return out
    a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
    same = text[a] == text[b]
    out[b][same] = x[a][same]
    return out


@dataclass
class Model:
    """Weights of the features and of the transitions."""

    word: np.ndarray  # offsets x buckets x labels
    cross: np.ndarray  # buckets x labels
    edge: np.ndarray  # offsets x labels: no such token
    transition: np.ndarray  # labels x labels
    first: np.ndarray

    @classmethod
    def zero(cls) -> Model:
        f = np.float32
        return cls(np.zeros((len(OFFSETS), 1 << WORD_BITS, N), f), np.zeros((1 << CROSS_BITS, N), f), np.zeros((len(OFFSETS), N), f), np.zeros((N, N), f), np.zeros(N, f))


#: Transitions that no labelling has: an inner label after anything but its own kind.
ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
ALLOWED_FIRST = np.array([not a.startswith("I-") for a in LABELS])


def emissions(model: Model, t: Tokens) -> np.ndarray:
    """The score of each label for each token."""
    n = len(t.text)
    out = np.zeros((n, N), np.float32)
    for k, offset in enumerate(OFFSETS):
        of_word = np.zeros((len(t.distinct) + 1, N), np.float32)
        for slot in t.word:
            of_word[:-1] += model.word[k][slot]
        of_word[-1] = model.edge[k]
        at = t.group if offset == 0 else _shifted(t.group, t.text, offset, len(t.distinct))
        out += of_word[at]
    for slot in cross_features(t):
        out += model.cross[slot]
    return out


def viterbi(scores: np.ndarray, start: np.ndarray, length: np.ndarray, transition: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The best label of every token of the given stretches, many stretches at a time.

    ``first`` and ``last`` are added to the first and the last token's scores.
    """
    out = np.zeros(len(scores), np.int8)
    order = np.argsort(length, kind="stable")
    for lo in range(0, len(order), 4096):
        of = order[lo : lo + 4096]
        s, n = start[of], length[of]
        most = int(n.max())
        back = np.zeros((most, len(of), N), np.int8)
        best = scores[s] + first
        if last is not None:
            best[n == 1] += last
        for k in range(1, most):
            live = np.flatnonzero(n > k)
            step = best[live][:, :, None] + transition
            back[k, live] = step.argmax(1)
            new = step.max(1) + scores[s[live] + k]
            if last is not None:
                new[n[live] == k + 1] += last
            best[live] = new
        label = best.argmax(1).astype(np.int8)
        for k in range(most - 1, -1, -1):
            live = np.flatnonzero(n > k)
            out[s[live] + k] = label[live]
            if k:
                label[live] = back[k, live, label[live]]
    return out


def _most_gain(transition: np.ndarray, first: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The most that another label than O can win on transitions at each token, whatever stands beside it.

    Where an inner label follows, O instead makes it a beginning, whose scores
    also count. A token where O leads by more than this is O in the best sequence.
    """
    before = np.vstack([transition, first])  # also the begin of a text
    before = np.where(before > -1e3, before, np.nan)
    before = before - before[:, :1]
    follow = np.hstack([transition, np.zeros((N, 1), np.float32)])  # also its end
    here = np.where((follow > -1e3) & (follow[0] > -1e3), follow - follow[0], np.nan)
    enter = np.nanmax(before[:, 1:], 0)
    most = np.full(len(scores), np.nanmax(enter[:, None] + here[1:]), np.float32)
    for k in range(1, N, 2):  # B and I of a kind
        into = np.nanmax(enter[[k - 1, k]] + transition[[k, k + 1], k + 1]) - transition[0, k]
        out = np.nanmax(np.where((follow[k + 1] > -1e3) & (follow[k] > -1e3), follow[k + 1] - follow[k], np.nan))
        more = np.append(scores[1:, k + 1] - scores[1:, k], -np.inf)
        np.maximum(most, into + out + more, out=most)
    return most + np.float32(1e-3)


def decode(model: Model, t: Tokens) -> np.ndarray:
    """The label of every token: the best sequence of each text."""
    if not len(t.text):
        return np.zeros(0, np.int8)
    scores = emissions(model, t)
    transition = np.where(ALLOWED, model.transition, -1e4).astype(np.float32)
    first = np.where(ALLOWED_FIRST, model.first, -1e4).astype(np.float32)
    sure = scores[:, 0] - scores[:, 1:].max(1) > _most_gain(transition, first, scores)
    begins = np.append(True, t.text[1:] != t.text[:-1])
    # A stretch begins at a text's begin or after a sure token, and ends before a sure token.
    open_ = ~sure
    head = open_ & (begins | np.append(True, sure[:-1]))
    starts = np.flatnonzero(head)
    out = np.zeros(len(t.text), np.int8)
    if not len(starts):
        return out
    stop = np.flatnonzero(np.append((begins | sure)[1:], True)) + 1
    ends = stop[np.searchsorted(stop, starts, "right")]
    # The O before and after a stretch takes part; at a text's begin the first label's score does.
    from_o = np.where(begins[starts][:, None], first, transition[0])
    scores = scores.copy()
    scores[starts] += from_o
    after_o = (ends < len(t.text)) & ~np.append(begins, True)[ends]
    scores[ends[after_o] - 1] += transition[:, 0]
    return viterbi(scores, starts, ends - starts, transition, np.zeros(N, np.float32))


def token_labels(t: Tokens, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """The labels that marked spans give the tokens."""
    out = np.zeros(len(t.text), np.int64)
    at = np.searchsorted(t.text, np.arange(len(spans) + 1))
    for k, marked in enumerate(spans):
        for a, b, kind in marked:
            own = [i for i in range(at[k], at[k + 1]) if t.start[i] < b and a < t.end[i]]
            for j, i in enumerate(own):
                out[i] = LABELS.index(f"{'I' if j else 'B'}-{kind}")
    return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 5, batch: int = 128, rate: float = 0.2, decay: float = 2e-6, unseen: float = 0.25, seed: int = 3) -> Model:
    """Maximum-likelihood weights by AdaGrad over batches of passages; deterministic.

    A share ``unseen`` of a batch's distinct words loses its spelling for that
    step, as if never met, so that shape and context have to tell them.
    """
    model, rng = Model.zero(), np.random.default_rng(seed)
    sums = Model(*(np.full_like(x, 1e-6) for x in vars(model).values()))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            part = [rows[i] for i in order[lo : lo + batch]]
            t = tokenize([x for x, _ in part])
            gold = token_labels(t, [s for _, s in part])
            t.word[np.ix_(_SPELLING, np.flatnonzero(rng.random(len(t.distinct)) < unseen))] = 0
            delta, trans, start = _gradient(model, t, gold)
            step = lambda w, s, g: (s.__iadd__(g * g), w.__iadd__(rate * g / np.sqrt(s)))
            step(model.transition, sums.transition, trans)
            step(model.first, sums.first, start)
            for k, offset in enumerate(OFFSETS):
                at = t.group if offset == 0 else _shifted(t.group, t.text, offset, len(t.distinct))
                of_word = _summed(at, delta, len(t.distinct) + 1)
                step(model.edge[k], sums.edge[k], of_word[-1])
                used, inverse = np.unique(t.word, return_inverse=True)
                g = np.zeros((len(used), N), np.float32)
                for slot in inverse.reshape(t.word.shape):
                    g += _summed(slot, of_word[:-1], len(used))
                _sparse(model.word[k], sums.word[k], used, g, rate, decay)
            cross = cross_features(t)
            used, inverse = np.unique(cross, return_inverse=True)
            g = np.zeros((len(used), N), np.float32)
            for slot in inverse.reshape(cross.shape):
                g += _summed(slot, delta, len(used))
            _sparse(model.cross, sums.cross, used, g, rate, decay)
            model.word[:, 0] = 0
    return model


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, c], n) for c in range(values.shape[1])], 1).astype(np.float32)


def _sparse(weights: np.ndarray, sums: np.ndarray, used: np.ndarray, g: np.ndarray, rate: float, decay: float) -> None:
    g = g - decay * weights[used]
    s = sums[used] + g * g
    sums[used] = s
    weights[used] += rate * g / np.sqrt(s)


def _gradient(model: Model, t: Tokens, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed less expected labels per token, transitions and first labels (forward-backward in a padded batch)."""
    scores = emissions(model, t).astype(np.float64)
    begin = np.flatnonzero(np.append(True, t.text[1:] != t.text[:-1]))
    length = np.diff(np.append(begin, len(t.text)))
    m, most = len(begin), int(length.max())
    at = begin[:, None] + np.minimum(np.arange(most), length[:, None] - 1)
    x = scores[at]
    real = np.arange(most) < length[:, None]
    trans = np.where(ALLOWED, model.transition, -1e4).astype(np.float64)
    first = np.where(ALLOWED_FIRST, model.first, -1e4)
    expt = np.exp(trans)
    alpha, beta = np.zeros((most, m, N)), np.zeros((most, m, N))
    alpha[0] = x[:, 0] + first
    for k in range(1, most):
        top = alpha[k - 1].max(1, keepdims=True)
        new = np.log(np.exp(alpha[k - 1] - top) @ expt + 1e-300) + top + x[:, k]
        alpha[k] = np.where(real[:, k, None], new, alpha[k - 1])
    z = _logsum(alpha[-1])
    for k in range(most - 2, -1, -1):
        nxt = beta[k + 1] + x[:, k + 1]
        top = nxt.max(1, keepdims=True)
        new = np.log(np.exp(nxt - top) @ expt.T + 1e-300) + top
        beta[k] = np.where(real[:, k + 1, None], new, 0)
    p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    delta = np.zeros((len(t.text), N), np.float32)
    delta[at[real]] = -p[real]
    delta[np.arange(len(gold)), gold] += 1
    pairs = np.zeros((N, N))
    for k in range(most - 1):
        live = real[:, k + 1]
        if live.any():
            joint = alpha[k][live][:, :, None] + trans + (beta[k + 1] + x[:, k + 1])[live][:, None, :] - z[live][:, None, None]
            pairs -= np.exp(joint).sum(0)
    inner = np.flatnonzero(t.text[1:] == t.text[:-1])
    np.add.at(pairs, (gold[inner], gold[inner + 1]), 1)
    start = -p[:, 0].sum(0)
    np.add.at(start, gold[begin], 1)
    return delta, (pairs * ALLOWED).astype(np.float32), (start * ALLOWED_FIRST).astype(np.float32)


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(-1, keepdims=True)
    return np.log(np.exp(a - top).sum(-1)) + top[..., 0]


#: The stored weights: 8-bit steps of the largest weight of each array.
STORED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_model.npz")


def save(model: Model, path: str = STORED) -> None:
    parts = {}
    for k, w in vars(model).items():
        step = float(np.abs(w).max()) / 127 or 1.0
        parts |= {k: np.round(w / step).astype(np.int8), f"{k}_step": np.float32(step)}
    np.savez_compressed(path, **parts)


def load(path: str = STORED) -> Model:
    with np.load(path) as f:
        return Model(*(f[k].astype(np.float32) * f[f"{k}_step"] for k in ("word", "cross", "edge", "transition", "first")))


def train_mean(tables: int = 6, rows: int = 24000, seed: int = 7) -> Model:
    """The mean of the models of ``tables`` labelled tables of ``rows`` passages each.

    The likelihood is concave in the weights, so their mean is a model of all
    tables that depends less on the chance of one.
    """
    mean = Model.zero()
    for k in range(tables):
        for m, w in zip(vars(mean).values(), vars(train(labelled_rows(rows, seed + k))).values()):
            m += w / np.float32(tables)
    return mean


@lru_cache(1)
def trained() -> Model:
    """The stored model; where it is missing, one is trained from a single table."""
    return load() if os.path.exists(STORED) else train(labelled_rows())


def spans_of(t: Tokens, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and kind number of every labelled span."""
    kind = (labels + 1) // 2
    begins = (labels > 0) & ((labels % 2 == 1) | np.append(True, (kind[1:] != kind[:-1]) | (t.text[1:] != t.text[:-1])))
    at = np.flatnonzero(begins)
    last = np.flatnonzero((labels > 0) & np.append(begins[1:] | (labels[1:] == 0), True))
    return t.text[at], t.start[at], t.end[last], kind[at] - 1


PLACEHOLDERS = [f"[{k.upper()}]" for k in KINDS]


def find_personal(df: DataFrame, id_col: str, fields: list[str], model: Model | None = None, redact: bool = True) -> DataFrame:
    """id, field, kinds (array) and, unless left out, the text with placeholders, of every field with personal information.

    Null and empty texts hold none. Repeated rows give repeated results unless
    made distinct; deliveries with other texts are judged on their own. Texts of
    any length are decoded as a whole. Columns other than those named are ignored.
    """
    model = model or trained()
    rows = long_fields(df, id_col, fields).where(F.length("text") > 0)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # about 8 MB, set by the feature bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b["text"].to_pylist()
            sizes = np.cumsum([len(x) for x in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_CHARS, "right")))
                part = texts[lo:hi]
                t = tokenize(part)
                of, start, end, kind = spans_of(t, decode(m, t))
                hit, place = np.unique(of, return_index=True)
                bounds = np.append(place, len(of))
                kinds, clean = [], []
                for k, text in enumerate(hit.tolist()):
                    a, z = bounds[k], bounds[k + 1]
                    kinds.append([KINDS[i] for i in np.unique(kind[a:z])])
                    if redact:
                        out, at = [], 0
                        for s, e, i in zip(start[a:z].tolist(), end[a:z].tolist(), kind[a:z].tolist()):
                            out += [part[text][at:s], PLACEHOLDERS[i]]
                            at = e
                        clean.append("".join(out) + part[text][at:])
                take = pa.array(hit + lo)
                columns, names = [b["id"].take(take), b["field"].take(take), pa.array(kinds, pa.list_(pa.string()))], ["id", "field", "kinds"]
                if redact:
                    columns.append(pa.array(clean, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, field string, kinds array<string>" + ", text string" * redact)


if __name__ == "__main__":
    save(train_mean())
