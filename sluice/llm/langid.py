"""Language identification by a bidirectional gated recurrent network over the bytes of a text.

The network is trained here, in numpy, by backpropagation through time on windows of ``SPAN`` bytes from a
bounded sample of labelled documents, and every position of a window is trained to say the language.  A
prediction runs it over every byte of the whole text, window after window, labels each position with
probabilities, and pools them over the document by their mean.  A window that ends before ``SPAN`` is padded, and both
directions keep the state zero in the padding, so that the backward one starts at the last byte of the text.  A
window's first bytes may be the rest of a character that the window before began.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import numbered
from sluice.llm.shingling import _buffers as text_buffers
from sluice.shipping import ship

#: Bytes of a window, units of each direction, windows that are run side by side.
SPAN, UNITS, BESIDE = 64, 12, 1024
#: The sample that is learned from: at most so many documents in all, so many windows of each.
SAMPLE_DOCUMENTS, WINDOWS = 2000, 8
#: Training: steps, windows in a step, and Adam's rate at the start and the end.
STEPS, BATCH, RATES = 400, 160, (0.03, 0.003)
UNKNOWN = "und"
#: Part of the way from chance to what rightly predicted windows score that a long document must reach, and bytes at which a text must reach half of that.
REACHED, TELLING = 0.4, 2 * SPAN


@dataclass
class Model:
    """Weights of both directions: ``inputs`` (3H x 256) by byte, ``turns`` (3H x H), ``shift`` (H); gates reset, update, new."""

    langs: list[str]
    inputs: list[np.ndarray]
    turns: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.turns, *self.shift, self.out, self.bias]


def fresh(langs: list[str], seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    h, some = UNITS, lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Model(langs, [some(3 * h, 256) for _ in "fb"], [some(3 * h, h) for _ in "fb"], [np.zeros((h, 1), np.float32) for _ in "fb"], some(len(langs), 2 * h), np.zeros((len(langs), 1), np.float32))


#: Gates are hard sigmoids, ``clip(SLOPE * x + 0.5, 0, 1)``, and new states softsigns, ``x / (1 + |x|)``: a few
#: vector instructions where an exponential would take most of the time.
SLOPE = np.float32(0.25)


def _learn_direction(inputs: np.ndarray, turn: np.ndarray, shift: np.ndarray, x: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T x H x B) of one direction, zero where not ``inside`` (T x B) the text, and what its gradient needs."""
    h, kept, states = np.zeros((UNITS, x.shape[1]), np.float32), [], []
    for t in range(len(x)):
        a, u = inputs[:, x[t]], turn @ h
        u[2 * UNITS :] += shift
        gate = np.clip(SLOPE * (a[: 2 * UNITS] + u[: 2 * UNITS]) + np.float32(0.5), 0, 1)
        r, z = gate[:UNITS], gate[UNITS:]
        n = a[2 * UNITS :] + r * u[2 * UNITS :]
        n /= 1 + np.abs(n)
        kept.append((h, r, z, n, u[2 * UNITS :]))
        h = (n + z * (h - n)) * inside[t]
        states.append(h)
    return np.stack(states), kept


def _direction_gradient(turn: np.ndarray, x: np.ndarray, inside: np.ndarray, kept: list, dstates: np.ndarray) -> list[np.ndarray]:
    """Gradients of inputs, turn and shift, going back through time."""
    dturn, dshift, dh = np.zeros_like(turn), 0.0, 0.0
    da = np.empty((len(x), 3 * UNITS, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, r, z, n, u = kept[t]
        dh = (dh + dstates[t]) * inside[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        slope = lambda gate: SLOPE * ((gate > 0) & (gate < 1))
        da[t] = np.concatenate([dn * u * slope(r), dh * (h - n) * slope(z), dn])
        du = np.concatenate([da[t, : 2 * UNITS], dn * r])
        dturn += du @ h.T
        dshift = dshift + du[2 * UNITS :].sum(1, keepdims=True)
        dh = dh * z + turn.T @ du
    flat, at = da.transpose(1, 0, 2).reshape(3 * UNITS, -1), x.ravel()
    return [np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), dturn, dshift]


def loss_and_gradient(m: Model, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions of windows ``x`` (T x B), and gradients in the order of ``weights``."""
    hf, kf = _learn_direction(m.inputs[0], m.turns[0], m.shift[0], x, mask)
    hb, kb = _learn_direction(m.inputs[1], m.turns[1], m.shift[1], x[::-1], mask[::-1])
    both = np.concatenate([hf, hb[::-1]], axis=1)
    logits = m.out @ both + m.bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = np.arange(len(m.langs))[:, None] == y
    weight = mask / mask.sum()
    loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y, (len(x), 1, x.shape[1])), 1)[:, 0] + 1e-9) * weight).sum())
    d = (p - want) * weight[:, None]
    dboth = np.einsum("lh,tlb->thb", m.out, d, optimize=True).astype(np.float32)
    gf = _direction_gradient(m.turns[0], x, mask, kf, dboth[:, :UNITS])
    gb = _direction_gradient(m.turns[1], x[::-1], mask[::-1], kb, dboth[::-1, UNITS:])
    return loss, [gf[0], gb[0], gf[1], gb[1], gf[2], gb[2], np.einsum("tlb,thb->lh", d, both, optimize=True), d.sum((0, 2))[:, None]]


def train(windows: list[bytes], labels: list[str]) -> Model:
    """A model of the languages among ``labels``; batches take each language equally often."""
    langs = sorted(set(labels))
    m = fresh(langs)
    if len(langs) < 2:
        return m
    x = np.zeros((SPAN, len(windows)), np.uint8)
    mask = np.zeros((SPAN, len(windows)), np.float32)
    for i, w in enumerate(windows):
        x[: len(w), i], mask[: len(w), i] = np.frombuffer(w, np.uint8), 1
    y = np.array([langs.index(v) for v in labels])
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    rng, ws = np.random.default_rng(11), m.weights()
    one, two = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws]
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, len(langs), BATCH)])
        _, grads = loss_and_gradient(m, x[:, pick], mask[:, pick], y[pick])
        size = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        rate = RATES[0] * (RATES[1] / RATES[0]) ** (step / STEPS)
        for w, g, a, b in zip(ws, grads, one, two):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


class Runner:
    """Probabilities of texts under a model; the gates' slope and middle are put into the weights once."""

    def __init__(self, m: Model):
        self.m, h = m, UNITS
        scale = np.r_[np.full(2 * h, SLOPE), np.ones(h)].astype(np.float32)[:, None]
        middle = np.r_[np.full(2 * h, 0.5), np.zeros(h)].astype(np.float32)[:, None]
        self.inputs = [np.ascontiguousarray(w * scale + middle) for w in m.inputs]
        self.turns = [np.ascontiguousarray(w * scale) for w in m.turns]

    def states(self, way: int, x: np.ndarray, inside: np.ndarray | None, out: np.ndarray) -> None:
        """Fills ``out`` (T x H x B) with the states of one direction over ``x`` (T x B); ``inside`` (T x B) is None if all of it is text."""
        h2, b = 2 * UNITS, x.shape[1]
        inputs, turn, shift = self.inputs[way], self.turns[way], self.m.shift[way]
        a, u = np.empty((3 * UNITS, b), np.float32), np.empty((3 * UNITS, b), np.float32)
        size = np.empty((UNITS, b), np.float32)
        h = np.zeros((UNITS, b), np.float32)
        for t in range(len(x)):
            np.take(inputs, x[t], axis=1, out=a, mode="clip")
            np.matmul(turn, h, out=u)
            gate, n, un = a[:h2], a[h2:], u[h2:]
            gate += u[:h2]
            np.maximum(gate, 0, out=gate)
            np.minimum(gate, 1, out=gate)
            un += shift
            un *= gate[:UNITS]
            n += un
            np.abs(n, out=size)
            size += 1
            n /= size
            new = out[t]
            np.subtract(h, n, out=new)
            new *= gate[UNITS:]
            new += n
            if inside is not None:
                new *= inside[t]
            h = new

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Mean over all positions of each text of the languages' probabilities (documents x languages)."""
        data, off = text_buffers(texts)
        data = data[off[0] : off[-1]]
        off = off - off[0]
        size = np.diff(off)
        per = -(-size // SPAN)
        owner = np.repeat(np.arange(len(size)), per)
        begin = off[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * SPAN
        length = np.minimum(SPAN, off[1:][owner] - begin)
        whole_first = np.argsort(length < SPAN, kind="stable")  # padding costs a step more
        owner, begin, length = owner[whole_first], begin[whole_first], length[whole_first]
        total = np.zeros((len(size), len(self.m.langs)))
        step = np.arange(SPAN)[:, None]
        beside = max(8, BESIDE * 128 // max(128, len(self.m.langs)))  # so that memory doesn't grow with the languages
        states = np.empty((SPAN, 2 * UNITS, beside), np.float32)
        for at in range(0, len(owner), beside):
            own = slice(at, at + beside)
            inside = step < length[own]
            x = np.where(inside, data[np.minimum(begin[own] + step, max(len(data) - 1, 0))], 0).astype(np.intp)
            both = states[:, :, : x.shape[1]]
            self.states(0, x, None, both[:, :UNITS])
            self.states(1, x[::-1], None if inside.all() else inside[::-1].astype(np.float32), both[::-1, UNITS:])
            p = np.matmul(self.m.out, both)
            p += self.m.bias
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= (inside / p.sum(1))[:, None].astype(np.float32)
            window = p.sum(0, dtype=np.float64)
            for k in range(len(self.m.langs)):
                total[:, k] += np.bincount(owner[own], window[k], len(size))
        return total / np.maximum(size, 1)[:, None]


def held_out(key: Column) -> Column:
    """The documents that nothing is learned from: crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[bytes], list[str]]:
    """Windows and labels from at most ``SAMPLE_DOCUMENTS`` labelled documents that aren't held out, spread evenly over languages by a hash of the id.

    So it holds as many languages at most; of more the most frequent are learned, ties by code point.  Null texts, labels and ids teach nothing;
    long texts give windows from their beginning to their end; an empty table gives nothing.
    """
    usable = docs.select(docs[key].alias("id"), docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("t")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE_DOCUMENTS)
    counts = {r["lang"]: r["n"] for r in known.collect()}
    if not counts:
        return [], []
    each = max(1, SAMPLE_DOCUMENTS // len(counts))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * each / n + 20 / n))))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    few = usable.withColumn("draw", draw).where((F.col("draw") < share[F.col("lang")] * (1 << 30)) & F.col("t").isNotNull())
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("rank") <= each)
    size = F.length("t")
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.floor(F.greatest(size - SPAN, F.lit(0)) * k / (WINDOWS - 1)).cast("int") + 1)
    cuts = few.select("lang", "id", F.explode(F.array_distinct(F.transform(starts, lambda s: F.substr("t", s, F.lit(SPAN))))).alias("w")).where("w <> ''")
    rows = sorted(map(tuple, cuts.select("lang", "id", "w").collect()))
    return [w.encode()[:SPAN] for _, _, w in rows], [lang for lang, _, _ in rows]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from :func:`sample`; one that knows no language if nothing is labelled, always the one language if all labels are equal."""
    return train(*sample(docs, key, text, lang))


def threshold(model: Model, windows: list[bytes], labels: list[str], otherwise: float) -> float:
    """The score that a document must reach: from chance, ``1 / K`` for ``K`` languages, ``REACHED`` of the way to the 5% quantile of the rightly predicted sample.

    So it moves with the number of languages and with what the model can tell.  With one language every score is
    1 and nothing is asked; ``otherwise`` holds where the sample has nothing that is predicted rightly.
    """
    if len(model.langs) == 1:
        return 0.0
    if not windows or not model.langs:
        return otherwise
    p = Runner(model).pooled(pa.array([w.decode(errors="ignore") for w in windows], pa.string()))
    right = p.max(1)[np.array(model.langs, dtype=object)[p.argmax(1)] == np.array(labels, dtype=object)]
    chance = 1 / len(model.langs)
    return float(chance + max(np.quantile(right, 0.05) - chance, 0.0) * REACHED) if len(right) else otherwise


def _labelled(run: Runner, texts: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    langs = np.array([*run.m.langs, UNKNOWN], dtype=object)
    has = letters.to_numpy(zero_copy_only=False).astype(bool)
    if len(langs) == 1:
        return langs[np.zeros(len(has), int)], np.zeros(len(has))
    p = run.pooled(texts)
    return langs[np.where(has, p.argmax(1), len(langs) - 1)], np.where(has, np.clip(p.max(1), 0, 1), 0.0)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, lang_pred, score`` for every row; a narrow pass over whole texts.

    The language is ``und``, with score 0, for a null text, one without any letter, or when the model knows no
    language.  Ties between languages go to the first by code point.  Null keys, equal and repeated rows are
    predicted one by one; an empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Runner(shared.value)
        for b in batches:
            best, score = _labelled(run, b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["k", "lang_pred", "score"])

    read = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"), _has_letter(docs[text]).alias("has"))
    out = read.mapInArrow(label, f"k {kind}, lang_pred string, score double")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "lang_pred", "score")


def required(least: float, languages: int, size: np.ndarray) -> np.ndarray:
    """The score that texts of ``size`` bytes must reach: from chance for an empty one towards ``least`` as evidence grows."""
    chance = 1 / max(languages, 1)
    return np.full(len(size), least) if least <= chance else chance + (least - chance) * size / (size + TELLING)


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with the score that their length asks for (:func:`required`).

    Null and empty texts and those without any letter go.  If the model knows no language, as nothing was labelled,
    no text can be told from another and all rows stay.  Long texts are judged whole; repeated rows and null keys are
    judged one by one; other columns are passed on, whatever their names; an empty table gives an empty result.
    """
    if not model.langs:
        return docs
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, column = numbered(docs)
    at = [c.lower() for c in docs.columns].index(text.lower())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Runner(shared.value)
        for b in batches:
            best, score = _labelled(run, b.column(at), b.column(b.num_columns - 1))
            size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.float64)
            yield b.select(range(b.num_columns - 1)).filter(pa.array((best != UNKNOWN) & (score >= required(least, len(shared.value.langs), size))))

    return plain.withColumn("has", _has_letter(column(text))).mapInArrow(keep, plain.schema).toDF(*docs.columns)
