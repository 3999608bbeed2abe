"""Quality by attention-based multiple-instance learning: a document is a bag of passages, and only the document has a label.

Every passage (64 words) is encoded: measurements of its bytes and words go through a learned layer. Gated attention, learned from the document labels alone, weighs the passages of
a document; the weighted sum of their codes is scored. Training runs in numpy on a bounded sample of labelled documents, scoring over all documents where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.batches import small_batches
from runsight.llm.sampling import labelled_texts, remainder
from runsight.llm.textbytes import SPACED, Words, blocks, mix

PASSAGE = 64
CODE, ATTENTION = 24, 12
#: Bounds of the training sample, and training.
DOCS_PER_LABEL, DOC_BYTES = 3_000, 1 << 16
EPOCHS, BATCH, RATE = 30, 64, 0.01
#: Byte classes: lower case, upper case, digits, stops, marks, symbols, white space, beyond ASCII, other.
_CLASS = np.full(256, 8, np.uint8)
for _k, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:", b"!?'\"()-", b"#*$%&|<>@=+/\\_~^{}[]", (32, *range(9, 14)), range(128, 256))):
    _CLASS[[*_members]] = _k
_CLASSES = 9
FEATURES = _CLASSES * _CLASSES + _CLASSES + 5


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of each passage (rows), and the borders of the texts; a text without words is one passage of zeros.

    Per passage: shares of byte classes and of pairs of them, share of distinct words, of words equal to the one before and of words that occurred before in the text, word length, lines.
    """
    sizes = np.diff(words.rows)
    counts = np.maximum(-(-sizes // PASSAGE), 1)
    borders = np.concatenate([[0], np.cumsum(counts)])
    n = int(borders[-1])
    out = np.zeros((n, FEATURES), np.float32)
    total = len(words.hash)
    if not total:
        return out, borders
    text = np.repeat(np.arange(len(words)), sizes)
    own = borders[text] + (np.arange(total) - words.rows[text]) // PASSAGE  # passage of each word
    first = np.flatnonzero(np.diff(own, prepend=-1))
    used = own[first]
    # Bytes from a passage's first word up to the next passage, or the end of the text.
    begin = words.start[first]
    end = np.minimum(np.append(begin[1:], len(words.data)), words.bytes[1:][text[first]])
    kinds = _CLASS[words.data]
    owner = np.repeat(np.arange(len(first)), end - begin)
    places = np.arange(len(owner)) + np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin)
    kind = kinds[places].astype(np.int64)
    follows = kinds[np.minimum(places + 1, len(kinds) - 1)].astype(np.int64)
    length = (end - begin)[:, None].astype(np.float32)
    out[used, :_CLASSES] = np.bincount(owner * _CLASSES + kind, minlength=len(first) * _CLASSES).reshape(-1, _CLASSES) / length
    square = _CLASSES * _CLASSES
    out[used, _CLASSES : _CLASSES + square] = np.bincount(owner * square + kind * _CLASSES + follows, minlength=len(first) * square).reshape(-1, square) / length
    held = np.bincount(own, minlength=n)[used].astype(np.float32)
    per = lambda flags: np.bincount(own, flags, n)[used] / held
    rest = out[:, _CLASSES + square :]
    in_passage, in_text = mix(words.hash ^ mix(own.astype(np.uint64))), mix(words.hash ^ mix(text.astype(np.uint64)))
    new = np.zeros(total, bool)
    new[np.unique(in_passage, return_index=True)[1]] = True
    known = np.ones(total, bool)
    known[np.unique(in_text, return_index=True)[1]] = False
    same = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])])
    rest[used, 0], rest[used, 1], rest[used, 2] = per(new), per(same), per(known)
    rest[used, 3] = per(words.end - words.start) / 10
    rest[used, 4] = np.bincount(owner, words.data[places] == 10, len(first)) / held
    return out, borders


class Model:
    """Encoder, gated attention and output; ``shift`` and ``scale`` standardise the measurements."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, seed: int = 0) -> None:
        draw = np.random.default_rng(seed).normal
        self.shift, self.scale = shift, scale
        self.weights = {
            "encode": draw(0, len(shift) ** -0.5, (len(shift), CODE)),
            "encode0": np.zeros(CODE),
            "tanh": draw(0, CODE**-0.5, (CODE, ATTENTION)),
            "gate": draw(0, CODE**-0.5, (CODE, ATTENTION)),
            "attend": draw(0, ATTENTION**-0.5, ATTENTION),
            "out": draw(0, CODE**-0.5, CODE),
            "out0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, borders: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of documents whose passages are rows ``borders[i]`` to ``borders[i + 1]``, with everything on the way."""
        w, starts, sizes = self.weights, borders[:-1], np.diff(borders)
        x = np.clip((x - self.shift) / self.scale, -6, 6)
        code = np.tanh(x @ w["encode"] + w["encode0"])
        t, g = np.tanh(code @ w["tanh"]), 1 / (1 + np.exp(-(code @ w["gate"])))
        energy = (t * g) @ w["attend"]
        e = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), sizes))
        attention = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(code * attention[:, None], starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out0"][0], -30, 30)))
        return {"x": x, "code": code, "t": t, "g": g, "attention": attention, "bag": bag, "score": score}

    def gradients(self, x: np.ndarray, borders: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean log loss of documents."""
        w, f, sizes = self.weights, self.forward(x, borders), np.diff(borders)
        d = (f["score"] - labels) * weight / weight.sum()
        grads = {"out": f["bag"].T @ d, "out0": np.array([d.sum()])}
        d_bag = np.repeat(d[:, None] * w["out"], sizes, axis=0)
        d_code = d_bag * f["attention"][:, None]
        pull = (d_bag * f["code"]).sum(axis=1)
        mean = np.add.reduceat(pull * f["attention"], borders[:-1])
        d_energy = f["attention"] * (pull - np.repeat(mean, sizes))
        grads["attend"] = (f["t"] * f["g"]).T @ d_energy
        d_tg = d_energy[:, None] * w["attend"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        grads["tanh"], grads["gate"] = f["code"].T @ d_t, f["code"].T @ d_g
        d_pre = (d_code + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (1 - f["code"] ** 2)
        grads["encode"], grads["encode0"] = f["x"].T @ d_pre, d_pre.sum(axis=0)
        return grads


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, decay: float = 1e-4, seed: int = 0) -> Model:
    """Fit a model to bags of passages; both labels weigh the same in all."""
    rows = np.concatenate(bags)
    model, rng = Model(rows.mean(axis=0), rows.std(axis=0) + 1e-3, seed), np.random.default_rng(seed)
    weight = np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum())))
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step, steps = 0, epochs * -(-len(bags) // BATCH)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(bags)), -(-len(bags) // BATCH)):
            step += 1
            borders = np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])])
            grads = model.gradients(np.concatenate([bags[i] for i in at]), borders, labels[at], weight[at])
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.weights[k] = model.weights[k] * (1 - decay) - rate * (1 - step / (steps + 1)) * move
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_label: int = DOCS_PER_LABEL) -> Model | None:
    """Model learned from labels (doc_id, quality 0 or 1) of rows whose crc32 remainder is not ``held``; None unless both labels occur."""
    known = labels.where(F.col("quality").isin(0, 1) & (remainder("doc_id", folds) != held)).select("doc_id", F.col("quality").alias("label"))
    sample = labelled_texts(docs, known, per_label, DOC_BYTES)
    marks = np.array([int(label) for _, label in sample])
    if not len(np.unique(marks)) == 2:
        return None
    bags: list[np.ndarray] = []
    for _, words in blocks(pa.array([t for t, _ in sample], pa.large_string()), SPACED):
        rows, borders = passages(words)
        bags += [rows[a:b] for a, b in zip(borders[:-1], borders[1:])]
    return train(bags, marks)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row; 0.5 if nothing was learned. Null texts count as empty: one passage of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, 0.5)
            if model is not None:
                for first, words in blocks(batch.column(1), SPACED):
                    found[first : first + len(words)] = model.forward(*passages(words))["score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more) of every document.

    Labels other than 0 and 1, and labels of unknown documents, are passed over; of repeated labels the larger stands. Rows that share a doc_id are scored one by one;
    a null id counts as remainder 0; an empty table gives no rows. A score depends on the text alone.
    """
    found = scores(docs, fit(docs, labels, folds, held))
    return found.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
