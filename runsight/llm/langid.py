"""Language identification by a bidirectional gated recurrent network over bytes.

Words (ASCII letters lower-cased, digits, all bytes beyond ASCII) are the sequences; longer runs are cut at ``LONGEST`` bytes. Two GRUs read the bytes forwards and backwards and
every position gets a probability per language; a document's probability is the mean over all its positions. The network is trained in numpy by backpropagation through
time on a bounded sample of labelled documents.

A word's positions do not depend on the words around it, so each worker labels a word once and remembers the sum over its positions: the sum for a document is the
same as if every occurrence were run through the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.llm.batches import small_batches
from runsight.llm.exprs import fresh
from runsight.llm.sampling import labelled_texts, remainder
from runsight.llm.textbytes import LETTERS, _LOWER, Words, blocks

LONGEST = 24
HIDDEN = 16
#: Bounds of the training sample, and steps of training.
DOCS_PER_LANGUAGE, DOC_BYTES, WORDS_PER_LANGUAGE = 600, 1 << 16, 30_000
STEPS, BATCH, RATE = 500, 256, 0.02
REMEMBERED = 500_000
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Weights: per direction a table of input terms per byte (3 gates) and recurrent matrices; one output layer over both states."""

    def __init__(self, classes: int, hidden: int, seed: int = 0) -> None:
        draw = np.random.default_rng(seed).normal
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {}
        for side in "fb":
            self.weights[f"x{side}"] = draw(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.weights[f"u{side}"] = draw(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.weights["out"] = draw(0, 0.1, (2 * hidden, classes)).astype(np.float32)
        self.weights["bias"] = np.zeros(classes, np.float32)

    def _run(self, codes: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States after each byte (time, words, hidden), in the order of reading. ``codes``: (words, time)."""
        h, n = self.hidden, len(codes)
        table, u = self.weights[f"x{side}"], self.weights[f"u{side}"]
        state = np.zeros((n, h), np.float32)
        states = np.empty((codes.shape[1], n, h), np.float32)
        for t in range(codes.shape[1]):
            x, r = table[codes[:, t]], state @ u
            gates = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            keep, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
            before, state = state, new + keep * (state - new)
            states[t] = state
            if trace is not None:
                trace.append((before, keep, reset, new, r[:, 2 * h :]))
        return states

    def probabilities(self, codes: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (time, words, classes) and the states they come from."""
        forward, backward = traces or (None, None)
        states = np.concatenate([self._run(codes, "f", forward), self._run(codes[:, ::-1], "b", backward)[::-1]], axis=2)
        logits = states @ self.weights["out"] + self.weights["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), states

    def gradients(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (weighted mean over positions) and its gradients by backpropagation through time."""
        traces: tuple[list, list] = ([], [])
        p, states = self.probabilities(codes, traces)
        steps, n, _ = p.shape
        share = (weight / (weight.sum() * steps)).astype(np.float32)
        loss = -float((np.log(p[:, np.arange(n), labels] + 1e-9) * share).sum())
        d = p * share[None, :, None]
        d[:, np.arange(n), labels] -= share
        grads = {"out": np.einsum("tnh,tnc->hc", states, d), "bias": d.sum(axis=(0, 1))}
        back = d @ self.weights["out"].T
        h = self.hidden
        for side, trace, own, read in (("f", traces[0], back[:, :, :h], codes), ("b", traces[1], back[::-1, :, h:], codes[:, ::-1])):
            u = self.weights[f"u{side}"]
            gx, gu, carry = np.zeros_like(self.weights[f"x{side}"]), np.zeros_like(u), np.zeros((n, h), np.float32)
            for t in range(steps - 1, -1, -1):
                before, keep, reset, new, r = trace[t]
                ds = own[t] + carry
                dn = ds * (1 - keep) * (1 - new * new)
                dk = ds * (before - new) * keep * (1 - keep)
                dr = dn * r * reset * (1 - reset)
                recurrent = np.concatenate([dk, dr, dn * reset], axis=1)
                carry = ds * keep + recurrent @ u.T
                gu += before.T @ recurrent
                np.add.at(gx, read[:, t], np.concatenate([dk, dr, dn], axis=1))
            grads[f"x{side}"], grads[f"u{side}"] = gx, gu
        return loss, grads


def train(sequences: list[tuple[bytes, int]], classes: int, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Network:
    """Fit a network to (bytes, class) pairs. Batches hold words of one length; classes weigh the same in all."""
    network, rng = Network(classes, hidden, seed), np.random.default_rng(seed)
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for word, label in sequences:
        by_length.setdefault(len(word), []).append((word, label))
    lengths = sorted(by_length)
    codes = {n: np.frombuffer(b"".join(w for w, _ in by_length[n]), np.uint8).reshape(-1, n) for n in lengths}
    labels = {n: np.array([c for _, c in by_length[n]]) for n in lengths}
    frequency = np.maximum(np.bincount([c for _, c in sequences], minlength=classes), 1)
    weight = len(sequences) / (classes * frequency)
    odds = np.array([n * len(labels[n]) for n in lengths], float)
    odds /= odds.sum()
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for step in range(1, steps + 1):
        n = lengths[rng.choice(len(lengths), p=odds)]
        at = rng.integers(0, len(labels[n]), batch)
        _, grads = network.gradients(codes[n][at], labels[n][at], weight[labels[n][at]])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.weights[k] -= (pace * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


class Labeller:
    """Sums of position probabilities per distinct word, remembered by the word's hash."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.keys = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(network.weights["bias"])), np.float32)

    def _label(self, lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums for words given by their places; long words are cut."""
        out = np.zeros((len(start), self.sums.shape[1]), np.float32)
        size = end - start
        for cut in range(0, int(size.max(initial=0)), LONGEST):
            rest = np.minimum(size - cut, LONGEST)
            for n in np.unique(rest[rest > 0]):
                own = np.flatnonzero(rest == n)
                for at in np.array_split(own, -(-len(own) // 4096)):
                    p, _ = self.network.probabilities(lower[start[at, None] + cut + np.arange(n)])
                    out[at] += p.sum(axis=0)
        return out

    def documents(self, words: Words) -> np.ndarray:
        """Mean probability per class over all positions of each text; zeros for a text without words."""
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        sums = np.empty((len(keys), self.sums.shape[1]), np.float32)
        sums[known] = self.sums[at[known]]
        if not known.all():
            new = first[~known]
            sums[~known] = self._label(_LOWER[words.data], words.start[new], words.end[new])
            merged = np.concatenate([self.keys, keys[~known]]), np.concatenate([self.sums, sums[~known]])
            if len(merged[0]) > REMEMBERED:
                merged = keys, sums
            order = np.argsort(merged[0])
            self.keys, self.sums = merged[0][order], merged[1][order]
        total = np.zeros((len(words.hash) + 1, sums.shape[1]))
        np.cumsum(sums[back], axis=0, dtype=np.float64, out=total[1:])
        places = np.concatenate([[0], np.cumsum(words.end - words.start)])
        rows = words.rows
        return (total[rows[1:]] - total[rows[:-1]]) / np.maximum(places[rows[1:]] - places[rows[:-1]], 1)[:, None]


_LABELLERS: dict[int, Labeller] = {}


def _labeller(network: Network) -> Labeller:
    """This worker's memory for a network, known by its weights."""
    key = hash(b"".join(w.tobytes() for _, w in sorted(network.weights.items())))
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(network)
    return _LABELLERS[key]


def fit(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE) -> tuple[Network | None, list[str]]:
    """Network and its languages, learned from documents with a language whose crc32 remainder is not ``held``; (None, []) without any."""
    own = docs.where(remainder("doc_id", folds) != held)
    sample = labelled_texts(own, own.select("doc_id", F.col("lang").alias("label")), per_language, DOC_BYTES)
    languages = sorted({lang for _, lang in sample})
    rng, sequences = np.random.default_rng(0), []
    for label, lang in enumerate(languages):
        cuts: list[bytes] = []
        for _, words in blocks(pa.array([t for t, name in sample if name == lang], pa.large_string()), LETTERS):
            lower = _LOWER[words.data].tobytes()
            cuts += [lower[i : min(i + LONGEST, e)] for s, e in zip(words.start.tolist(), words.end.tolist()) for i in range(s, e, LONGEST)]
        if len(cuts) > words_per_language:
            cuts = [cuts[i] for i in rng.choice(len(cuts), words_per_language, replace=False)]
        sequences += [(c, label) for c in cuts]
    return (train(sequences, len(languages)), languages) if sequences else (None, [])


def predict(docs: DataFrame, network: Network | None, languages: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (mean probability over all positions; 0 for ``und``) under ``names`` in front of their columns.

    Null texts and texts without a letter are ``und``, as is everything if nothing was learned. Of equal probabilities the first language by name wins.
    """
    lettered = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    given = small_batches(docs).select(lettered.alias(fresh(docs, "letters")), *[F.col(c) for c in docs.columns])
    labels = np.array([*languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _labeller(network) if network else None
        for batch in batches:
            at = batch.schema.names.index("text")
            best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            if own is not None:
                for first, words in blocks(batch.column(at), LETTERS):
                    p = own.documents(words)
                    best[first : first + len(words)], score[first : first + len(words)] = p.argmax(axis=1), p.max(axis=1)
            blank = ~batch.column(0).to_numpy(zero_copy_only=False) | (score <= 0)
            best[blank], score[blank] = len(languages), 0.0
            yield pa.RecordBatch.from_arrays([pa.array(labels[best], pa.string()), pa.array(np.minimum(score, 1.0)), *batch.columns[1:]], [*names, *batch.schema.names[1:]])

    out = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), *docs.schema.fields])
    return given.mapInArrow(run, out)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Rows are judged one by one, also where they share a doc_id; null ids count as remainder 0. Only doc_id, text and, for learning,
    lang are read; an empty table gives no rows."""
    network, languages = fit(docs, folds, held)
    found = predict(docs.select("doc_id", "text"), network, languages)
    return found.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, reject_below: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """``docs`` without the rows that have no letter and without those in which no language reaches ``reject_below`` (four languages have 0.25 by chance). If
    no language could be learned, all rows with a letter stay."""
    network, languages = fit(docs, folds, held)
    if network is None:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = predict(docs, network, languages, (lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= reject_below)).select(*docs.columns)
