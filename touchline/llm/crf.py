"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad; its features are its own and
those of the lines before and after it. Forward-backward gives each line's
marginal of being good, and their mean, weighted by the lines' lengths and put
on a probability scale by a logistic fit, is the document's quality.

Labels are of documents, so those of lines are latent. The fit alternates:
it maximises the likelihood of line labels, and labels the lines anew by their
marginals, while most (``KEEPS_LABEL``) of a document's characters keep its label.
The first round knows no transitions, so that lines are told apart by what they
are; later rounds learn from chains in which labels change.

The fit uses a bounded sample: ``SAMPLE_PER_CLASS`` labelled documents of each
class, the least by hash of their ids among those that the table has, of each
the first ``SAMPLE_LINES`` lines. Their features are computed where the texts
are, and only features reach the driver. All documents are scored whole, row by
row, without a shuffle.

Nulls: a null text is the empty text. A text without words counts as one line
whose features are all zero. Null labels aren't learnt from; of labels that
contradict each other the higher counts. With labels of fewer than two classes,
and so with an empty table, every score is 0.5. Repeated rows have equal scores,
and ids of equal hash come by id. Texts of very many or very long lines are
scored whole. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_group, lean, modest_batches, string_buffers, table, text_or_empty

SAMPLE_PER_CLASS, SAMPLE_LINES = 1200, 400
#: Rounds of labelling lines, steps of each fit, and the share of a document's characters that keeps its label.
ROUNDS, STEPS, RATE, RIDGE = 3, 120, 0.15, 1e-3
KEEPS_LABEL = 0.75
BLOCK_BYTES = 1 << 20

FEATURES = ("has_word", "log_chars", "log_words", "word_chars", "symbols", "bars", "upper", "digits", "exclaims", "closed", "opened", "short_words", "long_words", "commas", "copied", "distinct", "wide_bytes")


def _bytes(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in chars]] = True
    return mask


_UPPER, _LOWER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789")
_SYMBOL, _BAR, _EXCLAIM, _COMMA, _CLOSE = _bytes("#*$%&|<>"), _bytes("|"), _bytes("!"), _bytes(",;:"), _bytes(".?\"')")
_SPACE = _bytes(" \t\n\x0b\x0c\r")
_LEADS = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_WIDE = np.arange(256) >= 0x80


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters) of every line that counts, and the n+1 offsets of each text's lines."""
    data, rows = string_buffers(texts)
    n_docs = len(rows) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([rows[:-1], breaks + 1]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    ends = np.append(starts[1:], len(data))
    doc = np.searchsorted(rows, starts, side="right") - 1
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends

    def count(mask: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask[data] if at is None else at, out=total[1:])
        return total[ends] - total[starts]

    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = rows[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] |= ~space[inner]
    words = count(_LEADS, begins)
    letters_up, letters_low = count(_UPPER), count(_LOWER)
    chars, wide = count(_LEADS), count(_WIDE)
    solid = np.maximum(chars - count(_SPACE), 1)

    word_at = np.flatnonzero(begins)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=kept[1:])
    word_ends = np.append(kept[word_at], kept[-1])
    sizes = np.diff(word_ends)
    word_line = np.searchsorted(starts, word_at, side="right") - 1
    short = np.bincount(word_line, sizes <= 3, minlength=len(starts))
    long_ = np.bincount(word_line, sizes >= 16, minlength=len(starts))
    solid_bytes = np.ascontiguousarray(data[~space])
    coded = pa.Array.from_buffers(pa.large_binary(), len(word_at), [None, pa.py_buffer(word_ends), pa.py_buffer(solid_bytes)]).dictionary_encode()
    different = max(len(coded.dictionary), 1)
    pairs = np.unique(word_line * different + coded.indices.to_numpy(zero_copy_only=False)) if len(word_at) else np.zeros(0, np.int64)
    distinct = np.bincount(pairs // different, minlength=len(starts))

    # lines that occur again in their document
    is_break = np.zeros(len(data), bool)
    is_break[ends[ends < len(data)][data[ends[ends < len(data)]] == 10]] = True
    body = np.ascontiguousarray(data[~is_break])
    cut = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~is_break, out=cut[1:])
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(cut[starts], len(body))), pa.py_buffer(body)]).dictionary_encode()
    key = doc * np.int64(max(len(lines.dictionary), 1)) + lines.indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    copied = (times[back] > 1) if len(key) else np.zeros(0, bool)

    real, w = words > 0, np.maximum(words, 1)
    letters = np.maximum(letters_up + letters_low + wide, 1)
    last, first = data[np.maximum(ends - 1, 0)] if len(starts) else ends, data[starts]
    columns = [
        np.ones(len(starts)), np.log1p(chars) / 3, np.log1p(words) / 2, np.minimum(solid / w, 30) / 6, count(_SYMBOL) / w, count(_BAR) / w, letters_up / letters, count(_DIGIT) / solid,
        count(_EXCLAIM) / w, _CLOSE[last], _UPPER[first] | _WIDE[first], short / w, long_ / w, count(_COMMA) / w, copied, distinct / w, wide / solid,
    ]
    found = np.stack([np.asarray(c, np.float32) for c in columns], axis=1)[real] if len(starts) else np.zeros((0, len(FEATURES)), np.float32)
    doc, chars = doc[real], chars[real].astype(np.float64)
    lonely = np.setdiff1d(np.arange(n_docs), doc)
    doc_all = np.concatenate([doc, lonely])
    order = np.argsort(doc_all, kind="stable")
    found = np.concatenate([found, np.zeros((len(lonely), len(FEATURES)), np.float32)])[order]
    chars = np.concatenate([chars, np.ones(len(lonely))])[order]
    return found, chars, np.searchsorted(doc_all[order], np.arange(n_docs + 1))


def with_neighbours(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it in its document (zero at the edges), and a constant."""
    before, after = np.zeros_like(found), np.zeros_like(found)
    before[1:], after[:-1] = found[:-1], found[1:]
    before[rows[:-1]] = 0
    after[rows[1:] - 1] = 0
    return np.concatenate([found, before, after, np.ones((len(found), 1), np.float32)], axis=1)


def marginals(gain: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, the expected transitions (2 x 2), and each document's log partition.

    ``gain``: score of good over bad by line; ``steps[a, b]``: score of label b
    after a (1: good). Documents run side by side, the longest first.
    """
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    first, size = rows[:-1][order], sizes[order]
    live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    ahead, back = np.zeros((len(gain), 2)), np.zeros((len(gain), 2))
    for t, n in enumerate(live.tolist()):
        at = first[:n] + t
        if t == 0:
            ahead[at, 1] = gain[at]
        else:
            p = ahead[at - 1]
            ahead[at, 0] = np.logaddexp(p[:, 0] + steps[0, 0], p[:, 1] + steps[1, 0])
            ahead[at, 1] = np.logaddexp(p[:, 0] + steps[0, 1], p[:, 1] + steps[1, 1]) + gain[at]
    expected = np.zeros((2, 2))
    last = rows[1:] - 1
    total = np.logaddexp(ahead[last, 0], ahead[last, 1])
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        bad, good = back[at, 0], back[at, 1] + gain[at]
        back[at - 1, 0] = np.logaddexp(bad + steps[0, 0], good + steps[0, 1])
        back[at - 1, 1] = np.logaddexp(bad + steps[1, 0], good + steps[1, 1])
        z = total[order[: live[t]]]
        for a in (0, 1):
            for b, to in ((0, bad), (1, good)):
                expected[a, b] += np.exp(ahead[at - 1, a] + steps[a, b] + to - z).sum()
    z = np.repeat(total, sizes)
    return np.exp(np.minimum(ahead[:, 1] + back[:, 1] - z, 0)), expected, total


@dataclass
class Model:
    weights: np.ndarray
    steps: np.ndarray
    slope: float
    intercept: float

    def raw(self, found: np.ndarray, chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each document's length-weighted mean marginal, as log odds."""
        good, _, _ = marginals(with_neighbours(found, rows) @ self.weights, rows, self.steps)
        doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        share = np.bincount(doc, good * chars, minlength=len(rows) - 1) / np.bincount(doc, chars, minlength=len(rows) - 1)
        share = np.clip(share, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, found: np.ndarray, chars: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(found, chars, rows) + self.intercept)))


def line_labels(good: np.ndarray, chars: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of lines by their marginals; in each document the lines likeliest to have its label have it until they hold ``KEEPS_LABEL`` of its characters."""
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    own = label[doc] == 1
    agree = np.where(own, good, 1 - good)
    order = np.lexsort((-agree, doc))
    before = np.concatenate([[0], np.cumsum(chars[order])])
    held = before[:-1] - before[rows[:-1]][doc]
    total = before[rows[1:]] - before[rows[:-1]]
    keeps = np.empty(len(doc), bool)
    keeps[order] = (agree[order] >= 0.5) | (held < KEEPS_LABEL * total[doc])
    return np.where(keeps, own, ~own).astype(np.float64)


def fit(found: np.ndarray, chars: np.ndarray, rows: np.ndarray, label: np.ndarray) -> Model:
    """Maximum conditional likelihood of latent line labels with a ridge, by Adam over all documents at once."""
    x = with_neighbours(found, rows).astype(np.float64)
    y = np.repeat(label, np.diff(rows)).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[rows[1:] - 1] = False
    pair = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    for turn in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[pair].astype(int), y[pair + 1].astype(int)), 1)
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, STEPS + 1):
            w, steps = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected, _ = marginals(x @ w, rows, steps)
            along = (seen - expected).ravel() if turn else np.zeros(4)
            slope = np.concatenate([x.T @ (y - good), along]) / len(x) - RIDGE * theta
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        good, _, _ = marginals(x @ theta[:-4], rows, theta[-4:].reshape(2, 2))
        y = line_labels(good, chars, rows, label)
    model = Model(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), 1.0, 0.0)
    raw = model.raw(found, chars, rows)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit, with a ridge so that separable samples stay finite
        p = 1 / (1 + np.exp(-(a * raw + b)))
        d, h = p - label, p * (1 - p) + 1e-6
        slope = np.array([(d * raw).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        curve = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.1]])
        move = np.linalg.solve(curve, slope)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    model.slope, model.intercept = float(a), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model | None:
    """The model of a bounded sample of ``labels`` whose ids are in ``docs``; None unless both classes occur."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    there = known.join(docs.select(F.col(id_column).alias("id")), "id", "left_semi")
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("found", pa.binary()), ("chars", pa.binary())])

    def work(batches):
        for batch in batches:
            for start, end in chunks(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(start, end - start)
                found, chars, rows = line_features(part.column("text"))
                ends = np.minimum(rows[1:], rows[:-1] + SAMPLE_LINES)
                cells = [(found[a:b].tobytes(), chars[a:b].tobytes()) for a, b in zip(rows[:-1].tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), part.column("label"), pa.array([x for x, _ in cells], pa.binary()), pa.array([y for _, y in cells], pa.binary())], schema=schema)

    parts = []
    for value in (0, 1):
        picked = there.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
        # of rows that share an id the one of the least hash counts, so that the bound holds however often an id repeats
        first = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))).alias("text"))
        parts.append(first.select("id", "label", "text").mapInArrow(lean(work), "id bigint, label int, found binary, chars binary"))
    rows = sorted(parts[0].unionByName(parts[1]).collect(), key=lambda r: (r["id"], r["found"]))
    label = np.array([r["label"] for r in rows], np.float64)
    if len(set(label.tolist())) < 2:
        return None
    chars = [np.frombuffer(r["chars"], np.float64) for r in rows]
    found = np.concatenate([np.frombuffer(r["found"], np.float32).reshape(-1, len(FEATURES)) for r in rows])
    return fit(found, np.concatenate(chars), np.concatenate([[0], np.cumsum([len(c) for c in chars])]), label)


def score(df: DataFrame, model: Model | None, keep: tuple[str, ...], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and score, from 0 (bad) to 1 (good)."""
    plain = df.select(F.struct(*(F.col(f"`{k}`") for k in keep)).alias("kept"), text_or_empty(text_column).alias("found_text"))

    def work(batches):
        for batch in batches:
            kept, texts = batch.column("kept"), batch.column("found_text")
            for start, end in chunks(texts, BLOCK_BYTES):
                scores = model.score(*line_features(texts.slice(start, end - start))) if model else np.full(end - start, 0.5)
                yield pa.RecordBatch.from_arrays([kept.slice(start, end - start), pa.array(scores, pa.float64())], names=["kept", "score"])

    kind = plain.schema["kept"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"kept {kind}, score double")


def trained_for(spark, docs: DataFrame, sf_dir: str) -> Model | None:
    """The model of the labelled documents that aren't held out (crc32 of the id modulo 3 is not 1)."""
    labels = table(spark, sf_dir, "labels").where(~in_group("doc_id", 3, 1))
    return train(docs, labels)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of all documents."""
    modest_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained_for(spark, docs, sf_dir), keep=("doc_id",)).select("kept.*", "score")
    return scored.select("doc_id", in_group("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
