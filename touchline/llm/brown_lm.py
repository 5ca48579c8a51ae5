"""Language-model scoring with Brown's class-based bigrams.

Words are lower-cased runs without white space, and each text closes with one
end token. All words of the training texts get a class:

1. Counting is a Spark aggregation. The ``TOP_WORDS`` most frequent words and
   the end token are exchanged between classes one by one, on the counts of
   their pairs, until the likelihood of the class bigrams stops rising.
2. Every other word gets the class that most raises the likelihood of the
   word's own neighbours (``assigned``): all its occurrences are gathered with
   the classes of the tokens before and after, one row a word and block.

A text then becomes the sequence of its tokens' classes (``outline``). The
``BROADCAST_WORDS`` most frequent words carry counts and classes to every task,
a table of fixed bounds; the distinct rarer words of each text go through one
shuffle by word to meet theirs, and come back to the text. Transitions are
counted over all training sequences. A token's probability is that of its
class after the class before it, times that of the word in its class, both
smoothed. No word is cut off.

Nulls: a null text is the empty text, that is one end token. An id may be null
or repeated: each row is scored by itself, equal texts alike. Words that
training never saw go to the class with most words and have the share that each
class keeps for them. Words of equal count are ordered by their bytes, classes
of equal gain by number. Without training rows all counts are zero and scores
come from smoothing alone. Very long texts and words are counted whole. Other
columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_group, lean, modest_batches, split_words, stored, string_buffers, table, text_or_empty

#: Words that the exchange moves one by one, and classes.
TOP_WORDS, CLASSES = 2000, 48
EXCHANGE_ROUNDS = 6
#: Words whose counts and classes every task gets.
BROADCAST_WORDS = 200_000
SMOOTHING = 0.5
BLOCK_BYTES = 4 << 20
#: The unit of the end token, units in all, and what stands for a class that isn't known.
END_UNIT = TOP_WORDS
UNITS = TOP_WORDS + 1
UNKNOWN = 255


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of rows (text); words as binary, summed in each block before the shuffle."""

    def work(batches):
        for batch in batches:
            texts = batch.column(0)
            for start, end in chunks(texts, BLOCK_BYTES):
                words, _ = split_words(texts.slice(start, end - start), lower=True)
                counted = words.value_counts()
                yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.binary()), counted.field("counts")], names=["word", "n"])

    return docs.select("text").mapInArrow(lean(work), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Words with their counts, most frequent first: all that occur ``least`` times."""

    words: pa.Array
    counts: np.ndarray
    least: int

    def places(self, found: pa.Array) -> np.ndarray:
        """The place of each distinct word among these, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(found, self.words), -1)).astype(np.int64)


def most_frequent(counts: DataFrame, most: int) -> Lexicon:
    """The words above the least count that no more than ``most`` words reach."""
    least = most_frequent_count(counts, most)
    found = counts.where(F.col("n") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Lexicon(found.column("word").combine_chunks().cast(pa.large_binary()), found.column("n").to_numpy().astype(np.int64), least)


def _tokens(texts: pa.Array, lexicon: Lexicon) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, their places in the lexicon, and of all tokens with the end tokens: the distinct word (-1: the end) and the offsets by text."""
    words, rows = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    token = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows[1:], -1)
    return coded.dictionary, lexicon.places(coded.dictionary), token, rows + np.arange(len(rows))


def _before(values: np.ndarray, end) -> np.ndarray:
    """What stands before each token; a text begins after an end token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[:1] = end
    return out


def unit_bigrams(docs: DataFrame, top: Lexicon) -> DataFrame:
    """(pair, n): counts of pairs of units over the texts of rows (text), pair = before * UNITS + unit; a table of fixed bounds. Pairs with other words aren't units' pairs."""

    def work(batches):
        held = np.zeros(UNITS * UNITS, np.int32)
        for batch in batches:
            texts = batch.column(0)
            for start, end in chunks(texts, BLOCK_BYTES):
                _, place, token, _ = _tokens(texts.slice(start, end - start), top)
                unit = np.append(place, END_UNIT)[token]
                before = _before(unit, END_UNIT)
                held += np.bincount((before * UNITS + unit)[(unit >= 0) & (before >= 0)], minlength=UNITS * UNITS).astype(np.int32)
        pairs = np.flatnonzero(held)
        for start in range(0, len(pairs), 100_000):
            part = pairs[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(held[part], pa.int64())], names=["pair", "n"])

    return docs.select("text").mapInArrow(lean(work), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGE_ROUNDS) -> np.ndarray:
    """Class of each unit: units move, one by one in order of frequency, to the class that most raises the class bigrams' likelihood, until none moves or the rounds end."""

    def f(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    units = len(bigrams)
    counts = bigrams.astype(np.float64)
    freq = counts.sum(axis=0)
    order = np.argsort(-freq, kind="stable")
    classes = min(classes, units)
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    right, left = counts @ member, counts.T @ member  # by unit: counts to and from each class
    table_ = member.T @ right
    sizes = member.T @ freq
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            if not freq[u]:
                continue
            own = of[u]
            r, l, self_ = right[u].copy(), left[u].copy(), counts[u, u]
            r[own] -= self_
            l[own] -= self_  # counts with other units only
            table_[own] -= r
            table_[:, own] -= l
            table_[own, own] -= self_
            sizes[own] -= freq[u]
            rows = (f(table_ + r[None, :]) - f(table_)).sum(axis=1)
            cols = (f(table_ + l[:, None]) - f(table_)).sum(axis=0)
            at = np.diagonal(table_)
            # the diagonal cell gets both and the unit's own pairs
            both = f(at + r + l + self_) - f(at) - (f(at + r) - f(at)) - (f(at + l) - f(at))
            gain = rows + cols + both - 2 * (f(sizes + freq[u]) - f(sizes))
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            table_[best] += r
            table_[:, best] += l
            table_[best, best] += self_
            sizes[best] += freq[u]
            if best != own:
                moved += 1
                of[u] = best
                right[:, own] -= counts[:, u]
                right[:, best] += counts[:, u]
                left[:, own] -= counts[u]
                left[:, best] += counts[u]
        if not moved:
            break
    return of


def contexts(docs: DataFrame, top: Lexicon, class_of: np.ndarray) -> DataFrame:
    """(word, around) of all words but the top ones: around holds, for each occurrence in a block, the class of the token before and of that after (UNKNOWN for other words)."""
    shared = docs.sparkSession.sparkContext.broadcast((top, class_of.astype(np.uint8)))

    def work(batches):
        top, class_of = shared.value
        end_class = class_of[END_UNIT]
        for batch in batches:
            texts = batch.column(0)
            for start, end in chunks(texts, BLOCK_BYTES):
                words, place, token, _ = _tokens(texts.slice(start, end - start), top)
                kind = np.append(np.where(place >= 0, class_of[np.maximum(place, 0)], UNKNOWN), end_class).astype(np.uint8)[token]
                at = np.flatnonzero(np.append(place, 0)[token] < 0)
                at = at[np.argsort(token[at], kind="stable")]
                around = np.stack([_before(kind, end_class)[at], kind[at + 1]], axis=1)
                which, first = np.unique(token[at], return_index=True)
                cells = pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(2 * np.append(first, len(at)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(around))])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(which)).cast(pa.binary()), cells.cast(pa.binary())], names=["word", "around"])

    return docs.select("text").mapInArrow(lean(work), "word binary, around binary")


def gains(by_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a token before of class c, and one after of class c, adds to the log likelihood of a word in class k ([c, k] each), and a class's weight where neither is known."""
    n, s = by_class.sum(), SMOOTHING
    size = (by_class.sum(axis=0) + by_class.sum(axis=1)) / 2 + s * CLASSES
    after_c = np.log((by_class + s) / size[None, :])
    return after_c, np.log((by_class.T + s) / size[None, :]), 1e-9 * size / max(n, 1)


def best_classes(left: np.ndarray, right: np.ndarray, by_class: np.ndarray) -> np.ndarray:
    """The class of each word that most raises the likelihood, from the counts (words, CLASSES) of the classes before and after it."""
    before, after, weight = gains(by_class)
    return (left @ before + right @ after + weight).argmax(axis=1)


def assigned(around: DataFrame, by_class: np.ndarray) -> DataFrame:
    """(word, n, class) of each word of ``contexts``. Words come in order, so a task holds the counts of a batch of words at a time."""

    def work(batches):
        kinds = UNKNOWN + 1

        def emitted(words, table):
            left, right = table[:, 0, :CLASSES], table[:, 1, :CLASSES]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(table[:, 0].sum(axis=1), pa.int64()), pa.array(best_classes(left, right, by_class), pa.int32())], names=["word", "n", "class"])

        held_word, held = None, None
        for batch in batches:
            words = batch.column("word")
            for start in range(0, len(words), 4000):
                part = batch.slice(start, 4000)
                names = part.column("word")
                new = np.ones(len(names), bool)
                new[1:] = np.asarray(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)))
                first = np.flatnonzero(new)
                data, offsets = string_buffers(part.column("around"))
                owner = np.repeat(np.cumsum(new) - 1, np.diff(offsets) // 2)
                pairs = data.reshape(-1, 2).astype(np.int64)
                table = np.stack([np.bincount(owner * kinds + pairs[:, i], minlength=len(first) * kinds).reshape(-1, kinds) for i in (0, 1)], axis=1)
                distinct = names.take(pa.array(first)).to_pylist()
                if held_word == distinct[0]:
                    table[0] += held
                elif held_word is not None:
                    yield emitted([held_word], held[None])
                if len(distinct) > 1:
                    yield emitted(distinct[:-1], table[:-1])
                held_word, held = distinct[-1], table[-1]
        if held_word is not None:
            yield emitted([held_word], held[None])

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(lean(work), "word binary, n bigint, class int")


@dataclass
class Model:
    """What scoring needs, of fixed bounds; the classes of rarer words are a table."""

    lexicon: Lexicon
    class_of: np.ndarray
    end_class: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    vocabulary: int
    ends: int
    transition: np.ndarray | None = None

    @property
    def unseen_class(self) -> int:
        return int(self.class_words.argmax())

    @property
    def shares(self) -> np.ndarray:
        """log10 of what a class's words divide among them; each class keeps one share for words never seen."""
        return np.log10(self.class_tokens + SMOOTHING * (self.class_words + 1))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.vocabulary + 1)))


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of rows (text) but for its transitions, and (word, n, class) of the words beyond its lexicon."""
    modest_batches(docs.sparkSession)
    counts = stored(word_counts(docs))
    n_docs = docs.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    top = most_frequent(counts, TOP_WORDS)
    pairs = unit_bigrams(docs, top).toArrow()
    bigrams = np.zeros(UNITS * UNITS, np.int64)
    bigrams[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    bigrams = bigrams.reshape(UNITS, UNITS)
    unit_class = exchange(bigrams)
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), unit_class] = 1
    classes = stored(assigned(contexts(docs, top, unit_class), member.T @ bigrams @ member))

    sizes = {r["class"]: (r["n"], r["words"]) for r in classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, m) in sizes.items():
        tokens[k], words[k] = n, m
    own = unit_class[: len(top.words)]
    np.add.at(tokens, own, top.counts)
    np.add.at(words, own, 1)
    tokens[unit_class[END_UNIT]] += n_docs
    words[unit_class[END_UNIT]] += n_docs > 0

    least = most_frequent_count(classes, BROADCAST_WORDS - len(top.words))
    near = classes.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    lexicon = Lexicon(pa.concat_arrays([top.words, near.column("word").combine_chunks().cast(pa.large_binary())]), np.concatenate([top.counts, near.column("n").to_numpy().astype(np.int64)]), least)
    class_of = np.concatenate([own, near.column("class").to_numpy().astype(np.int64)])
    model = Model(lexicon, class_of, int(unit_class[END_UNIT]), tokens, words, int(total[0]) + n_docs, int(total[1]) + (n_docs > 0), n_docs)
    return model, classes.where(F.col("n") < least)


def most_frequent_count(counts: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` words reach."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    n, reached = by_count.column("n").to_numpy(), np.cumsum(by_count.column("words").to_numpy())
    fits = reached <= most
    return int(n[fits].min()) if fits.any() else int(n.max()) + 1 if len(n) else 1


def outline(docs: DataFrame, model: Model, rarer: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept, n_tokens, n_known, base_score, words_score, classes) of each row of ``docs`` (with text).

    words_score: the sum of log10 of the tokens' smoothed counts; classes: the
    sequence of the tokens' classes, a byte each. A task fills in what its own
    lexicon covers, and sends on one row for each text and one for each rarer
    word of a text. Rows of texts have a key that no word can have, so that
    both pass the join with the rarer words.
    """
    plain = docs.select(F.struct(*(F.col(f"`{k}`") for k in keep)).alias("kept"), F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole_type = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("words", pa.float64()), ("classes", pa.binary()), ("rare", pa.binary())])
    names = ["row", "word", "k", "n", "kept", "whole"]

    def cells(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    def work(batches):
        from pyspark import TaskContext

        m: Model = shared.value
        next_row = TaskContext.get().partitionId() << 36
        for batch in batches:
            kept, texts = batch.column("kept"), batch.column("text")
            for start, end in chunks(texts, BLOCK_BYTES):
                n = end - start
                words, place, token, rows = _tokens(texts.slice(start, n), m.lexicon)
                own = place >= 0
                count = np.where(own, m.lexicon.counts[np.maximum(place, 0)], 0) if len(m.lexicon.counts) else np.zeros(len(place), np.int64)
                kind = np.where(own, m.class_of[np.maximum(place, 0)], UNKNOWN) if len(m.class_of) else np.full(len(place), UNKNOWN)
                count, kind, own = np.append(count, m.ends), np.append(kind, m.end_class).astype(np.uint8), np.append(own, True)
                doc = np.repeat(np.arange(n), np.diff(rows))

                def by_doc(values):
                    return np.bincount(doc, values[token], minlength=n)

                at = np.flatnonzero(~own[token])
                pair, back, times = np.unique(doc[at] * np.int64(len(count)) + token[at], return_inverse=True, return_counts=True)
                in_doc, which = pair // len(count), pair % len(count)
                first = np.searchsorted(in_doc, np.arange(n + 1))
                k = np.arange(len(pair)) - first[in_doc]
                rare_rows = np.searchsorted(doc[at], np.arange(n + 1))
                row = next_row + np.arange(n)
                next_row += n
                known = by_doc((own & (count > 0)).astype(float)).astype(np.int64)
                whole = pa.StructArray.from_arrays([pa.array(np.diff(rows)), pa.array(known), pa.array(by_doc(np.where(own, m.base(count), 0.0))), pa.array(by_doc(np.where(own, np.log10(count + SMOOTHING), 0.0))), cells(kind[token], rows), cells(k[back].astype("<u4"), rare_rows)], fields=list(whole_type))
                keys = pa.array([b" " + int(x).to_bytes(8, "big") for x in row], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row), keys, pa.nulls(n, pa.int32()), pa.array(np.zeros(n, np.int64)), kept.slice(start, n), whole], names=names)
                yield pa.RecordBatch.from_arrays([pa.array(row[in_doc]), words.take(pa.array(which)).cast(pa.binary()), pa.array(k, pa.int32()), pa.array(times, pa.int64()), pa.nulls(len(pair), kept.type), pa.nulls(len(pair), whole_type)], names=names)

    kind = plain.schema["kept"].dataType.simpleString()
    parts = plain.mapInArrow(lean(work), f"row bigint, word binary, k int, n bigint, kept {kind}, whole struct<n_tokens:bigint,n_known:bigint,base:double,words:double,classes:binary,rare:binary>")
    met = parts.join(rarer.select("word", F.col("n").alias("c"), "class"), "word", "left")
    found = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(model.unseen_class)).alias("class")))).alias("found")
    told = met.groupBy("row").agg(F.max("kept").alias("kept"), F.first("whole", ignorenulls=True).alias("whole"), found).select("kept", "whole.*", "found")

    def fill(batches):
        m: Model = shared.value
        for batch in batches:
            n = batch.num_rows
            lists = batch.column("found")
            ends = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(ends[0], ends[-1] - ends[0])
            ends = ends - ends[0]
            k, times, c, group = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("k", "n", "c", "class"))
            doc = np.repeat(np.arange(n), np.diff(ends))
            of = np.empty(len(k), np.uint8)
            of[ends[doc] + k] = group

            def by_doc(values):
                return np.bincount(doc, values, minlength=n)

            data, rows = string_buffers(batch.column("classes"))
            rare, rare_rows = string_buffers(batch.column("rare"))
            index = np.ascontiguousarray(rare).view("<u4").astype(np.int64) + np.repeat(ends[:-1], np.diff(rare_rows) // 4)
            classes = data.copy()
            classes[data == UNKNOWN] = of[index]
            yield pa.RecordBatch.from_arrays([
                batch.column("kept"), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy() + by_doc(np.where(c > 0, times, 0)).astype(np.int64)),
                pa.array(batch.column("base").to_numpy() + by_doc(times * m.base(c))), pa.array(batch.column("words").to_numpy() + by_doc(times * np.log10(c + SMOOTHING))), cells(classes, rows),
            ], names=["kept", "n_tokens", "n_known", "base_score", "words_score", "classes"])

    return told.mapInArrow(lean(fill), f"kept {kind}, n_tokens bigint, n_known bigint, base_score double, words_score double, classes binary")


def transitions(outlined: DataFrame, model: Model) -> np.ndarray:
    """log10 probabilities [before, class] from the sequences of training texts."""
    end_class = model.end_class

    def work(batches):
        held = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            data, _ = string_buffers(batch.column(0))
            kind = data.astype(np.int64)
            held += np.bincount(_before(kind, end_class) * CLASSES + kind, minlength=CLASSES * CLASSES)
        pairs = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(held[pairs])], names=["pair", "n"])

    counts = np.zeros(CLASSES * CLASSES)
    for r in outlined.select("classes").mapInArrow(lean(work), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    counts = counts.reshape(CLASSES, CLASSES)
    return np.log10((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CLASSES))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of rows (text), and (word, n, class) of the words beyond its lexicon."""
    model, rarer = learn(docs)
    model.transition = transitions(outline(docs, model, rarer, keep=("text",)), model)
    return model, rarer


def priced(outlined: DataFrame, model: Model) -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score and score (log10) of the rows of ``outline``."""
    kind, end_class, transition, shares = outlined.schema["kept"].dataType.simpleString(), model.end_class, model.transition, model.shares

    def work(batches):
        for batch in batches:
            data, rows = string_buffers(batch.column("classes"))
            each = transition[_before(data, end_class), data] - shares[data]
            total = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(rows)), each, minlength=batch.num_rows) + batch.column("words_score").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("kept", "n_tokens", "n_known", "base_score")] + [pa.array(total)], names=["kept", "n_tokens", "n_known", "base_score", "score"])

    return outlined.mapInArrow(lean(work), f"kept {kind}, n_tokens bigint, n_known bigint, base_score double, score double").select("kept.*", "n_tokens", "n_known", "base_score", "score")


def score(docs: DataFrame, model: Model, rarer: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_tokens, n_known, base_score and score (log10) of each row of ``docs`` (with text)."""
    return priced(outline(docs, model, rarer, keep), model)


def perplexity(score: str = "score", tokens: str = "n_tokens"):
    """Column: 10 to the negative mean log10 probability."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col(tokens))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: scores of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"), in_group("doc_id", 7, 2).alias("held_out"))
    model, rarer = learn(docs.where(~F.col("held_out")))
    outlined = stored(outline(docs, model, rarer, keep=("doc_id", "held_out")))
    model.transition = transitions(outlined.where(~F.col("kept.held_out")), model)
    scored = priced(outlined, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity().alias("perplexity"))
