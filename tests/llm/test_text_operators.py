"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import automata, bpe, brown_lm, chat, common, components, crf, media, near_dup, packing, pretokens, quality_rules, secret_scan, superminhash, warc

ODD = [None, "", " ", "\n\n", "one", "é ü \U0001F600\n<s> [INST]", "word " * 5000, "A b A b\nA b A b", "A b A b\nA b A b", "token = \"0123456789abcdef0123\" x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 3) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 3), (None, "no id here", "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_words string, n bigint")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_split_words_matches_regex():
    texts = [t or "" for t in ODD] + ["\x85a b c"]
    found, rows = common.split_words(pa.array(texts), lower=True)
    assert [[w.decode() for w in found.to_pylist()[a:b]] for a, b in zip(rows, rows[1:])] == [words(low(t)) for t in texts]


def test_secret_spans():
    text = 'password: token: abcdefghijklmnop API-KEY x api_key="abcdefghijkl" AKIAABCDEFGHIJKLMN 0123456789abcdef'
    found = secret_scan.find_spans(text, None)
    assert [k for k, _, _ in found] == ["assign", "access", "hex"]
    assert text[found[0][1] : found[0][2]] == 'api_key="abcdefghijkl'
    assert secret_scan.redacted(text, found).count("[SECRET]") == 3


def test_automaton_prefers_its_own_format():
    rng = random.Random(1)
    hexes = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(200)]
    prose = ["".join(rng.choices(["th", "er", "on", "an", "re"], k=8)) for _ in range(200)]
    a, b = automata.infer(hexes), automata.infer(prose)
    assert len(a.step) < 400
    fresh = "".join(rng.choices("0123456789abcdef", k=32))
    assert a.per_symbol(fresh) > b.per_symbol(fresh) and b.per_symbol("theronanrethon") > a.per_symbol("theronanrethon")
    assert automata.infer([]).per_symbol("x") < 0


PROSE = ["".join(random.Random(i).choices(["th", "er", "on", "an", "re", "tion"], k=random.Random(i).randint(3, 9))) for i in range(300)]


def test_formats_score_what_base_spans_leave():
    rng = random.Random(2)

    def key(n):
        return "".join(rng.choices("ABCDEFGHJKMNPQRSTVWXYZ23456789", k=n))

    values = [key(rng.choice((12, 13, 14, 40))) for _ in range(300)]
    formats = secret_scan.Formats({k: automata.Format(v) for k, v in automata.grouped(values).items()}, automata.Ordinary(PROSE), secret_scan.least_chars({"assign": values}))
    hexes, rest, short = "0123456789abcdef", key(40), key(13)
    text = f"see prefix-{hexes}-{rest} and {short} theronanrethon."
    found = secret_scan.find_spans(text, formats)
    assert formats.least == 12 and [k for k, _, _ in found if k != "format"] == ["hex"]
    clean = secret_scan.redacted(text, found)
    assert rest not in clean and short not in clean and "theronanrethon" in clean
    covered = f"token={rest}"
    assert [(k, covered[s:e]) for k, s, e in secret_scan.find_spans(covered, formats)] == [("assign", covered), ("format", rest)]


def test_automata_find_planted_credentials_without_a_pattern(spark):
    rng = random.Random(11)

    def made(alphabet, n):
        return "".join(rng.choices(alphabet, k=n))

    known = [f"say token = \"{made('0123456789abcdef', 40)}\" {PROSE[i]} {PROSE[-i]}" for i in range(200)]
    formats = secret_scan.learn_formats(spark.createDataFrame([(x,) for x in known], "text string"))
    assert len(formats.learnt) > 10 and all(len(f.automaton.step) > 10 for f in formats.learnt.values())
    for name in secret_scan.PUBLIC_FORMATS:
        for value in secret_scan.public_examples(name, 130)[90:]:  # not among the learnt ones
            text = f"{PROSE[3]} {PROSE[4]} ({value}), {PROSE[5]}."
            spans = secret_scan.find_spans(text, formats)
            assert ("format", text.index(value), text.index(value) + len(value)) in spans, (name, value)
    words = [w for w in PROSE] + ["antidisestablishmentarianism", "Rindfleischetikettierungsgesetz", "2024-11-28T05:50:40", "192.168.100.200", "www.example.org/path/to/page.html", "e-mail-address_of_user", "state-of-the-art.And", "+33612345678"]
    assert not any(secret_scan.find_spans(w, formats) for w in words)


def test_automata_keep_classes_by_place():
    rng = random.Random(5)

    def block(pattern):
        return "".join(rng.choice({"d": "0123456789", "u": "GHJKLMNPQRSTUVWXYZ", "l": "ghjkmnpqrstuvwxyz"}[c]) for c in pattern)

    one = automata.Format([block("ddddddddlllllllluuuu") for _ in range(160)])
    assert len({s for moves in one.automaton.step for s in moves}) == 3 and len(one.automaton.step) == 21
    fits = one.fits
    assert all(fits(block("ddddddddlllllllluuuu")) for _ in range(50))
    # the same characters and lengths in other places, and other lengths
    for other in ("lllllllldddddddduuuu", "uuuulllllllldddddddd", "dldldldldldldldluuuu", "dddddddd", "ddddddddlllllllluuuuuuuuuuuu"):
        assert not any(fits(block(other)) for _ in range(50)), other
    # probabilities of what may follow a state, its end included, add up to no more than one
    for moves, end in zip(one.automaton.step, one.automaton.end):
        assert sum(math.exp(p) for _, p in moves.values()) + math.exp(end) <= 1 + 1e-9
    assert automata.infer_by_place([]).per_symbol("x") < 0 and automata.infer_by_place(["", ""]).log_likelihood("") > math.log(0.5)


def test_automata_tell_two_layouts_apart_in_one_sample():
    rng = random.Random(6)
    made = lambda alphabets: "".join(rng.choice(a) for a in alphabets)
    d, u = "0123456789", "GHJKLMNPQRSTUVWXYZ"
    layouts = [[d] * 10 + [u] * 10, [u] * 10 + [d] * 10]
    found = automata.infer_by_place([made(layout) for layout in layouts for _ in range(100)])
    own = [found.per_symbol(made(layout)) for layout in layouts]
    assert min(own) > found.per_symbol(made([d] * 20)) + 1 and min(own) > found.per_symbol(made([d, u] * 10)) + 1


#: Shares below those measured (1.0, 0.70, 0.94, 0.96, 1.0, 1.0, 0.48): a format of unusual length is found only in part.
LEFT_OUT = [("github", 0.95), ("gitlab", 0.65), ("stripe", 0.9), ("google", 0.95), ("npm", 0.95), ("cloud secret", 0.95), ("padded key", 0.4)]


@pytest.mark.parametrize("name, least", LEFT_OUT)
def test_formats_left_out_of_training_are_found(name, least):
    rest = {n: automata.Format(secret_scan.public_examples(n)) for n in secret_scan.PUBLIC_FORMATS if n != name}
    formats = secret_scan.Formats(rest, automata.Ordinary(PROSE))
    values = secret_scan.public_examples(name)
    assert sum(formats.score(v) >= secret_scan.MARGIN for v in values) >= least * len(values)


def test_base_spans_match_the_patterns():
    rng = random.Random(12)
    parts = ["token", "API-KEY", "api_key", "Secret", "passwd", "PASSWORD", "=", ":", " = ", '"', "'", " ", "\n", "AKIA", "akia", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choices(rng.choice(["0123456789abcdef", "ABCDEFGHIJK0123", "xyz+/_.=-"]), k=rng.randint(1, 22))) for _ in range(rng.randint(1, 9)))
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII) if len(m[1]) >= 12]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert secret_scan.find_spans(text, None) == sorted(want, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_scan_and_redact(spark, docs, empty):
    formats = secret_scan.learn_formats(docs)
    assert {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(docs, formats).collect()}[9] == 2
    clean = secret_scan.redact(docs, formats)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.where("doc_id = 9").head()["text"] == '[SECRET]" x' and clean.where("doc_id = 0").head()["text"] is None
    assert secret_scan.learn_formats(empty) is None and secret_scan.scan(empty, None).count() == 0


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_round_trip(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (7, 64)).astype(np.uint8)
    lines = np.empty_like(image)
    for i, row in enumerate(image):
        up, left, corner = image[i - 1] if i else np.zeros(64, np.uint8), np.r_[np.uint8(0), row[:-1]], np.zeros(64, np.uint8)
        if i:
            corner[1:] = image[i - 1][:-1]
        a, b, c = (v.astype(int) for v in (left, up, corner))
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        lines[i] = row - [0 * a, a, b, (a + b) // 2, near][kind].astype(np.uint8)
    assert (media.unfilter(np.full(7, kind, np.uint8), lines) == image).all()


def test_media_round_trip(docs, empty):
    stored = media.encode_png(docs)
    read = media.decode_png(stored, keep=("doc_id", "n_bytes")).collect()
    for r in read:
        if r["doc_id"] is not None:
            assert bytes(r["samples"]) == media.pad((ODD[r["doc_id"]] or "").encode()) and r["error"] is None and len(r["feature"]) == 8
    data = bytearray(media.write_png(media.pad(b"abc")))
    data[40] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(data))
    assert media.encode_png(empty).count() == 0


def test_crf_learns_junk_lines(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "of", "reading", "and", "letter"], k=12)) + "." for _ in range(80)]
    junk = [" | ".join(rng.choices(["BUY", "$$$", "###", "NOW!!"], k=12)) for _ in range(80)]
    rows = [(i, "\n".join([t] * 1 + [t[::1]]), i % 2) for i, t in enumerate(x for pair in zip(junk, good) for x in pair)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    model = crf.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in crf.score(docs, model, ("doc_id",)).select("kept.doc_id", "score").collect()}
    assert all((found[i] >= 0.5) == bool(q) for i, _, q in rows)
    assert crf.train(docs, labels.where("quality = 1")) is None


def test_crf_labels_lines_of_mixed_documents():
    rng = random.Random(3)

    def line(good):
        return " ".join(rng.choices(["the", "of", "reading", "and", "letter"], k=12)) + "." if good else " | ".join(rng.choices(["BUY", "$$$", "###", "NOW!!"], k=12))

    kinds, label = [], []
    for i in range(160):  # runs of the other kind within documents of a kind
        own = i % 2
        run = rng.randint(1, 3)
        at = rng.randint(1, 5)
        kinds.append([own] * at + [1 - own] * run + [own] * (8 - at))
        label.append(own)
    texts = ["\n".join(line(k) for k in doc) for doc in kinds]
    found, chars, rows = crf.line_features(pa.array(texts))
    model = crf.fit(found, chars, rows, np.array(label, float))
    good, _, _ = crf.marginals(crf.with_neighbours(found, rows) @ model.weights, rows, model.steps)
    want = np.concatenate(kinds)
    assert ((good >= 0.5) == want).mean() > 0.95
    score = model.score(found, chars, rows)
    assert ((score >= 0.5) == np.array(label)).mean() > 0.95


def test_crf_line_labels_keep_most_of_a_document():
    good, chars, rows = np.array([0.1, 0.2, 0.9, 0.3]), np.array([10.0, 10.0, 5.0, 100.0]), np.array([0, 3, 4])
    assert crf.line_labels(good, chars, rows, np.array([1.0, 1.0])).tolist() == [1, 1, 1, 1]
    assert crf.line_labels(good, chars, rows, np.array([0.0, 0.0])).tolist() == [0, 0, 1, 0]


def test_crf_ties_and_long_texts(spark):
    rows = [(i, ("| $$$ ###\n" if i % 2 else "plain words of a letter.\n") * (30_000 if i < 2 else 3)) for i in range(12)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in (*range(12), 99)], "doc_id bigint, quality int")
    model = crf.train(frame, labels)
    found = crf.score(frame, model, ("doc_id",)).groupBy("kept.doc_id").agg(F.min("score").alias("a"), F.max("score").alias("b")).collect()
    assert all(r["a"] == r["b"] and (r["a"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in found)


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    gain, steps, rows = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    found, expected, total = crf.marginals(gain, rows, steps)
    for a, b in zip(rows, rows[1:]):
        scores = {}
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            scores[code] = sum(gain[a + k] * y[k] for k in range(b - a)) + sum(steps[y[k], y[k + 1]] for k in range(b - a - 1))
        z = np.logaddexp.reduce(list(scores.values()))
        for k in range(b - a):
            assert np.isclose(found[a + k], sum(np.exp(s - z) for c, s in scores.items() if c >> k & 1))
    assert np.isclose(expected.sum(), 4)


def test_crf_scores_odd_rows(docs, empty):
    scored = crf.score(docs, None, tuple(docs.columns))
    assert scored.count() == docs.count() and {r["score"] for r in scored.collect()} == {0.5}
    found, chars, rows = crf.line_features(pa.array([t or "" for t in ODD]))
    assert len(rows) == len(ODD) + 1 and (np.diff(rows) >= 1).all() and np.isfinite(found).all()
    assert crf.score(empty, None, ("doc_id",)).count() == 0


def brute_class_scores(texts, training, class_of):
    """Scores by the definition, from texts (lists of words), which of them train, and each training word's class; None is the end token."""
    seen = collections.Counter(w for t, own in zip(texts, training) if own for w in [*t, None])
    tokens, members, pairs = collections.Counter(), collections.Counter(), collections.Counter()
    for w, n in seen.items():
        tokens[class_of[w]] += n
        members[class_of[w]] += 1
    unseen = max(range(brown_lm.CLASSES), key=lambda k: (members[k], -k))
    kinds = [[class_of.get(w, unseen) for w in [*t, None]] for t in texts]
    for t, own in zip(kinds, training):
        if own:
            pairs.update(zip([class_of[None], *t], t))
    row = collections.Counter()
    for (a, _), n in pairs.items():
        row[a] += n
    s, out = brown_lm.SMOOTHING, []
    for t, ks in zip(texts, kinds):
        total = 0.0
        for w, before, k in zip([*t, None], [class_of[None], *ks], ks):
            total += np.log10((pairs[before, k] + s) / (row[before] + s * brown_lm.CLASSES)) + np.log10((seen[w] + s) / (tokens[k] + s * (members[k] + 1)))
        out.append(total)
    return out


@pytest.mark.parametrize("broadcast", [200_000, 40])
def test_language_model_against_counting(spark, docs, empty, monkeypatch, broadcast):
    monkeypatch.setattr(brown_lm, "BROADCAST_WORDS", broadcast)
    monkeypatch.setattr(brown_lm, "TOP_WORDS", 30)
    monkeypatch.setattr(brown_lm, "END_UNIT", 30)
    monkeypatch.setattr(brown_lm, "UNITS", 31)
    rng = random.Random(5)
    made = [(100 + i, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randint(1, 60)))) for i in range(40)]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string")).select("doc_id", common.text_or_empty("text").alias("text"), common.in_group("doc_id", 7, 2).alias("held"))
    model, rarer = brown_lm.learn(texts.where("not held"))
    outlined = common.stored(brown_lm.outline(texts, model, rarer, keep=("doc_id", "held", "text")))
    model.transition = brown_lm.transitions(outlined.where("not kept.held"), model)
    scored = brown_lm.priced(outlined, model).collect()
    class_of = {None: model.end_class} | dict(zip((w.decode() for w in model.lexicon.words.to_pylist()), model.class_of.tolist())) | {bytes(r["word"]).decode(): r["class"] for r in rarer.collect()}
    lists, training = [words(low(r["text"])) for r in scored], [not r["held"] for r in scored]
    assert len(scored) == texts.count() and (broadcast > 40) == (rarer.count() == 0)
    seen = collections.Counter(w for t, own in zip(lists, training) if own for w in [*t, None])
    assert set(class_of) == set(seen)
    n, v = sum(seen.values()), len(seen)
    want = brute_class_scores(lists, training, class_of)
    for r, t, total in zip(scored, lists, want):
        assert (r["n_tokens"], r["n_known"]) == (len(t) + 1, sum(seen[w] > 0 for w in [*t, None]))
        assert np.isclose(r["base_score"], sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in [*t, None])) and np.isclose(r["score"], total)
    assert model.tokens == n
    nothing, none = brown_lm.train(empty.select("text"))
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in brown_lm.score(texts, nothing, none).collect())


def test_rare_words_get_the_class_of_their_company(spark):
    rng, texts = random.Random(7), []
    firsts, seconds = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    for i in range(400):
        text = [x for _ in range(10) for x in (rng.choice(firsts), rng.choice(seconds))]
        if i < 40:
            text[2 * (i % 10)], text[2 * (i % 10) + 1] = f"rare_a{i}", text[2 * (i % 10) + 1]
        texts.append(("x", " ".join(text)))
    frame = spark.createDataFrame(texts, "doc_id string, text string")
    top = brown_lm.Lexicon(pa.array([w.encode() for w in firsts + seconds], pa.large_binary()), np.ones(12, np.int64), 1)
    class_of = np.full(brown_lm.UNITS, 7)
    class_of[:12] = [1] * 6 + [2] * 6
    by_class = np.zeros((brown_lm.CLASSES, brown_lm.CLASSES))
    by_class[1, 2], by_class[2, 1], by_class[2, 7], by_class[7, 1] = 4000, 3600, 400, 400
    found = {bytes(r["word"]).decode(): (r["n"], r["class"]) for r in brown_lm.assigned(brown_lm.contexts(frame, top, class_of), by_class).collect()}
    assert found == {f"rare_a{i}": (1, 1) for i in range(40)}


def test_exchange_separates_alternating_words():
    table = np.zeros((6, 6), np.int64)
    for a in (0, 1, 2):
        for b in (3, 4, 5):
            table[a, b] = table[b, a] = 10
    of = brown_lm.exchange(table, classes=2)
    assert len(set(of[:3])) == 1 and len(set(of[3:])) == 1 and of[0] != of[3]


def test_pretokens_match_pattern():
    import public_tokenizers
    import regex

    rng = random.Random(3)
    alphabet = " '  \n\t\r 　abcstrevmldSTé漢1٢３.,!#'\"\U0001F600'’ſ"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(20000)]
    found, rows = pretokens.split(pa.array(texts))
    flat = found.to_pylist()
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert all([x.encode() for x in pattern.findall(t)] == flat[rows[i] : rows[i + 1]] for i, t in enumerate(texts))


def test_bpe_round_trip(docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.encode(docs, path, keep=("doc_id", "text"))
    decoded = bpe.decode(encoded, path, keep=("text", "ids")).collect()
    assert len(decoded) == docs.count()
    for r in decoded:
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty, path).count() == 0


def test_bpe_of_long_words_matches_tiktoken():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(path), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=20_000)), "".join(rng.choices(letters, k=200_000)), "a" * 20_001, "=" * 5003, "ab" * 4000, "é漢" * 700, "the" * 900 + "ing" * 700]
    words += ["".join(rng.choices(rng.choice(["ab", "abc", "aeiounst", letters]), k=rng.randint(100, 700))) for _ in range(150)]
    ids, rows = codec.encode(pa.array(words))
    for i, w in enumerate(words):
        assert ids[rows[i] : rows[i + 1]].tolist() == own.encode_ordinary(w), w[:50]


def test_packing_covers_every_id(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    unique = docs.where("doc_id <> 3 or doc_id is null")
    pieces = packing.pack(common.stored(packing.tokenize(unique, path)), 2, window=64, kind="<u2").toPandas()
    by_sequence = pieces.groupby("sequence_id")
    for _, g in by_sequence:
        g = g.sort_values("offset")
        assert (g["offset"] == np.r_[0, g["length"].cumsum()[:-1]]).all()
        total = int(g["length"].sum())
        assert total <= 64 and total & (total - 1) == 0
    for r in unique.collect():
        mine = pieces[pieces["doc_id"].isna() if r["doc_id"] is None else pieces["doc_id"] == r["doc_id"]].sort_values("start")
        ids = np.frombuffer(b"".join(mine["ids"]), "<u4").tolist()
        assert ids == [*own.encode(r["text"] or "", add_special_tokens=False).ids, 1] and (mine["doc_tokens"] == len(ids)).all()
    assert packing.shards_for(empty) == 1 and packing.packed(empty).count() == 0


def test_packing_takes_lexical_neighbours():
    a, b = np.arange(100, 110), np.arange(500, 510)
    documents = [np.tile(x, 3) for x in (a, b, a, b)]
    pieces = packing.fill(documents, window=60)
    assert {i for i, _, _, s, _ in pieces if s == 0} == {0, 2}


def packed_rows(spark, documents):
    """Rows of ``packing.tokenize`` of documents (id, ids), with the statistics of two tasks."""
    rows = [(i, 7 * i, n, bytearray(np.asarray(ids).astype("<u4").tobytes()), None) for n, (i, ids) in enumerate(documents)]
    for half in (documents[::2], documents[1::2]):
        rows.append((None, None, None, None, bytearray(packing.Corpus.of([np.asarray(ids) for _, ids in half]).packed())))
    return spark.createDataFrame(rows, "doc_id bigint, place bigint, row bigint, ids binary, stats binary")


def test_packing_deals_copies_to_one_shard(spark):
    rng = np.random.default_rng(4)
    texts = [rng.integers(10, 5000, 60) for _ in range(60)]
    tokens = packed_rows(spark, [(i, np.append(texts[i % 60], 1)) for i in range(120)])
    corpus = packing.corpus_of(tokens)
    assert (corpus.n, corpus.ids, corpus.found[1]) == (120, 120 * 61, 120)
    shard = {r["doc_id"]: r["shard"] for r in packing.dealt(tokens, corpus, 12, "<u4").collect()}
    assert 12 <= len(set(shard.values())) <= 14
    assert sum(shard[i] == shard[i + 60] for i in range(60)) >= 60 - len(set(shard.values()))  # a pair may lie on a bound
    pieces = packing.pack(tokens, 12, window=122).toPandas()
    together = pieces.groupby("sequence_id")["doc_id"].agg(lambda x: {i % 60 for i in x})
    assert sum(len(x) == 1 for x in together) >= 40
    assert pieces["length"].sum() == corpus.ids


def test_packing_deals_equal_rows_to_many_shards(spark):
    tokens = packed_rows(spark, [(5, [9, 8, 7, 1])] * 400)
    found = packing.dealt(tokens, packing.corpus_of(tokens), 10, "<u4").groupBy("shard").count().collect()
    assert len(found) == 10 and max(r["count"] for r in found) == 40


def test_content_keys_match_sorting():
    rng = np.random.default_rng(8)
    documents = [np.append(rng.zipf(1.3, rng.integers(0, 200)) % 3000 + 2, 1) for _ in range(60)]
    corpus, shards = packing.Corpus.of(documents), 6
    keys = packing.content_keys(np.concatenate(documents), np.concatenate([[0], np.cumsum([len(d) for d in documents])]), corpus, shards)
    for d, key in zip(documents, keys):
        terms, tf = np.unique(d, return_counts=True)
        weight = corpus.idf(terms) * tf * (packing.K1 + 1) / (tf + corpus.norm(len(d)))
        top = key[2:10][: len(terms)]
        of = dict(zip(terms.tolist(), weight.tolist()))
        assert np.allclose([of[t] for t in top.tolist()], np.sort(weight)[::-1][: len(top)], rtol=1e-4)
        for lead, k in zip(key[:2].tolist(), packing.SUBJECT_SHARDS):
            wide = corpus.found[terms] >= min(k * corpus.n / shards, corpus.found.max())
            assert np.isclose(of[lead], weight[wide].max(), rtol=1e-4)


def test_scores_are_bm25():
    rng = np.random.default_rng(9)
    documents = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(30)]
    corpus = packing.Corpus.of(documents)
    mean = sum(map(len, documents)) / len(documents)
    for seed in range(30):
        want = []
        for d in documents:
            total = 0.0
            for t in set(documents[seed].tolist()) & set(d.tolist()):
                df, tf = sum(t in x for x in documents), (d == t).sum()
                total += np.log1p((30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(total)
        assert np.allclose(packing.Index(documents, corpus).scores(seed), want)


def test_packing_asks_by_all_terms_and_corpus_statistics():
    # many terms that only the seed has, each heavier than those that it shares
    seed = np.concatenate([np.repeat(np.arange(100, 140), 3), np.arange(500, 510)])
    other, kin = np.arange(700, 750), np.concatenate([np.arange(500, 510), np.arange(900, 940)])
    own = packing.Corpus.of([seed, other, kin])
    scores = packing.Index([seed, other, kin], own).scores(0)
    assert scores[1] == 0 and scores[2] > 0
    common = packing.Corpus(np.where(np.arange(1000) // 10 == 50, 1000, own.found.max()), 1000, own.ids * 300)
    assert packing.Index([seed, other, kin], common).scores(0)[2] < scores[2] / 10


def test_warc_members_stop_at_the_stated_length():
    payload = bytes(random.Random(3).randbytes(300_000)) + b"z" * 500_000
    one, two = warc.record(1, "u", payload, None), warc.record(2, "u", b"", None)
    found = list(warc.members(one + two))
    assert [at for at, _ in found] == [0, len(one)] and warc.parse_record(found[0][1])["payload"] == payload and warc.parse_record(found[1][1])["payload"] == b""
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = packer.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\n" + b"0" * 50_000_000) + packer.flush()
    headless = zlib.compressobj(9, zlib.DEFLATED, 31)
    endless = headless.compress(b"WARC/1.1\r\n" + b"0" * 50_000_000) + headless.flush()
    for bad, why in ((bomb, "length"), (endless, "head"), (one[:-9], "cut off"), (one[:1000], "cut off"), (b"no gzip at all", "header")):
        tracemalloc.start()
        with pytest.raises(ValueError, match=why):
            list(warc.members(bad))
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
        tracemalloc.stop()
    assert list(warc.members(b"")) == []


def test_warc_types_with_repeated_and_null_ids(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (3, "u", "same"), (3, "u", "other"), (None, "u", "same"), (9, "u", "same"), (9, "u", "same"), (9, "u", None), (8, "u", ""), (7, "u", "alone")]
    typed = warc.assign_types(spark.createDataFrame(rows, "page_id long, url string, html string"))
    want = sorted([(5, "same", 3), (3, "same", None), (3, "same", None), (3, "other", None), (None, "same", None), (9, "same", 3), (9, "same", 3), (9, "", 8), (8, "", None), (7, "alone", None)], key=str)
    assert sorted([(r["page_id"], bytes(r["payload"]).decode(), r["refers_to"]) for r in typed.collect()], key=str) == want
    clashing = spark.createDataFrame(rows[:0], "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS size", "3 AS payload", "4 AS refers_to")
    assert warc.assign_types(clashing).count() == 0 and warc.read_archives(warc.write_archives(warc.assign_types(clashing))).count() == 0


def test_warc_round_trip(spark):
    rows = [(5, "http://a b/", "x"), (2, "u", "x"), (7, "u", None), (9, "u", ""), (4, None, "long " * 40000), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    read = warc.read_archives(warc.write_archives(warc.assign_types(pages))).collect()
    found = {r["page_id"]: r for r in read}
    assert len(read) == len(rows) and all(r["error"] is None for r in read)
    assert (found[5]["record_type"], found[5]["refers_to"], found[5]["payload_bytes"]) == ("revisit", 2, 1)
    assert found[2]["record_type"] == found[7]["record_type"] == "response" and found[9]["refers_to"] == 7
    assert bytes(found[4]["payload"]) == rows[4][2].encode() and found[4]["payload_digest"] == warc.base32_sha1(rows[4][2].encode())
    whole = warc.record(1, "u", b"abc", None)
    broken = spark.createDataFrame([("a", bytearray(whole + whole[:-3])), ("b", None)], "archive string, content binary")
    assert sorted((r["archive"], r["error"] is None) for r in warc.read_archives(broken).collect()) == [("a", False), ("a", True)]


def naive_measures(text):
    text = text or ""
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_against_counting(docs, empty):
    found = quality_rules.judged(docs)  # its columns kept and n_words clash and are replaced
    assert found.columns.count("kept") == 1 and set(docs.columns) <= set(found.columns)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in found.collect():
        assert tuple(r[n] for n in names) == naive_measures(r["text"]), r["text"]
    passed = quality_rules.passing(docs)
    assert passed.columns == docs.columns and passed.count() == 0
    assert quality_rules.passing(empty).count() == 0


def test_rules_order_never_changes_a_verdict(docs):
    rules = [*quality_rules.base_rules(), *quality_rules.default_rules()]
    texts = docs.select("doc_id", common.text_or_empty("text").alias("text"))
    measured = quality_rules.measure_columns(F.col("text"))
    verdicts = [sorted((str(r["doc_id"]), r["failed"] is None) for r in texts.withColumn("failed", quality_rules.first_failed(x, measured)).collect()) for x in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]
    ordered, seen = quality_rules.order_rules(docs, rules)
    assert {r.name for r in ordered} == {r.name for r in rules} and len(seen) == len(rules)


def test_rules_put_dear_and_idle_rules_last(spark):
    rng = random.Random(6)
    texts = ["# " * 80 if i % 2 else " ".join(f"word{rng.randrange(9999)}" for _ in range(1500)) for i in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rules = [r for r in (*quality_rules.base_rules(), *quality_rules.default_rules()) if r.name in ("repeats", "symbols", "exclaiming")]
    ordered, seen = quality_rules.order_rules(frame, rules)
    price = {e.name: e.seconds for e in seen}
    assert [r.name for r in ordered] == ["symbols", "repeats", "exclaiming"]  # both of the first two reject half, the last none
    assert price["repeats"] > 3 * price["symbols"]


def test_rules_skip_what_an_earlier_rule_settles(spark):
    frame = spark.createDataFrame([("short",), ("bad",)], "text string")
    dear = quality_rules.Rule("dear", lambda m: F.raise_error(F.lit("asked")).isNotNull())
    failed = quality_rules.first_failed([quality_rules.base_rules()[0], dear], quality_rules.measure_columns(F.col("text")))
    assert {r["f"] for r in frame.select(failed.alias("f")).collect()} == {"few_words"}
    assert frame.where(failed.isNull()).count() == 0


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be <|kind|>"), *((1, i, "user" if i % 2 else "assistant", f"t{i} &lt; [INST] " + "x" * (37 * i % 400)) for i in range(1, 60)), (2, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "ro\nle", "y" * 9000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns, window_tokens=400, history_tokens=60)
    read = chat.read_windows(made).toPandas().sort_values("window")
    for key in (1, 2, None):
        own = read[read["conv_id"].isna() if key is None else read["conv_id"] == key]
        got = [x for r in own.itertuples() for x in zip(r.roles, r.texts)]
        want = [(r or "", t or "") for k, _, r, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0))]
        assert got == want
        assert "".join(own["loss_text"]) == "".join(t for r, t in want if r == "assistant")
    for r in made.where("conv_id = 1").collect():
        assert r["formatted"].startswith("<|im_start|>system\nbe &lt;|kind|>") and r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>")
        parts = r["formatted"].split("<|im_end|>\n")[:-1]
        assert sum(-(-len(chat_text) // 4) + 4 for chat_text in (p.split("\n", 1)[1].replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&") for p in parts)) <= 400
    assert chat.windows(turns.where("false")).count() == 0


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("at_once", [0, 250_000])
def test_components_of_chains_and_stars(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "LINKS_AT_ONCE", at_once)
    links = [(i, i + 1) for i in range(100, 130)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (9, 8), (8, 9)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    assert found == {**{i: 100 for i in range(100, 131)}, **{i: 500 for i in range(500, 560)}, 8: 8, 9: 8}


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates_against_all_pairs(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    for g in range(4):
        base = rng.choices(vocabulary, k=50)
        for c in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((100 + 30 * g + c, " ".join(copy[: rng.randint(40, 50)])))
    frame = spark.createDataFrame([*rows, (None, "x y"), rows[-1]], "doc_id bigint, text string")
    found = near_dup.near_duplicates(frame, words=2).collect()
    assert len(found) == len(rows) + 2
    want = brute_components(rows, 2, 80)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]][1])
    assert near_dup.near_duplicates(frame.where("false")).count() == 0
    assert near_dup.drop_near_duplicates(frame, words=2).count() == len({c for _, c in want.values()}) + 1


def test_rows_that_share_an_id_lose_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (3, a, "x"), (3, a, "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (None, a, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, text_hash string").withColumn("group", F.lit(1)).withColumn("id", F.lit(2))
    found = near_dup.near_duplicates(frame).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    left = near_dup.drop_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted([(0, a), (1, a), (1, b), (4, ""), (5, "")])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.sort(pool[:600]), np.sort(pool[200:800])
    found = superminhash.signatures(np.concatenate([a, b, a[:1]]), np.array([0, 600, 1200, 1201]), 256)
    assert abs((found[0] == found[1]).mean() - 0.5) < 0.12
    assert len(set((found[2] >> np.uint64(32)).tolist())) == 256


def test_pipeline_keeps_clean_documents(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = labels.where("quality = 1").join(spark.read.parquet(f"{folder}/documents.parquet").where("size(split(text, ' ')) > 60"), "doc_id").count()
    assert docs.join(labels.where("quality = 1"), "doc_id").where("size(split(text, ' ')) > 60").count() >= 0.95 * clean
