"""Periodic runs against every period by hand."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from touchline.llm import periodic


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def runs(found):
    codes = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in found], np.int64)
    spans = {}
    for p in range(1, len(x) // 3 + 1):
        same = np.concatenate([[0], (x[:-p] == x[p:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same)).tolist()
        for start, end in zip(edges[::2], edges[1::2]):
            if end + p - start >= max(24, 3 * p):
                spans.setdefault((start, end + p), p)
    return sorted((s, e - s, p) for (s, e), p in spans.items())


def collapsed(found, spans):
    drop = {i for s, n, p in spans for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(found) if i not in drop)


def repetitive(rng, n):
    out = []
    while len(out) < n:
        unit = rng.choices("abcd" if rng.random() < 0.5 else [f"w{i}" for i in range(50)], k=rng.choice((1, 2, 3, 5, 8, 9, 17, 40, rng.randint(1, max(1, n // 4)))))
        block = unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))]
        out += block * rng.choice((1, 1, 1, 3, 4))
        out += rng.choices("abcdef", k=rng.randint(0, 4))
    return out[:n]


def rows_of(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, runs string, n bigint")
    return periodic.periodic_runs(docs, **options).collect()


@pytest.mark.parametrize("tile", (64, 4096))
def test_tiles_find_all_runs(spark, monkeypatch, tile):
    """Tiles of few words are solved here and stitched in Spark, so that runs cross many of their borders."""
    monkeypatch.setattr(periodic, "TILE_WORDS", tile)
    rng = random.Random(tile)
    texts = [repetitive(rng, rng.choice((20, 24, 30, 100, 400, 1500, 5000))) for _ in range(120)] + [["a"] * 3000, ["a", "b"] * 700, ["x", *["a"] * 900, "y", *["a"] * 900]]
    pieces = []
    for i, found in enumerate(texts):
        codes = {}
        x = np.array([codes.setdefault(w, len(codes)) for w in found], np.int32)
        for _, number, a, b in periodic.tiles_of(x, np.array([0, len(x)])):
            pieces += [(i, 0, p, a + s, a + e) for p, s, e in periodic.solved(x[a:b], number, a == 0, b == len(x))]
    got = {}
    for r in periodic.stitched(spark.createDataFrame(pieces, "id bigint, text_hash bigint, period bigint, start bigint, end bigint")).collect():
        got.setdefault(r["id"], []).append((r["start"], r["length"], r["period"]))
    for i, found in enumerate(texts):
        assert sorted(got.get(i, [])) == runs(found), i


def test_documents_with_nulls_ties_repeats_and_long_texts(spark):
    rng = random.Random(3)
    tie = ["a", "b"] * 15 + ["c"] + ["d", "e"] * 15
    long = repetitive(rng, 30_000)
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, " ".join(tie)), (4, " ".join(tie)), (4, "other  text\n" * 9), (None, "x " * 30), (None, "y " * 23), (5, "\n".join(long)), (6, "é\x85 ß " * 20)]
    got = rows_of(spark, texts)
    assert len(got) == len(texts)
    wanted = sorted((str(i), len(words(t)), runs(words(t)), collapsed(words(t), runs(words(t)))) for i, t in texts)
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == wanted
    assert all(r["collapsed_sha256"] == hashlib.sha256(r["collapsed"].encode()).hexdigest() for r in got)
    assert sorted(r["collapsed_sha256"] for r in rows_of(spark, texts, texts=False)) == sorted(r["collapsed_sha256"] for r in got)
    assert rows_of(spark, []) == []


def test_query_against_every_period(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.choice((0, 5, 30, 200, 900))))) for i in range(150)] + [(None, "a " * 40), (7, "b " * 60)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.query(spark, str(tmp_path)).collect()]
    wanted = []
    for i, text in texts:
        found = words(text)
        h, n = zlib.crc32(str(i).encode()), len(found)
        if i is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            found = [found[k] if k < a else found[a + (k - a) % p] for k in range(n)]
        spans = runs(found)
        s, ln, p = min(spans, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        text_of = "".join(f"{a},{b},{c}\n" for a, b, c in spans)
        wanted.append((i, len(spans), s, ln, p, None if s is None else 1000 * ln // p, hashlib.sha256(text_of.encode()).hexdigest(), hashlib.sha256(collapsed(found, spans).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert sum(w[1] > 0 for w in wanted) > 5
