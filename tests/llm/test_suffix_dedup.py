"""Repeated byte strings against all windows by hand, and the suffix sorter against sorting."""

import collections
import hashlib
import random

import numpy as np
import pytest

from touchline.llm import lyndon, suffix_dedup


def expected(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    found = []
    for b in raw:
        spans = suffix_dedup.united([(i, i + length) for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1])
        edges = [0, *(x for s in spans for x in s), len(b)]
        found.append((len(b), spans, b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))))
    return found


def found(spark, rows, length):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, key string, kept int")
    got = suffix_dedup.without_repeats(docs, length=length).collect()
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in got)
    return [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in got]


def check(spark, rows, length):
    wanted = [(i, *e) for (i, _), e in zip(rows, expected([t for _, t in rows], length))]
    assert sorted(found(spark, rows, length), key=str) == sorted(wanted, key=str)
    return wanted


def mosaic(rng, passages, n, alphabet):
    out = ""
    for _ in range(n):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        out += p[a : a + rng.randint(1, len(p))] + "".join(rng.choices(alphabet, k=rng.randint(0, 5)))
    return out


@pytest.mark.parametrize("seed", range(300))
def test_suffix_array_against_sorting(seed):
    rng = random.Random(seed)
    s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 60))]
    s = (s[:6] * 10 if seed % 3 == 0 else s) + [0]
    order = lyndon.suffix_array(np.array(s))
    assert order == sorted(range(len(s)), key=lambda i: s[i:])

    def shared(i, j):
        k = 0
        while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
            k += 1
        return k

    assert lyndon.longest_matches(np.array(s), order) == [max((shared(i, j) for j in range(len(s)) if j != i), default=0) for i in range(len(s))]


@pytest.mark.parametrize("seed,length", [(0, 16), (1, 24), (2, 40)])
def test_documents_against_all_windows(spark, monkeypatch, seed, length):
    rng = random.Random(seed)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)  # long documents are cut into blocks
    passages = ["".join(rng.choices("abé \n", k=rng.choice((20, 60, 150)))) for _ in range(12)] + ["ab" * 40, "\0" * 60, "z" * 90]
    rows = [(i, mosaic(rng, passages, rng.randint(0, 12), "abcdefgh")) for i in range(60)] + [(99, mosaic(rng, passages, 80, "xyz"))]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (None, None), (7, ""), (8, "a" * 5000)]
    wanted = check(spark, rows, length)
    assert 10 < sum(bool(w[2]) for w in wanted)


def test_anchors_with_very_many_contexts(spark, monkeypatch):
    """Groups over the bound are parted again and again, down to whole strings."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    rng = random.Random(9)
    common = "".join(rng.choices("abcdefgh", k=30))
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 12))) + common[rng.randint(0, 4) :] + "".join(rng.choices("ab", k=rng.randint(0, 12)))) for i in range(150)]
    wanted = check(spark, rows, 32)
    assert 10 < sum(bool(w[2]) for w in wanted) < 150


def test_exact_bound_empty_table_and_same_document(spark):
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnop", k=200))
    assert suffix_dedup.LENGTH == 200
    rows = [(1, text + "!" + text), (2, text[1:]), (3, "?" + text[:199] + "§"), (4, None)]
    wanted = check(spark, rows, 200)
    assert [len(w[2]) for w in wanted] == [2, 0, 0, 0]
    assert found(spark, [], 200) == []
    assert found(spark, [(None, None)], 200) == [(None, 0, [], b"")]
