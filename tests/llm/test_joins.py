"""Jaccard join, decontamination, suffix removal and lattice hashing against brute force."""

import hashlib
import random

import numpy as np
import pytest
from edge import BASE, documents, empty, words
from pyspark.sql import functions as F

from vigilark.llm import decontaminate, jaccard, lattice, suffix
from vigilark.llm.common import components


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(sets):
    """Smallest id reachable, by comparing all pairs."""
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def near_texts(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 20, 80, 300)))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(bases[i % 12] if i % 3 else bases[0])  # a third are near copies of one text
        for _ in range(rng.randrange(0, 1 + len(text) // 18)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    return rows


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    rows = near_texts()
    found = jaccard.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: shingles(t) for i, t in rows}
    assert {r.doc_id: r.n_shingles for r in found} == {k: len(v) for k, v in sets.items()}
    assert {r.doc_id: r.component_id for r in found} == linked(sets)


def test_jaccard_edges(spark):
    found = jaccard.near_documents(documents(spark)).collect()
    assert len(found) == documents(spark).count()
    of = {r.doc_id: r for r in found}
    assert of[2].component_id == 1 and of[7].component_id == 6 and of[9].component_id == 8
    assert [of[k].n_shingles for k in (3, 4, 5)] == [0, 0, 0] and of[4].component_id == 4
    assert of[None].component_id is None
    assert jaccard.near_documents(empty(spark)).collect() == []
    kept = jaccard.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 3, 4, 5, 6, 8, 10, 11]
    assert jaccard.one_of_each(empty(spark)).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.range(0, 40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(spark, edges.filter("a <> 20"), "test").collect()
    assert {r.id: r.component for r in found} == {i: 0 if i <= 20 else 21 for i in range(41)}
    assert components(spark, edges.limit(0), "test").collect() == []


def contained(docs, items, threshold=0.75):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            k = min(5, len(v))
            if k:
                want = {tuple(v[j:j + k]) for j in range(len(v) - k + 1)}
                have = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
                if len(want & have) >= threshold * len(want):
                    out[d, i] = (len(want), len(want & have))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefg") + str(rng.randrange(6)) for _ in range(rng.choice((1, 3, 5, 12, 40))))) for i in range(25)]
    docs = []
    for d in range(60):
        w = [f"x{rng.randrange(300)}" for _ in range(rng.choice((0, 10, 400)))]
        if d % 3 == 0:
            own = items[rng.randrange(25)][1].split()
            if d % 2:
                own[rng.randrange(len(own))] = "changed"
            w[5:5] = own
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, "")]
    items += [(90, None), (91, " ")]
    found = decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in found.collect()} == contained(docs, items)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, BASE.upper(), "x"), (2, BASE, "x"), (None, "short one", "x"), (4, None, "x")], "item_id long, text string, doc_id string")
    found = decontaminate.contained_items(documents(spark), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2), (8, None), (9, None)}
    kept = decontaminate.clean_documents(documents(spark), items)
    assert kept.columns == documents(spark).columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, None, 10, 11}
    assert decontaminate.clean_documents(documents(spark), items.limit(0)).count() == documents(spark).count()
    assert decontaminate.contained_items(empty(spark), items).collect() == []


def removed(rows):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = True
            seen.add(data[p:p + 100])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        out[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [line(n) for n in (99, 100, 130, 400)]
    rows = [(i, line(rng.randrange(300)) + rng.choice(shared)[rng.randrange(30):] + line(rng.randrange(200)) + rng.choice(shared)) for i in range(60)]
    return [*rows, (70, None), (71, ""), (72, "a" * 700), (73, "a" * 120), (74, "ab" * 300), (75, rows[3][1]), (76, rows[3][1])]


@pytest.mark.parametrize("large", [4096, 2])
def test_suffix_removal_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE_BUCKET", large)
    rows = passages(large)
    found = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == removed(rows)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n in (*range(0, 40), 300, 1000):
        text = rng.integers(1, 4, n)
        assert suffix.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_suffix_edges(spark):
    found = {r.doc_id: r for r in suffix.without_repeats(documents(spark)).collect()}
    assert found[7].n_removed == found[7].n_bytes and found[6].n_removed < found[6].n_bytes and found[3].n_bytes == 0
    assert found[8].n_removed == 0 and found[None].n_removed == 0
    assert suffix.without_repeats(empty(spark)).collect() == []


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (300, 8))
    got = lattice.lattice_points(x)
    near = lattice.neighbours()
    assert len(np.unique(near, axis=0)) == 240 and set((near ** 2).sum(1)) == {8}
    assert (((got % 2).sum(1) == 0) | ((got % 2).sum(1) == 8)).all() and (got.sum(1) % 4 == 0).all()
    own = ((x - got / 2) ** 2).sum(1)
    others = ((x[:, None] - (got[:, None] + near) / 2) ** 2).sum(2)
    assert (own[:, None] <= others + 1e-9).all()


def test_near_vectors_recall_and_precision(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TILE", 32)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((120, 64))
    x = np.vstack([centres[i % 120 if i % 3 else 0] + rng.standard_normal(64) * rng.choice((0.05, 0.25, 0.34)) for i in range(600)]).astype(np.float32)
    x[50] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [None] * 64), (1004, []), (1005, [1.0, 2.0])]
    found = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    got = np.array([found[i].n_links for i in range(600)])
    assert (got <= true.sum(1)).all() and got.sum() >= 0.9 * true.sum()
    assert found[50].n_links >= 1 and found[50].component_id <= 10
    assert all(found[k].n_links == 0 and found[k].component_id == k and found[k].kept for k, _ in odd)
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
