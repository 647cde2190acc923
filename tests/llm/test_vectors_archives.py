"""Hard negatives and vector codes against brute force; archives against round trips and hand-made files."""

import base64
import gzip
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilark.llm import codes, negatives, warc, whole

VECTORS = "vec_id long, embedding array<float>, label long, score string, id string"


def vectors(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)


def some_rows(n=400, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(1, 6))  # one label holds a third
        x = centres[label] * 0.3 + rng.normal(size=dim) * 0.3
        rows.append((i, [float(v) for v in np.float32(x)], label))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(60)]  # equal vectors: ties
    odd = [float("nan"), 1.0], [float("inf")] * dim, [1.0] * (dim - 1) + [None], None
    rows += [(n + 100 + k, v, 1) for k, v in enumerate(odd)]
    rows += [(n + 110, [0.0] * dim, 2), (n + 150, [0.0] * dim, 2), (n + 111, [0.1] * dim, None), (None, [0.1] * dim, 1)]
    rows += [(n + 200, [3e30, -3e30] + [0.5] * (dim - 2), 3), (n + 250, [1e6] * dim, 4), (n + 300, [0.5] * 3, 1), (n + 301, [0.5] * 3, 1),
             (n + 302, [0.25] * 3, 2), (n + 350, [], 1), (n + 351, [], 1), (n + 352, [], 2)]
    return [*rows, (0, [0.9] * dim, 7), rows[10]]  # repeated ids


def number(v, dim, scale=256):
    most = 2 ** ((61 - math.log2(max(1, dim))) // 2)
    return math.floor(max(-most, min(most, float(v) * scale)))


def is_sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every, positives=5, few=3):
    of = {}
    for i, v, label in rows:
        if i is not None and label is not None and is_sound(v):
            row = (label, [number(x, len(v)) for x in v])
            of[i] = min(of.get(i, row), row)
    out = []
    for a, (label, v) in of.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w)), b, other) for b, (other, w) in of.items() if b != a and len(w) == len(v))
        for s, b, other in [x for x in scores if x[2] == label][:positives]:
            fit = [x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:few]
            out += [(a, b, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 1])
def test_negatives_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "_blocks", lambda dim, b: F.lit(b if b > 1 else 24))
    monkeypatch.setattr(negatives, "CELLS", 1 << 21 if block > 1 else 200)
    rows = some_rows()
    found = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 10 == 0, block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == want


def test_negatives_lower_thresholds_until_windows_fill(spark, monkeypatch):
    """The rows of the first block have the lowest scores of all, so first thresholds are met by too few or too many."""
    monkeypatch.setattr(negatives, "_blocks", lambda dim, b: F.lit(8))
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4) * (1 + i % 7)], i % 2) for i in range(240)]
    found = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 3 == 0).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, 3)


def test_negatives_of_few_rows(spark):
    for rows in ([], [(0, [1.0], 1)], [(0, [1.0], 1), (50, [1.0], 1)], [(0, None, None)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)]):
        found = negatives.hard_negatives(vectors(spark, rows), F.col("id") % 50 == 0).collect()
        assert sorted(map(tuple, found)) == brute_negatives(rows, 50)


def test_candidates_miss_no_pair():
    rng = np.random.default_rng(0)
    for floor in (-np.inf, -5.0, 0.0, 3.0, 12.0, 100.0):
        a, x = rng.integers(-4, 5, (9, 10)).astype(float), rng.integers(-4, 5, (30, 10)).astype(float)
        floors = np.where(np.arange(9) % 3, floor, floor + 4)
        query, row = negatives.candidates(a, floors, x)
        assert set(zip(*np.nonzero(a @ x.T >= floors[:, None]))) <= set(zip(query, row))
        if floor == 12.0:
            assert len(query) < a.shape[0] * x.shape[0] / 2


def test_products_by_limbs_are_exact():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(-(1 << 27), 1 << 27, (7, 64)) for _ in range(2))
    want = [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in y] for a in x]
    for bits in (None, 5, 11):
        assert whole.products(x, y, bits).tolist() == want
    assert len(whole.limbs(x, 5)) == 6 and whole.products(x[:0], y).shape == (0, 7)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [number(x, len(v)) for x in v], label) for i, v, label in rows if is_sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    if not kept:
        return [], None
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    width = -(-dim // parts)
    cut = [[(r[1] + [0] * (width * parts - dim))[p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        best = assign()
        books = [[[sum(col) // len(mine) for col in zip(*mine)] if (mine := [c[p] for c, b in zip(cut, best) if b[p][1] == k]) else e
                  for k, e in enumerate(books[p])] for p in range(parts)]
    best = assign()
    error = [sum(d for d, _ in b) for b in best]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    out = [(r[0], r[2], "".join(f"{k:02x}" for _, k in b), e, min(total[r[2]], (1 << 63) - 1)) for r, b, e in zip(kept, best, error)]
    flat = ",".join(str(v) for book in books for e in book for v in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("parts, entries", [(4, 8), (5, 3), (16, 64)])
def test_codes_equal_brute_force(spark, parts, entries):
    rows = [r for r in some_rows() if r[0] is None or r[0] not in (600, 650)]
    coded, books = codes.compressed(vectors(spark, rows), parts, entries, 2)
    want, digest = brute_codes(rows, parts, entries, 2)
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted(map(str, map(tuple, coded.collect()))) == sorted(map(str, want)) and codes.digest(books) == digest


def test_codes_do_not_depend_on_partitions_and_take_large_numbers(spark):
    rows = some_rows()
    df = vectors(spark, rows)
    one, many = (codes.compressed(df.repartition(n), 4, 8, 2) for n in (1, 7))
    assert sorted(map(str, one[0].collect())) == sorted(map(str, many[0].collect())) and (one[1] == many[1]).all()
    want, digest = brute_codes(rows, 4, 8, 2)
    assert sorted(map(str, map(tuple, one[0].collect()))) == sorted(map(str, want)) and codes.digest(one[1]) == digest


def test_codes_of_few_rows(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5, 0.5], None), (1, [0.5, 0.5], None)], [(1, [], 1), (2, [], 1)]):
        coded, _ = codes.compressed(vectors(spark, rows), 2, 4, 2)
        assert sorted(map(str, map(tuple, coded.collect()))) == sorted(map(str, brute_codes(rows, 2, 4, 2)[0]))


PAGES = "page_id long, url string, html string, payload binary, record_id string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"p", "r") for r in rows], PAGES)


def page_rows():
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 5\nhello\n"
    long = "<p>" + "é" * 300_000 + "</p>"
    return [
        (1, "http://a.example/", "<p>one</p>"), (2, "http://a.example/x y\n", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://b/", tricky),
        (6, "http://b/2", tricky), (7, "http://c/é", long), (None, "http://n/", "none"), (8, "http://n/", "none"), (9, "http://d", "dup"), (9, "http://d", "dup"),
        (-3, "http://e", "HTTP/1.1 200 OK\r\n\r\nx"), (1 << 62, "http://f", "\x00\n\n"), (10, "http://g", "<p>one</p>"),
    ]


def converted(spark, rows, folder, most=warc.ARCHIVE_BYTES):
    warc.write_arc(pages(spark, rows), f"{folder}/arc", most=most)
    warc.convert(spark, f"{folder}/arc", f"{folder}/warc", most)
    return warc.with_referred_page(warc.read_warc(spark, f"{folder}/warc", with_payload=True))


@pytest.mark.parametrize("most", [warc.ARCHIVE_BYTES, 600])
def test_pages_come_back(spark, tmp_path, most):
    rows = page_rows()
    found = converted(spark, rows, tmp_path, most).collect()
    keep, n = {}, {}
    for i, _, h in rows:
        key = h or ""
        keep[key] = max(keep.get(key, -1 << 63), -1 << 63 if i is None else i)
        n[key] = n.get(key, 0) + 1
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found)
    want, seen = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = (-1 << 63 if i is None else i) == keep[h or ""] and (h or "") not in seen
        if first:
            seen.add(h or "")
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", str(None if first else keep[h or ""])))
    assert got == sorted(want)
    assert all(r.digest_holds for r in found) and len({r.record_id for r in found}) == len(rows)
    assert {r.page_id: r.payload.decode() for r in found if r.record_type == "response"}[6] == rows[5][2]
    assert {r.warc_date for r in found} == {"2024-01-01T00:00:00Z"} and {r.uri for r in found} >= {"-", "http://a.example/x%20y"}


def test_an_empty_table_of_pages(spark, tmp_path):
    assert converted(spark, [], tmp_path).collect() == []


V1 = b"filedesc://old.arc 0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
V2_BLOCK = b"2 0 archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
V2 = b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc %d\n" % len(V2_BLOCK) + V2_BLOCK


def test_hand_made_archives(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    old = V1 + b"http://www.dryswamp.edu:80/index.html 127.10.100.2 199701 text/html 39\nHTTP/1.0 200 OK\nServer: x\n\n<p>hello</p>\n\n\n"
    old += b"dns:www.dryswamp.edu 127.10.100.2 19970101 text/dns 9\n127.0.0.1\n"
    new = V2 + b"\nno record line\nhttp://a b/ 1.2.3.4 20010203040506 text/html 200 - - 300 new.arc 12\n<p>hello</p>\n"
    new += b"http://cut/ 1.2.3.4 bad text/html 200 - - 400 new.arc 900\nHTTP/1.1 200 OK\r\n\r\nrest"
    (tmp_path / "arc" / "old.arc").write_bytes(old)
    half = len(new) // 2
    (tmp_path / "arc" / "new.arc.gz").write_bytes(gzip.compress(new[:half]) + gzip.compress(new[half:]))
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = {r.uri: r for r in warc.read_warc(spark, str(tmp_path / "warc"), with_payload=True).collect()}
    assert set(found) == {"http://www.dryswamp.edu:80/index.html", "dns:www.dryswamp.edu", "http://a%20b/", "http://cut/"}
    page, twin = found["http://www.dryswamp.edu:80/index.html"], found["http://a%20b/"]
    assert {page.record_type, twin.record_type} <= {"response", "resource", "revisit"} and "revisit" in (page.record_type, twin.record_type)
    assert page.payload_digest == twin.payload_digest and page.warc_date == "1997-01-01T00:00:00Z" and twin.warc_date == "2001-02-03T04:05:06Z"
    assert found["dns:www.dryswamp.edu"].record_type == "resource" and found["dns:www.dryswamp.edu"].payload == b"127.0.0.1"
    assert found["http://cut/"].truncated and found["http://cut/"].payload == b"rest" and found["http://cut/"].warc_date == "1970-01-01T00:00:00Z"
