"""Periodic runs, fingerprints and vector codes: odd rows and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from odd_rows import ODD, docs, no_docs, odd  # noqa: F401
from pyspark.sql import functions as F

from fleetsight.llm import fingerprints as prints
from fleetsight.llm import periodic_runs as periodic
from fleetsight.llm import vector_codes as codes


def plain_runs(words, least=6, power=4):
    """Every period from every place."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(text):
    return [w for w in (text or "").translate({c: 32 for c in b"\t\n\x0b\x0c\r"}).split(" ") if w]


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 10 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            words = [words[i if i < a else min(n - 1, a + (i - a) % p)] for i in range(n)]
        runs = plain_runs(words)
        assert runs == periodic.find_runs(words)
        # The cut into pieces changes nothing.
        assert runs == sorted(periodic.runs_of_piece(words), key=lambda r: (r[0], r[2]))
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert periodic.collapse(words, runs) == [w for i, w in enumerate(words) if i not in dropped]


def test_runs_of_other_limits():
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        assert periodic.find_runs(words, 5, 3) == plain_runs(words, 5, 3)


def test_runs_of_long_texts():
    assert periodic.runs_of_piece([0] * 30_000) == [(0, 30_000, 1)]
    assert periodic.find_runs([1, 2] + [i % 701 for i in range(30_000)] + [1]) == [(2, 30_000, 701)]


def test_runs_of_odd_rows(spark, docs, no_docs):
    found = periodic.run_digests(periodic.periodic_runs(periodic.planted(docs))).collect()
    expected = []
    for doc_id, text in ODD:
        words = plain_words(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 1000 or doc_id != 9 else [(0, 20_000, 700)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = periodic.collapse(words, runs)
        expected.append((
            doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest(),
        ))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert periodic.run_digests(periodic.periodic_runs(periodic.planted(no_docs))).count() == 0


def plain_print(text):
    """(hash, position) by the definition: every window on its own."""
    def polynomial(run):
        value = 0
        for c in run:
            value = (value * prints._BASE + ord(c)) % 2**32
        return int(prints.mixed(np.array([value], np.uint32))[0])

    if len(text) < prints.GRAM:
        return [(polynomial(text), 0)] if text else []
    hashes = [polynomial(text[i:i + prints.GRAM]) for i in range(len(text) - prints.GRAM + 1)]
    kept = set()
    for begin in range(max(1, len(hashes) - prints.WINDOW + 1)):
        window = hashes[begin:begin + prints.WINDOW]
        kept.add(max(i + begin for i, h in enumerate(window) if h == min(window)))
    return [(hashes[i], i) for i in sorted(kept)]


def test_entries_are_those_of_each_window():
    rng = random.Random(3)
    texts = ["", "a", "👍🏽" * 9, "ab" * 100, "x" * 5000] + ["".join(rng.choices("abcd ", k=rng.randint(0, 200))) for _ in range(60)]
    for text, entries in zip(texts, prints.winnow_all(texts)):
        assert [tuple(map(int, e)) for e in entries] == plain_print(text)


def test_shared_passages_meet():
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=prints.GRAM + prints.WINDOW - 1))
    for _ in range(50):
        one, two = ("".join(rng.choices("ijklmnop ", k=300)) for _ in range(2))
        a, b = prints.winnow_all([one[:91] + passage + one[91:], two[:17] + passage + two[17:]])
        assert set(a[:, 0]) & set(b[:, 0])


def expected_prints(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        changed = text[:len(text) - len(text) // 3] + following[:len(text) // 3]
        own, new, other = (plain_print(t) for t in (text, changed, following))

        def dice(a, b):
            a, b = {h for h, _ in a}, {h for h, _ in b}
            return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

        def digits(entries):
            return ",".join(f"{h:08x}{p:08x}" for h, p in entries)

        sha = hashlib.sha256(changed.encode()).hexdigest()
        yield doc_id, len(text), sha, digits(own), digits(new), dice(own, new), dice(own, other)


def test_fingerprints_of_odd_rows(spark, docs, no_docs):
    found = sorted(repr(tuple(r)) for r in prints.fingerprints(docs).collect())
    assert found == sorted(repr(r) for r in expected_prints([r if r[0] != 9 else r for r in ODD]))
    assert prints.fingerprints(no_docs).count() == 0
    entries = {r.doc_id: r.entries for r in prints.document_fingerprints(docs).collect()}
    assert [tuple(e) for e in entries[6]] == plain_print(dict(ODD)[6])


@pytest.mark.parametrize("rows", [[(7, "alone in the table")], [(None, "a" * 40), (None, "b" * 40)]])
def test_fingerprints_of_few_rows(spark, rows):
    found = prints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr(r) for r in expected_prints(rows))


def plain_codes(rows, entries=64):
    """The contract, vector by vector."""
    kept = [(i, [int(np.floor(256.0 * x)) for x in v], n) for i, v, n in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    size = max(1, -(-longest // 16))
    kept = [(i, v + [0] * (16 * size - len(v)), n) for i, v, n in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * size:(p + 1) * size] for _, v, _ in first] for p in range(16)]

    def near(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * size:(p + 1) * size], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(2):
        found = [[near(p, v)[0] for p in range(16)] for _, v, _ in kept]
        for p in range(16):
            for e in range(len(books[p])):
                own = [v[p * size:(p + 1) * size] for (_, v, _), f in zip(kept, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, n, [near(p, v) for p in range(16)]) for i, v, n in kept]
    total = {}
    for _, n, parts in out:
        total[n] = total.get(n, 0) + sum(d for _, d in parts)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e, _ in parts), sum(d for _, d in parts), total[n], digest) for i, n, parts in out]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.select("*", *[F.lit(1).alias(c) for c in ("code", "error", "none", "known", "salt", "place", "total", "parts")])


ODD_VECTORS = [
    (1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 32, 2), (4, [float("inf")] + [0.0] * 31, 2), (None, [0.5] * 32, None),
    (5, [0.25] * 32, None), (5, [0.25] * 32, None), (6, [], 3), (7, [-0.001] * 20, 3), (8, [1.0] * 37, 4),
]


@pytest.mark.parametrize("salted", [False, True])
def test_codes_of_odd_rows(spark, salted, monkeypatch):
    if salted:
        monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    rng = np.random.default_rng(2)
    near = [(100 + i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.3, 32)], i % 3 or None) for i in range(150)]
    for rows in (ODD_VECTORS, ODD_VECTORS + near, near * 2, ODD_VECTORS[:4], []):
        found = codes.vector_codes(vectors(spark, rows)).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_codes(rows)))


def test_huge_components_are_bounded(spark):
    found = codes.vector_codes(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert [r.error for r in found] == [0, 0]


def test_blocks_and_groups_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 48)], 1) for i in range(90)]
    expected = sorted(map(repr, plain_codes(rows)))
    for group, block in ((7, 2), (64, 5)):
        monkeypatch.setattr(codes, "GROUP", group)
        monkeypatch.setattr(codes, "BLOCK", block)
        vectors_of = codes.usable(vectors(spark, rows))
        books = codes.first_codebooks(vectors_of, 64)
        # In this process, so that the changed limits hold.
        batches = vectors_of.toArrow().to_batches()
        groups = list(codes._groups(48, batches))
        for _ in range(2):
            totals = np.zeros(books.size // 3 * 4, np.int64)
            for part in codes._round(books, groups):
                totals[part.column(0).to_numpy()] += part.column(1).to_numpy()
            totals = totals.reshape(16, 64, 4)
            books = np.where(totals[:, :, 3:] > 0, totals[:, :, :3] // np.maximum(totals[:, :, 3:], 1), books)
        done = [r for b in codes._codes(books, groups) for r in b.to_pylist()]
        digest, total = codes.codebooks_digest(books), sum(r["error"] for r in done)
        assert sorted(repr((r["vec_id"], r["code"], r["error"], total, digest)) for r in done) == expected


def test_neighbours_on_the_curve_are_neighbours():
    points = np.array([(x, y) for x in range(16) for y in range(16)])
    ordered = points[np.argsort(codes.hilbert_keys(points, 4))]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()
