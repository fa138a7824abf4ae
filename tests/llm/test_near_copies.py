"""The Jaccard join against all pairs, and components against a plain union."""

import random
from collections import defaultdict

import pytest
from odd_rows import docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from fleetsight.llm import common, jaccard_join
from fleetsight.llm.components import components


def plain(rows, words, percent):
    def fold(t):
        return [w.translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()]

    def grams(t):
        w = fold(t)
        return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in group]
    return sorted(out, key=repr)


def check(df, words, percent):
    got = jaccard_join.jaccard_components(df, words, percent, sketch_bits=10)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == plain(rows, words, percent)
    linked = [r for r in found if r.n_shingles]
    assert sum(r.first for r in linked) == len({r.component_id for r in linked})


def test_odd_rows(docs):
    check(docs.where("doc_id is null or doc_id <> 9").withColumn("text", F.regexp_replace("text", "[“”—]", "-")), 3, 80)


def test_no_rows(no_docs):
    assert jaccard_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_families_of_near_copies(spark, words, percent, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(6):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(15, 80))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(50)}"
            rows.append((len(rows) * 7 % 101, " ".join(copy)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)


@pytest.mark.parametrize("block", [4, 128])
def test_every_link_counts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd, rows = random.Random(6), [(90, None), (91, ""), (92, "alone here")]
    for size in (1, 2, 24):
        base = [f"w{rnd.randrange(3000)}" for _ in range(40)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(40)] = f"v{rnd.randrange(50)}"
            rows += [(len(rows), " ".join(copy))] * rnd.choice([1, 1, 2])
    sets = [set((t or "").split()) for _, t in rows]
    want = sorted(
        (rows[i][0], sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)))
        for i, a in enumerate(sets)
    )
    assert sum(n for _, n in want) > 4 * len(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 10, count_links=True)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == want


def test_stars_end_without_pairs(spark, monkeypatch):
    rounds, stars = [], jaccard_join._Join.stars

    def counted(self, rows, number):
        rounds.append(number)
        assert number < 5
        return stars(self, rows, number)

    monkeypatch.setattr(jaccard_join._Join, "stars", counted)
    a, x = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("x", 55)))
    check(spark.createDataFrame([(1, a), (2, x), (3, f"{a} {x}")], "doc_id long, text string"), 1, 80)
    assert rounds == [0]


def test_one_of_each_keeps_columns(docs):
    left = jaccard_join.one_of_each(docs, words=3, percent=80)
    assert left.columns == docs.columns
    # Nothing is lost of what has no shingles.
    assert {1, 2, 3, 8, 9} <= {r.doc_id for r in left.collect()}


def test_chains_become_one_component(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.vertex: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_rows_keep_their_numbers_however_a_scan_is_split(spark, docs, tmp_path):
    from fleetsight.llm.common import numbered

    path = str(tmp_path / "d")
    docs.withColumn("row", F.lit("x")).repartition(3).write.option("parquet.block.size", 1024).parquet(path)

    def rows():
        base = numbered(spark.read.parquet(path))
        return sorted((r.row, r.whole.row, repr(r.whole.doc_id), r.whole.text or "") for r in base.collect())

    first = rows()
    assert len({r[0] for r in first}) == docs.count()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Rows that are no scan are written once.
    assert sorted(r.row for r in numbered(docs.distinct()).collect()) == sorted({r.row for r in numbered(docs.distinct()).collect()})


def test_stored_tables_go_but_for_those_that_are_read(spark):
    from fleetsight.llm import common

    old, read = common.stored(spark.range(3)), common.stored(spark.range(5))
    common.clear_stored(read.where("id > 1"))
    assert read.count() == 5
    with pytest.raises(Exception):
        old.count()


def test_shingles_of_the_same_sets_are_merged(spark):
    rows = [(t, bytes([s])) for t, sets in {1: [1, 2], 2: [1, 2], 3: [1, 3], 4: [1, 2, 3], 5: [2, 1]}.items() for s in sets]
    merged = jaccard_join._Join.merged(spark.createDataFrame(rows, "token long, sig binary"))
    assert {r.token for r in merged.collect()} == {1, 3, 4}


def test_tables_go_when_no_later_step_reads_them(spark):
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {i % 7}") for i in range(40)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, count_links=True)
    left = [spark.read.parquet(path).columns for path in common._STORED]
    assert not [columns for columns in left if "slots" in columns or "shingles" in columns]
    assert found.count() == 40 and found.where("n_links = 39").count() == 40


def test_long_texts_that_share_a_few_words_are_no_pairs(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(f"w{rnd.randrange(300_000)}" for _ in range(3000))) for i in range(12)]
    base = common.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    join = jaccard_join._Join(base, 1, 80, 10)
    left = join.rows.withColumn("comp", F.col("sig"))
    assert left.count() > 100 and join.pairs(left).count() == 0


def test_few_pairs_need_no_second_star(spark, monkeypatch):
    rounds, stars = [], jaccard_join._Join.stars

    def counted(self, rows, number):
        rounds.append(number)
        return stars(self, rows, number)

    monkeypatch.setattr(jaccard_join._Join, "stars", counted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i:i + 40])) for i in range(12)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)
    assert rounds == [0]


def test_bits_never_tell_more_apart_than_there_is():
    import numpy as np

    rnd = np.random.default_rng(8)
    for n, more in [(1, 0), (64, 1), (65, 300), (1000, 24), (1000, 25), (20_000, 3000)]:
        one = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        two = np.unique(np.concatenate((one, rnd.integers(0, 1 << 63, more, np.uint64))))
        other = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        x, y, z = map(jaccard_join._odds, (one, two, other))
        assert jaccard_join._apart(x, y) <= len(two) - len(one) and jaccard_join._apart(x, x) == 0
        assert jaccard_join._apart(x, z) <= 2 * n and (n < 64 or 180 * jaccard_join._apart(x, z) > 20 * 2 * n)
