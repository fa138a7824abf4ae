"""Quality rules, exact copies, line deduplication: odd rows against plain Python, queries against SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from odd_rows import SMALL, docs, no_docs  # noqa: F401
from pyspark.sql import Row

from fleetsight.llm import exact_dedup, line_dedup, quality_rules
from fleetsight.llm.queries import ORACLE_SQL, QUERIES

SPACE = "\x20\x09-\x0D"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_measures(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACE}]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows(docs, no_docs):
    judged = quality_rules.quality_rules(docs)
    got = rows_of(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for r in docs.collect():
        m = plain_measures(r.text)
        want.append((r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want, key=repr)
    assert quality_rules.quality_rules(no_docs).count() == 0
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7, None}


def test_rules_are_one_projection(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Coalesce", "") and "Python" not in plan


def test_rules_can_be_replaced(docs):
    rules = [quality_rules.Rule("tiny", "n_words", low=1)]
    kept = quality_rules.quality_rules(docs, base=rules, rules=[]).where("kept")
    assert {r.doc_id for r in kept.collect()} == set(range(4, 15)) | {None}


@pytest.mark.parametrize("block", [1, 3, 64, exact_dedup.BLOCK])
def test_exact_copies_on_odd_rows(spark, docs, block):
    if block < 64:  # many levels
        docs = docs.where("doc_id is null or doc_id not in (8, 9)")
    got = exact_dedup.exact_duplicates(docs, block)
    assert got.count() == docs.count()
    norm = lambda t: re.sub(f"[{SPACE}]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    for r in got.collect():
        (text, ids), = [(t, g) for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == min(i for i in ids if i is not None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = Counter(r.text_sha256 for r in got.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    distinct = exact_dedup.distinct_documents(docs, block)
    assert distinct.columns == docs.columns and sorted(norm(r.text) for r in distinct.collect()) == sorted(groups)


def test_exact_copies_of_nothing(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_blocks_that_repeat_inside_a_text(spark):
    texts = ["ab" * 8, "ab" * 7, "ab" * 8, "ba" * 8, "ab" * 16, "ab" * 15 + "ba"]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs, 2).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}


def plain_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-(1 << 63) if doc_id is None else doc_id)
    top = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if doc_id is None else doc_id
        left = [x for x in lines if top.get(key(x), own) == own]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan_in", [(1, 2), (3, 2), (5, 3)])
def test_line_dedup_on_odd_rows(docs, batches, fan_in):
    got = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, batches=batches, fan_in=fan_in, buckets=3)
    assert rows_of(got) == plain_lines([(r.doc_id, r.text) for r in docs.collect()], 20, 3)


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_runs_take_batches_in_any_order(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fan_in=2, buckets=2)
    for start in (40, 0, 80, 20, 60):
        rows = [(bytes([i % 3]), start + i) for i in range(6)]
        runs.add(spark.createDataFrame(rows, "key binary, doc_id long"))
    assert len(runs.names()) < 5  # compacted
    assert {(bytes(r.key), r.top) for r in runs.frequent().collect()} == {(b"\x00", 83), (b"\x01", 84), (b"\x02", 85)}
    runs.close()
    assert runs.names() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
