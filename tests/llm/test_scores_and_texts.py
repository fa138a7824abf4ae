"""Classifiers, archives, personal data, tokens and packing: odd rows, brute force and round trips."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from array import array

import numpy as np
import pytest
import regex
from odd_rows import SMALL, docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from fleetsight.llm import common, packing, pii, quality_ranking, toxicity, tree_bpe, warc
from fleetsight.llm.queries import QUERIES
from fleetsight.llm.vocab import tokenizer, vocabulary_path


def ids_of(df):
    return sorted((r.doc_id for r in df.collect()), key=repr)


def accuracy(spark, name, column):
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    scored = QUERIES[name](spark, SMALL.replace("0.001", "0.01"))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    return sum(r[column] == r.predicted for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    assert accuracy(spark, "op2_quality_ranking", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert accuracy(spark, "op3_toxicity", "toxic") > 0.9


@pytest.mark.parametrize("score", [quality_ranking.rank_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(spark, docs, no_docs, score):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, 1), (None, 1), (7, None), (99, 1)], "doc_id long, label int")
    assert ids_of(score(docs, labels)) == ids_of(docs)
    assert score(docs, labels.limit(0)).count() == docs.count()
    assert score(no_docs, labels).count() == 0


def test_preferences_put_good_first():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (50, 3))
    w = quality_ranking.fit_preferences(good, bad)
    raw = np.concatenate((good, bad)) @ w
    threshold = np.sort(raw)[49:51].mean()
    assert ((good @ w > threshold).mean() > 0.9) and ((bad @ w > threshold).mean() < 0.2)


def test_preferences_against_a_plain_solver():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.5, 1, (300, 4)), rng.normal(-0.5, 2, (80, 4))
    both = np.concatenate((good, bad))
    g, b = (good - both.mean(0)) / both.std(0), (bad - both.mean(0)) / both.std(0)
    pairs = g[np.random.default_rng(0).integers(0, len(g), size=len(b) * quality_ranking.RIVALS)]
    pairs = pairs - np.repeat(b, quality_ranking.RIVALS, axis=0)
    w = np.zeros(4)
    for _ in range(20_000):  # plain gradient descent on the mean logistic loss and the ridge
        w += 0.1 * (pairs.T @ (1 / (1 + np.exp(pairs @ w))) / len(pairs) - quality_ranking._RIDGE * w)
    assert np.allclose(quality_ranking.fit_preferences(good, bad), w / both.std(0), atol=1e-4)


def test_the_quantile_is_that_of_all_documents(spark):
    # Labels are half bad, and cover few documents; half of all documents must fall below the threshold.
    rows = [(i, "one " * (3 + i % 97) + "#" * (i % 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 97 > 48)) for i in range(0, 400)], "doc_id long, label int")
    share = sum(i % 97 <= 48 for i in range(400)) / 400
    measured = quality_ranking.with_measures(docs)
    found = quality_ranking.fit_ranking(measured, labels)
    raw = sorted(r[0] for r in measured.select(found.raw()).collect())
    at = int(np.ceil(share * len(raw))) - 1
    upper = min(v for v in raw if v > raw[at])
    assert np.isclose(np.log(0.7 / 0.3) - found.bias, (raw[at] + upper) / 2, atol=1e-9)
    got = quality_ranking.rank_quality(docs, labels).collect()
    assert sum(1 - r.predicted for r in got) == sum(v <= raw[at] for v in raw)
    one = measured.where("doc_id = 5")
    assert quality_ranking.score_quantile(one, found.raw(), 0.5) == one.select(found.raw()).first()[0]


def test_swaps_take_weight_from_group_names():
    # Feature 0: a group's name, mostly in toxic rows. Feature 1: what makes them toxic. Feature 2: another group's name.
    rows = [([0, 1], [1, 1])] * 20 + [([2], [1])] * 20 + [([], [])] * 20 + [([1], [1])] * 5
    labels = np.array([1.0] * 20 + [0.0] * 40 + [1.0] * 5)
    swaps = [([2, 0], [1, -1])] * 20
    free, _ = toxicity.fit_weights(rows, labels, [], 3)
    held, bias = toxicity.fit_weights(rows, labels, swaps, 3, penalty=50)
    assert abs(held[0] - held[2]) < 0.1 < abs(free[0] - free[2])
    assert bias + held[1] > 0 > bias + held[0]


@pytest.mark.parametrize("least", [0, 10])
def test_archives_on_odd_rows(spark, least):
    rows = [
        (1, "http://A.example.com/x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "https://b.org:8080/?q", None), (4, "b.org", ""),
        (5, "http://a.example.com/x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\né漢\n"), (6, "x\r\ny", "é" * 30_000), (7, "u", "<p>same</p>"),
        (7, "u", "<p>same</p>"), (None, "n", "alone"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).repartition(3)
    got = warc.archive_pages(pages, least).collect()
    assert sorted((r.page_id, r.url) for r in got if r.page_id) == sorted((i, u) for i, u, _ in rows if i)
    for r in got:
        text = next((h or "") for i, u, h in rows if (i, u) == (r.page_id, r.url))
        data = text.encode()
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 11)
    assert kinds == [(1, "revisit", 7), (2, "revisit", 7), (7, "response", None), (7, "revisit", 7)]
    empty = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0)
    assert empty == ([(3, "revisit", 4), (4, "response", None)] if least == 0 else [(3, "response", None), (4, "response", None)])
    keys = [(r.url_key is not None, r.url_key or "", r.captured) for r in got]
    assert keys == sorted(keys)  # tasks in order are the global order
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rnd = random.Random(2)
    for k in range(0, 12):
        runs = [sorted((rnd.randrange(30), i) for _ in range(rnd.randrange(9))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def plain_spans(text):
    def luhn(digits):
        double = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return sum(d - 9 if d > 9 else d for d in double) % 10 == 0

    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    tests = [
        lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
        lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    ]
    found = [(m.start(), m.end(), k) for k, p in enumerate(patterns) for m in re.finditer(p, text) if tests[k](m[0])]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    units = ["a", "b@", "@", "x.y", ".", "1", "12", "255", "256", "4111 1111 1111 1111", " ", "-", "+", "+1 (", ")", "0", "é", "@c.de", "%"]
    for _ in range(5000):
        text = "".join(rnd.choice(units) for _ in range(rnd.randint(0, 24)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_take_no_longer_by_far():
    begun = time.process_time()
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "+" * 200_000):
        pii.base_spans(text)
    assert time.process_time() - begun < 10  # each of them takes hours if matching starts anew at every place


def test_personal_data_in_odd_rows(docs, no_docs):
    got = pii.all_spans(docs).collect()
    want = sorted((str(r.doc_id), plain_spans(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), [(s.start, s.stop, s.kind) for s in r.spans if s.kind < 4]) for r in got) == want
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[10] == "mail [EMAIL] or [PHONE] now" and texts[1] is None and texts[2] == ""
    assert pii.all_spans(no_docs).count() == 0 and pii.sanitise(no_docs).count() == 0


def test_texts_meet_their_spans_once(spark, docs):
    clean = pii.sanitise(docs)
    found = clean._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join LeftOuter, (row" in line for line in found.splitlines()) == 1
    assert not [path for path in common._STORED if spark.read.parquet(path).columns == ["row", "text"]]



def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"letter number{'abcdefgh'[i]} from Zorbaxi at z@zorb.example about topic{'abcdefgh'[i]} today") for i in range(6)]
    rows += [(100 + i, f"letter about something else today {'abcdefghij'[i % 10]}") for i in range(60)]
    rows += [(200 + i, "copied Quixotic words q@q.example forever") for i in range(9)]  # one context, however often
    found = {r.doc_id: r for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {rows[d][1][s.start:s.stop] for d in range(6) for s in found[d].spans if s.kind == 4}
    assert "Zorbaxi" in terms and "today" not in terms
    assert not [s for d in range(200, 209) for s in found[d].spans if s.kind == 4]
    assert not [s for d in range(100, 160) for s in found[d].spans]


def test_terms_disclose_anywhere_in_the_document(spark):
    far = "so then we all went home again " * 10
    rows = [(i, f"write to z@zorb.example {far} said Zorbaxi") for i in range(4)]
    rows = [(i, t + f" part{'abcd'[i]}") for i, t in rows] + [(10 + i, f"{far} {'abcdefghij'[i % 10] * (3 + i // 10)}") for i in range(60)]
    for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id]
        terms = {text[s.start:s.stop] for s in r.spans if s.kind == 4}
        assert ("Zorbaxi" in terms) == (r.doc_id < 4) and not terms & {"home", "again", "went"}


def test_a_name_met_once_discloses(spark):
    rows = [(0, "mail to q@q.example from Quixotania please"), (1, "mail from home please")]
    rows += [(2 + i, f"mail from home please {'abcdefghij'[i % 10] * (3 + i // 10)}") for i in range(100)]
    found = {r.doc_id: r for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[0][1][s.start:s.stop] for s in found[0].spans if s.kind == 4] == ["Quixotania"]
    assert not any(found[i].spans for i in range(1, 102))


def plain_terms(texts, threshold=0.8):
    """Terms that disclose, for each text, straight from the definition."""
    prefix = {"email": lambda e: ["@" + e.rsplit("@", 1)[1], e.rsplit("@", 1)[0] + "@"], "ip": lambda e: [e[:e.rindex(".") + 1]]}
    different = sorted(set(texts))
    total = len(different)
    holders, named, own = {}, {}, {}
    for text in different:
        spans = plain_spans(text)
        own[text] = {}
        for s, e, k in spans:
            kind, entity = pii.KINDS[k], text[s:e].lower()
            others = prefix.get(kind, lambda e: [re.sub("[^0-9]", "", e)[:-4]])(entity)
            own[text].setdefault((kind, "", entity), set()).update([(kind, "", entity), *((kind, "part", o) for o in others)])
        for part in set().union(*own[text].values()):
            holders.setdefault(part, set()).add(text)
        named[text] = {}
        for m in regex.finditer(r"\p{L}{3,}", text):
            if not any(s < m.end() and m.start() < e for s, e, _ in spans):
                before = regex.sub(r"[^\S\n]+$", "", text[:m.start()])
                within = before != "" and before[-1] not in ".!?:\n"
                named[text].setdefault(m[0].lower(), []).append((m[0][0].isupper(), within))
    words = {text: {w.lower() for w in regex.findall(r"\p{L}{3,}", text)} for text in different}
    as_name = {t: {w: all(c for c, _ in seen) and any(i for _, i in seen) for w, seen in named[t].items()} for t in different}
    answer = {}
    for text in different:
        answer[text] = set()
        for entity, parts in own[text].items():
            information = math.log2(max(total / len(holders[entity]), 1.0001))
            for part in parts:
                for term in named[text]:
                    n_p, met = len(holders[part]), [t for t in holders[part] if term in named[t]]
                    prior = 1.0 if all(as_name[t][term] for t in met) else total ** (1 - threshold)
                    n_t = max(sum(term in words[t] for t in different), len(met))
                    bits = math.log2((len(met) + prior * n_p / total) / (n_t + prior) * total / n_p)
                    if bits / information >= threshold:
                        answer[text].add(term)
    return answer


def test_terms_are_those_of_the_measure(spark):
    rnd = random.Random(11)
    vocabulary = [a + b for a in ("mor", "Tel", "vis", "Kan", "rud") for b in ("al", "en", "ist", "or", "um", "eska")]
    people = [(f"{n}@{d}.example", n) for n in ("ada", "Bo.K", "cy") for d in ("one", "two")] + [("10.1.2.7", "net"), ("10.1.2.9", "net")]
    texts = []
    for i in range(70):
        line = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))]
        if rnd.random() < 0.4:
            mail, name = rnd.choice(people)
            line[rnd.randrange(len(line)):0] = [mail, f"Xander{name[:2]}" if rnd.random() < 0.7 else "x", "ring +49 170 555 0%03d" % rnd.randint(100, 103)]
        texts.append(rnd.choice(["", "Note. ", "so: "]) + " ".join(line))
    texts += texts[:9] + ["", ""]
    want = plain_terms(texts)
    found = pii.all_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: {texts[r.doc_id][s.start:s.stop].lower() for s in r.spans if s.kind == 4} for r in found}
    assert got == {i: want[t] for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 5 and sum(not x for x in want.values()) > 20


def test_plain_rare_words_beside_an_address_stay(spark):
    rows = [(i, f"note of {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 3} words and user{i}@host{i}.example here") for i in range(90)]
    assert not [s for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if s.kind == 4]


def test_tree_concatenation_is_exact():
    own = tree_bpe.codec(vocabulary_path(tree_bpe.VOCABULARY))
    rnd = random.Random(5)
    units = [
        "a", "the", " the", "ing", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "<|endoftext|>", "<|end", "oftext|>", "1", "23", "!", "...", "é", "漢字",
        "👍🏽", "\t", "\xa0", "\x1c", "z" * 30, "ab" * 20, "!" * 20, "9" * 25, " " * 12,
    ]
    texts = ["".join(rnd.choice(units) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    texts += ["a" * 30_000, "".join(rnd.choice("abcdefghij") for _ in range(30_000)), "!?" * 9_000, " " * 9_000 + "x"]
    for text in texts:
        leaf = rnd.choice([3, 7, 16, 40, 100]) if len(text) < 9_000 else 4_000
        whole = own.concatenate([own.encode(text[k:k + leaf]) for k in range(0, len(text), leaf)])
        ids = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert whole.ids.tolist() == ids and own.decode(whole.ids) == text
        decimal = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.digest(text) == (len(ids), decimal, hashlib.sha256(text.encode()).hexdigest())


def test_tokens_of_odd_rows(docs, no_docs):
    own = tokenizer(vocabulary_path(tree_bpe.VOCABULARY))
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False).encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    got = tree_bpe.encode_documents(docs, leaf=1000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert tree_bpe.encode_documents(no_docs).count() == 0


def test_packing_of_odd_rows(docs, no_docs):
    own = tokenizer(vocabulary_path(packing.VOCABULARY))
    want = []
    for r in docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at:at + 64]
            want.append((r.doc_id, p, at, len(cut), zlib.crc32(array("I", cut).tobytes())))
    got = packing.pack_documents(docs, capacity=64).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("parts", [1, 16, 64])
def test_sequences_hardly_depend_on_the_splits(spark, parts):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").repartition(parts, "doc_id")
    got = packing.pack_documents(docs).collect()
    least = -(-sum(r.length for r in got) // packing.CAPACITY)
    assert least <= len({r.sequence_id for r in got}) <= 1.01 * least
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= packing.CAPACITY


def plain_best_fit(lengths, capacity, most):
    """Each item to the open bin with the least sufficient space, found by looking at all of them."""
    open_bins, placed, begun = {}, [], 0
    for n in lengths:
        fitting = [free for free in open_bins.values() if free >= n]
        if fitting:
            number = max(b for b, free in open_bins.items() if free == min(fitting))
        else:
            if len(open_bins) >= most:
                fullest = min(open_bins.values())
                del open_bins[max(b for b, free in open_bins.items() if free == fullest)]
            number, open_bins[begun], begun = begun, capacity, begun + 1
        placed.append(open_bins[number])
        open_bins[number] -= n
        if not open_bins[number]:
            del open_bins[number]
    return placed, begun


def test_best_fit_against_a_plain_search():
    rnd = random.Random(2)
    for most in (1, 3, 10, 1000):
        for _ in range(30):
            lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 120))]
            bins = packing.OpenBins(50, most)
            got = [50 - bins.place(n)[1] for n in lengths]
            assert (got, bins.begun) == plain_best_fit(lengths, 50, most)


def test_bins_that_the_bound_closed_are_packed_again(spark):
    rows = [(n, 0, 0, n, 0) for n in (9, 8, 7, 6, 4, 3, 2, 1)]
    pieces = spark.createDataFrame(rows, packing._PIECES).repartition(8, "doc_id")
    first = packing.stored(packing.best_fit(pieces, 10, 1))
    packed = packing.pack_loose_again(first, 10, 8)
    assert packed.select("sequence_id").distinct().count() == 4
    assert sorted(tuple(r)[:5] for r in packed.collect()) == sorted(rows)
    several = packing.pack_loose_again(first, 10, 8, pieces_per_task=3).collect()
    assert sorted(tuple(r)[:5] for r in several) == sorted(rows)


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (7, 6, 4, 8, 3)] == [(0, 0), (1, 0), (1, 6), (2, 0), (0, 7)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (9, 7, 8, 1, 3, 2)] == [(0, 0), (1, 0), (2, 0), (2, 8), (1, 7), (3, 0)]


def test_run_ids_are_the_tokenizers():
    path = vocabulary_path(packing.VOCABULARY)
    ids_of_run, own, rnd = packing._run_ids(path), tokenizer(path), random.Random(1)
    letters = "abzAZ019'’!<|>.,;:-_ \t\n\x0b\x1c\x1f\x85\xa0　éÉßÿ×÷ªºµÀàœŒİıſﬁ漢字👍🏽́‍"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        got = array("I", b"".join(ids_of_run[r] for r in packing._RUNS.findall(text))).tolist()
        assert got == own.encode(text, add_special_tokens=False).ids


def test_pipeline_stages_against_plain_python(spark):
    import corpus_pipeline
    from test_near_copies import plain
    from test_rules_and_copies import plain_measures

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema).coalesce(1)
        assert docs.columns == before.columns
        step[name] = docs.collect()
    judged = [r for r in step["quality_rules"]]
    assert all((m := plain_measures(r.text))[0] >= 20 and 100 * m[4] <= 30 * m[0] for r in judged)
    norm = {}
    for r in judged:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        norm[key] = min(norm.get(key, r.doc_id), r.doc_id)
    assert sorted(norm.values()) == sorted(r.doc_id for r in step["exact_dedup"])
    near = {c for _, _, c in plain([(r.doc_id, r.text) for r in step["exact_dedup"]], 5, 80)}
    assert near == {r.doc_id for r in step["ngram_jaccard_join"]}
    assert {r.doc_id for r in step["pii"]} == near and all(r.n_chars == len(r.text) for r in step["pii"])
    assert not any(plain_spans(r.text) for r in step["pii"])
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.collect()} == near
