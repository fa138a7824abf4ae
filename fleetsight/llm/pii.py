"""Personal data, and terms that reveal it by their information content.

Base kinds are patterns of fixed form: mail and network addresses, card and phone numbers. They are the
protected entities. Beside them, terms that co-occur with an entity can reveal it once it is gone. With
counts over the N different texts of the corpus, the pointwise mutual information of a term and an entity,

    PMI(t; e) = log2( p(e | t) / p(e) ),  p(e | t) = (n(t, e) + c * n(e) / N) / (n(t) + c),

is the part of the entity's information IC(e) = log2(N / n(e)) that the term discloses. Terms that
disclose at least a threshold share of it are added as spans of kind ``term`` wherever they stand in
a document that holds the entity. Counts are of whole documents; equal texts count once, near copies
each for itself.

The prior c is texts at chance level. Any rare word meets the entities of its only document, so for
plain words c = N ** (1 - threshold), which leaves a single meeting just short of the threshold in a
corpus of any size; two meetings of a word that is met nowhere else are enough. Names, words that
a document writes with a capital within its sentences and never without, have c = 1: one that is met
nowhere else discloses an entity even by a single meeting. Where plain words could disclose nothing,
because they met too few texts at most, only meetings as a name count.

Where an entity is rare, its parts are assessed as well: the domain and the local part of a mail
address, the leading numbers of the other kinds. PMI(t; part) is information about the entity too, so it
is set against IC(e), and meetings with all entities that share the part prove it.

Passes. The first finds base spans. Of documents with an entity or part that any term could disclose,
the second stores the terms. Those that meet it often enough to disclose it, if they stand nowhere else,
are counted over all documents by the third. Everything is aggregated before a shuffle or split by
Spark's joins; the driver sees no data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import broadcast_within, numbered, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Texts at chance level that count beside those with a name.
NAME_PRIOR = 1.0
#: Share of an entity's information that a term may not disclose.
DISCLOSURE = 0.8
#: Share from which on a term is removed; below, a general word stands for it.
REMOVE_FROM = 0.95
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
_TERM_KIND = len(KINDS)
_ROWS = 512
#: Bytes up to which row numbers and terms are broadcast, so that whole texts need no shuffle.
BROADCAST_BYTES = 16 << 20
_ROW_BYTES = 16
_TERM_BYTES = 48
_SPAN_BYTES = 48
#: Last digits of a card or phone number that are no part of its prefix.
_OWN_DIGITS = 4

# Fixed forms. All run in one pass: what repeats is possessive, or starts at an anchor that occurs once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = regex.compile(r"\p{L}{3,}")
_DIGITS = re.compile(r"[^0-9]+")
_SENTENCE_ENDS = frozenset(".!?:\n")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches at each @: the local part reaches back to the end of the match before at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            free = domain.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind), by start and then kind; offsets in code points, end exclusive."""
    spans = [(s, e, 0) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0")[:3] or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda x: (x[0], x[2]))


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Terms of the whole text that overlap none of ``spans``, which are in order."""
    near, covered = 0, 0
    for m in _TERM.finditer(text):
        while near < len(spans) and spans[near][0] < m.end():
            covered = max(covered, spans[near][1])
            near += 1
        if covered <= m.start():
            yield m.start(), m.end()


def _parts(kind: int, entity: str) -> list[str]:
    """An entity and what it shares with others: domain, local part, leading numbers."""
    name = KINDS[kind]
    whole = f"{name}:{entity}"
    if kind == 0:
        local, domain = entity.rsplit("@", 1)
        return [whole, f"{name}:@{domain}", f"{name}:{local}@"]
    if kind == 1:
        return [whole, f"{name}:{entity.rsplit('.', 1)[0]}."]
    return [whole, f"{name} prefix:{_DIGITS.sub('', entity)[:-_OWN_DIGITS]}"]


_FOUND = "row long, doc_id long, copy binary, spans array<struct<start:int,stop:int,kind:int>>, clues array<struct<entity:string,part:string>>"


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and the different parts of their entities; ``copy`` is the identity of the text."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32())]))
    clue = pa.list_(pa.struct([("entity", pa.string()), ("part", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            copies, spans, clues = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                copies.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                spans.append([{"start": s, "stop": e, "kind": k} for s, e, k in base])
                entities = dict.fromkeys((k, text[s:e].lower()) for s, e, k in base)
                clues.append([{"entity": p[0], "part": q} for p in (_parts(*e) for e in entities) for q in p])
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(copies, pa.binary()), pa.array(spans, span), pa.array(clues, clue)],
                names=["row", "doc_id", "copy", "spans", "clues"],
            )


_TERMS = "row long, term string, name boolean, places array<struct<start:int,stop:int>>"


def document_terms(text: str) -> dict[str, tuple[bool, list[tuple[int, int]]]]:
    """Terms of a text outside base spans, lower-cased: whether it is written as a name, and its places."""
    found: dict[str, list] = {}
    for start, stop in _terms(text, base_spans(text)):
        before = start
        while before and text[before - 1].isspace() and text[before - 1] != "\n":
            before -= 1
        begins = before == 0 or text[before - 1] in _SENTENCE_ENDS
        own = found.setdefault(text[start:stop].lower(), [True, False, []])
        own[0] &= text[start].isupper()
        own[1] |= not begins
        own[2].append((start, stop))
    return {term: (capital and within, places) for term, (capital, within, places) in found.items()}


def _terms_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of documents; of those not ``plain`` only names, as no other can disclose anything there."""
    place = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("row", "text", "plain"))
        for row, text, plain in zip(*columns):
            kept = [(t, name, at) for t, (name, at) in document_terms(text or "").items() if plain or name]
            if not kept:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row] * len(kept), pa.int64()), pa.array([t for t, _, _ in kept], pa.string()),
                    pa.array([name for _, name, _ in kept], pa.bool_()),
                    pa.array([[{"start": s, "stop": e} for s, e in at] for _, _, at in kept], place),
                ],
                names=["row", "term", "name", "places"],
            )


def find_spans(base: DataFrame) -> DataFrame:
    """row, doc_id, identity of the text, base spans and clues, for each of the numbered documents."""
    return stored(texts_of(base).mapInArrow(_found, _FOUND))


def _bits(n_tp: Column, n_t: Column, n_p: Column, prior: Column, total: int) -> Column:
    """Information that a term discloses; grows with n_tp. A term counts at least as often as it meets the part."""
    by_term = (n_tp + prior * n_p / total) / (F.greatest(n_t, n_tp) + prior)
    return F.log2(by_term * total / n_p)


def _bits_of(n_e: Column, total: int) -> Column:
    return F.log2(F.greatest(total / n_e, F.lit(1.0001)))


def _known_parts(found: DataFrame, firsts: DataFrame, total: int, disclosure: float) -> DataFrame:
    """Parts in each row that some term could disclose, as 64-bit hashes.

    With texts that hold it (n_p), with those of the most frequent entity there that has it (n_e), whether
    the row ``counts`` (is the first of its copies), and whether a ``plain`` word could disclose it.
    """
    held = stored(
        found.where(F.size("clues") > 0).join(firsts, F.col("row") == F.col("first"), "left")
        .select("row", F.col("first").isNotNull().alias("counts"), F.explode("clues").alias("c")).select("row", "counts", "c.entity", "c.part")
    )
    sizes = stored(
        held.where("counts").select("row", "part").distinct().groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    )
    both = (
        held.join(sizes.withColumnRenamed("n", "n_p"), F.col("part") == F.col("p")).drop("p")
        .join(sizes.withColumnRenamed("n", "n_e"), F.col("entity") == F.col("p"))
        # Parts that no other text holds are met by the same terms, those of their text: one stands for all.
        .groupBy("row", "counts", F.when(F.col("n_p") > 1, F.col("part")).alias("shared"))
        .agg(F.min(F.xxhash64("part")).alias("part"), F.first("n_p").alias("n_p"), F.max("n_e").alias("n_e")).drop("shared")
    )
    n_p, need = F.col("n_p"), disclosure * _bits_of(F.col("n_e"), total)
    return stored(
        both.withColumn("plain", _bits(n_p, n_p, n_p, F.lit(_plain_prior(total, disclosure)), total) >= need)
        .where(F.col("plain") | (_bits(n_p, n_p, n_p, F.lit(NAME_PRIOR), total) >= need))
    )


def _plain_prior(total: int, disclosure: float) -> float:
    return float(total) ** (1 - disclosure)


def disclosing_terms(base: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(row, term, places, share): terms of a row that disclose at least ``disclosure`` of an entity in it, and the most they do."""
    firsts = stored(found.groupBy("copy").agg(F.min("row").alias("first")).select("first"))
    total = max(firsts.count(), 1)
    known = _known_parts(found, firsts, total, disclosure)
    rows = stored(known.groupBy("row").agg(F.bool_or("plain").alias("plain")))
    wanted = texts_of(base).join(broadcast_within(rows, _ROW_BYTES, BROADCAST_BYTES), "row").select("row", "text", "plain")
    terms = stored(wanted.mapInArrow(_terms_in, _TERMS))

    prior = F.when(F.col("name"), F.lit(NAME_PRIOR)).otherwise(F.lit(_plain_prior(total, disclosure)))
    need = disclosure * _bits_of(F.col("n_e"), total)
    met = terms.join(known, "row").where(F.col("name") | F.col("plain"))
    n_tp, n_p = F.col("n_tp"), F.col("n_p")
    counted = met.where("counts").select("part", "term", "name", "n_p", "n_e")
    alone = counted.where("n_p = 1").withColumn("n_tp", F.lit(1).cast("long"))  # met in one text, so no need to count
    often = counted.where("n_p > 1").groupBy("part", "term").agg(
        F.bool_and("name").alias("name"), F.first("n_p").alias("n_p"), F.max("n_e").alias("n_e"), F.count(F.lit(1)).alias("n_tp")
    )
    likely = stored(alone.unionByName(often).where(_bits(n_tp, n_tp, n_p, prior, total) >= need))
    by_word = _counted(base, found, firsts, stored(likely.select("term").distinct()))
    telling = stored(
        likely.join(by_word, F.col("term") == F.col("w"), "left")
        .withColumn("bits", _bits(n_tp, F.col("n_t"), n_p, prior, total)).where(F.col("bits") >= need)
        .select(F.col("part").alias("p"), F.col("term").alias("t"), "bits")
    )
    share = F.col("bits") / _bits_of(F.col("n_e"), total)
    # Places travel only with terms that disclose something somewhere.
    said = stored(telling.select(F.col("t").alias("term")).distinct())
    marked = terms.join(F.broadcast(said) if _term_bytes(said) <= BROADCAST_BYTES else said, "term", "left_semi")
    return stored(
        marked.join(known, "row")
        .join(telling, (F.col("part") == F.col("p")) & (F.col("term") == F.col("t")))
        .withColumn("share", share).where(F.col("share") >= disclosure)
        .groupBy("row", "term").agg(F.first("places").alias("places"), F.max("share").alias("share"))
    )


def _term_bytes(terms: DataFrame) -> int:
    return terms.agg(F.sum(F.octet_length("term") + _TERM_BYTES).alias("size")).first()["size"] or 0


def _counted(base: DataFrame, found: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(w, n_t): in how many different texts each of the ``wanted`` terms stands."""
    again = stored(found.select("row").join(firsts, F.col("row") == F.col("first"), "left_anti"))
    once = texts_of(base).join(broadcast_within(again, _ROW_BYTES, BROADCAST_BYTES), "row", "left_anti")
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}]{3,}"), F.lit(0)), F.lower)
    each = once.select(F.explode(F.array_distinct(words)).alias("w"))
    small = _term_bytes(wanted) <= BROADCAST_BYTES
    if small:
        each = each.join(F.broadcast(wanted), F.col("w") == F.col("term"), "left_semi")
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("n_t"))
    return counts if small else counts.join(wanted, F.col("w") == F.col("term"), "left_semi")


def all_spans(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): row, doc_id and spans (start, kind, stop, share), in order.

    Base spans are 0 to 3 by kind and have no share; terms are 4. Null texts count as empty; rows
    with equal or null ids count each for itself; an empty table gives no rows. Very long texts are
    searched whole; each of its terms is one row with all its places. Only doc_id and text are read.
    """
    return _spans(numbered(docs), disclosure)


def _spans(base: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    found = find_spans(base)
    terms = (
        disclosing_terms(base, found, disclosure).select("row", "share", F.explode("places").alias("at"))
        .groupBy("row").agg(F.collect_list(F.struct(
            F.col("at.start").alias("start"), F.lit(_TERM_KIND).alias("kind"), F.col("at.stop").alias("stop"), "share"
        )).alias("more"))  # no more than the terms of one document
    )
    plain = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(None).cast("double").alias("share")
    ))
    return found.join(terms, "row", "left").select(
        "row", "doc_id",
        F.when(F.col("more").isNull(), plain).otherwise(F.array_sort(F.concat(plain, F.coalesce("more", F.array())))).alias("spans"),
    )


def span_digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def _sanitised(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with what their spans mark replaced; null where there are none."""
    texts = []
    for at in range(0, len(text), _ROWS):
        for whole, found in zip(text.slice(at, _ROWS).to_pylist(), spans.slice(at, _ROWS).to_pylist()):
            if whole is None or not found:
                texts.append(None)
                continue
            out, done = [], 0
            for s in found:
                if s["stop"] <= done:
                    continue
                # Where two overlap, what is left of the later one goes with the earlier.
                if s["start"] >= done:
                    out.append(whole[done:s["start"]])
                    if s["kind"] != _TERM_KIND or s["share"] < REMOVE_FROM:
                        out.append(PLACEHOLDERS[s["kind"]])
                done = s["stop"]
            texts.append("".join(out) + whole[done:])
    return pa.array(texts, pa.string())


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all other columns and all rows stay.

    ``n_chars``, where there is such a column, counts the code points of the new text; a null text stays null.
    """
    columns = docs.columns
    whole = numbered(docs)
    spans = stored(_spans(whole, **settings).where(F.size("spans") > 0).select(F.col("row").alias("r"), "spans"))
    size = spans.agg(F.sum(_ROW_BYTES + F.size("spans") * _SPAN_BYTES)).first()[0] or 0
    # The texts meet their spans once, without a shuffle while the spans are few; of texts without one Python sees nothing.
    marked = whole.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, F.col("row") == F.col("r"), "left")
    clean = F.arrow_udf(_sanitised, "string")(F.when(F.col("r").isNotNull(), F.col("whole.text").cast("string")), F.col("spans"))
    replaced = marked.withColumn("clean", clean)
    text = F.when(F.col("r").isNotNull(), F.col("clean")).otherwise(F.col("whole.text"))

    def value(column: str) -> Column:
        if column == "text":
            return text.alias("text")
        if column == "n_chars":
            kind = docs.schema["n_chars"].dataType
            return F.when(F.col("r").isNotNull(), F.char_length("clean").cast(kind)).otherwise(F.col("whole.n_chars")).alias("n_chars")
        return F.col("whole")[column].alias(column)

    return replaced.select(*[value(c) for c in columns])
