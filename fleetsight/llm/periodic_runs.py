"""Periodic runs of words: maximal stretches whose words come again after each period.

A suffix automaton of the words has one state for all stretches with the same ends, and the states of
the stretches that end at word i are a path to the root of its link tree. Each state on the path bears
where it ended last. Appending word i recolours that path: link-cut access walks it as few segments of
one colour (O(log n) amortised), each with the longest stretch that ended at its last place e. Where
that is at least the distance i - e, the i - e words before e + 1 are those up to i: a square. Squares are extended
to both sides as far as words a period apart are equal, and squares within a known run of their period are passed over.
In a run of period q every place from its second period on finds the distance q, so none is missed.

Runs of a length of ``LEAST`` words and ``POWER`` periods are reported. Every trigram in such a run occurs at
least three times in it (``POWER - 1`` at these limits), so words that no such trigram covers part the text into
pieces that no run crosses, and each piece of ``LEAST`` words has an automaton of its own. Ordinary text has few.

Rows are independent: one pass, no shuffle; a task holds one batch and the automaton of one piece,
which is proportional to the piece. Defined results: null and empty texts have no words and no runs;
a null doc_id plants nothing; repeated rows get a row each, an empty table none. Of runs over the same
stretch that of the smallest period is the run. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetsight.llm.common import bind, trimmed, words_of

#: A run has at least so many words and so many periods.
LEAST, POWER = 6, 4
_ROWS = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

Run = tuple[int, int, int]  # start, length, period


class SuffixAutomaton:
    """Of a list of words: for every state its suffix link and longest stretch, for every prefix its state."""

    def __init__(self, words: list):
        self.link, self.longest, self.prefix = [-1], [0], []
        steps: list[dict] = [{}]
        link, longest = self.link, self.longest
        last = 0
        for word in words:
            new = len(link)
            link.append(0)
            longest.append(longest[last] + 1)
            steps.append({})
            state = last
            while state >= 0 and word not in steps[state]:
                steps[state][word] = new
                state = link[state]
            if state >= 0:
                following = steps[state][word]
                if longest[following] == longest[state] + 1:
                    link[new] = following
                else:
                    clone = len(link)
                    link.append(link[following])
                    longest.append(longest[state] + 1)
                    steps.append(steps[following].copy())
                    link[following] = link[new] = clone
                    while state >= 0 and steps[state].get(word) == following:
                        steps[state][word] = clone
                        state = link[state]
            self.prefix.append(new)
            last = new


class LastEnds:
    """Where each state's stretches ended last, as the colours of paths in the link tree.

    A path of one colour is a splay tree by depth whose root bears the colour; the root's parent is the
    state that the path hangs from.
    """

    def __init__(self, automaton: SuffixAutomaton):
        states = len(automaton.link)
        self.above, self.longest = list(automaton.link), automaton.longest
        self.left, self.right, self.colour = [-1] * states, [-1] * states, [-1] * states

    def _rotate(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        parent = above[x]
        top = above[parent]
        if left[parent] == x:
            inner = left[parent] = right[x]
            right[x] = parent
        else:
            inner = right[parent] = left[x]
            left[x] = parent
        if inner >= 0:
            above[inner] = parent
        if top >= 0 and left[top] == parent:
            left[top] = x
        elif top >= 0 and right[top] == parent:
            right[top] = x
        else:
            self.colour[x] = self.colour[parent]
        above[parent], above[x] = x, top

    def _splay(self, x: int) -> None:
        above, left, right = self.above, self.left, self.right
        while (parent := above[x]) >= 0 and (left[parent] == x or right[parent] == x):
            top = above[parent]
            if top >= 0 and (left[top] == parent or right[top] == parent):
                self._rotate(parent if (left[top] == parent) == (left[parent] == x) else x)
            self._rotate(x)

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """Colours the path from ``state`` to the root with ``end``; old colour and longest stretch of each segment."""
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            yield self.colour[x], self.longest[x]
            deeper = self.right[x]
            if deeper >= 0:
                self.colour[deeper] = self.colour[x]
            self.right[x], self.colour[x] = below, end
            below, x = x, self.above[x]
        self._splay(state)


def runs_of_piece(words: list, least: int = LEAST, power: int = POWER) -> list[Run]:
    """All runs of a list of words by its automaton."""
    automaton = SuffixAutomaton(words)
    ends = LastEnds(automaton)
    reached: dict[int, int] = {}  # by period, the last word of its latest run
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(automaton.prefix):
        for end, longest in ends.access(state, i):
            period = i - end
            if end < 0 or period > longest or reached.get(period, -1) >= i:
                continue
            last, start = i + 1, i - 2 * period + 1
            while last < len(words) and words[last] == words[last - period]:
                last += 1
            while start > 0 and words[start - 1] == words[start - 1 + period]:
                start -= 1
            reached[period] = last - 1
            if last - start >= max(least, power * period):
                key = start, last - start
                found[key] = min(period, found.get(key, period))
    return [(start, length, period) for (start, length), period in found.items()]


def pieces(words: list, least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches that may hold runs; no run reaches beyond one."""
    times = min(power - 1, least - 2)
    waiting = [(0, len(words))]
    while waiting:
        begin, end = waiting.pop()
        if end - begin < least:
            continue
        counts = Counter(zip(words[begin:end], words[begin + 1:end], words[begin + 2:end]))
        if max(counts.values()) < times:
            continue
        parts, covered_to = [], begin
        for i, trigram in enumerate(zip(words[begin:end], words[begin + 1:end], words[begin + 2:end]), begin):
            if counts[trigram] >= times:
                if i >= covered_to or not parts:
                    parts.append([i, i + 3])
                else:
                    parts[-1][1] = i + 3
                covered_to = i + 3
        if parts == [[begin, end]]:
            yield begin, end
        else:
            waiting += map(tuple, parts)


def find_runs(words: list, least: int = LEAST, power: int = POWER) -> list[Run]:
    """(start, length, period) of all runs, by start, then period; ``least`` is 5 or more, ``power`` 3 or more."""
    found = []
    for begin, end in pieces(words, least, power):
        found += [(begin + start, length, period) for start, length, period in runs_of_piece(words[begin:end], least, power)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that a run repeats after its first period."""
    kept, dropped_to = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[dropped_to:begin]
        dropped_to = max(dropped_to, end)
    return kept + words[dropped_to:]


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            counts, runs, texts = [], [], []
            for text in part.column(1).to_pylist():
                words = _WORD.findall(text or "")
                numbers: dict[str, int] = {}
                own = find_runs([numbers.setdefault(w, len(numbers)) for w in words])
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(" ".join(collapse(words, own) if own else words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed text of every row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: a document in ten, by the checksum of its id, repeats its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = words_of(F.col("text")), F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))

        def at(i: Column) -> Column:
            return F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at), " ")

    chosen = (F.pmod(h, F.lit(10)) == 0) & (trimmed(F.col("text")) != "")
    return docs.select("doc_id", F.when(chosen, bind(words, repeated)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``periodic_runs``."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")
    )))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = """list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'),
      lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
  )"""

ORACLE_SQL = f"""
WITH given AS (
  SELECT doc_id, xor({_CRC}, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sizes AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM sizes
),
words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM texts),
grams AS (
  SELECT doc_id, n, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS gram FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
again AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
  FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND (b.i - a.i) * {POWER} <= a.n
),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS m FROM again GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM stretches WHERE m >= greatest({LEAST}, {POWER} * q) GROUP BY doc_id, s, m),
best AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256,
    min({{'less': -m, 'start': s, 'period': q, 'length': m}}) AS b
  FROM runs GROUP BY doc_id
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (
  SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
  1000 * b.length // b.period AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed, sha256('')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
