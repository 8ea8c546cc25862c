"""Operator 4: secret scan with guess costs of credential values.

Fixed patterns give the base spans.  The method adds spans of kind ``guess``:
the value that follows a credential word, or stands in a URL as a password, is
cut into words, dates, repeats, sequences, keyboard walks and brute-force
characters at minimum cost, by dynamic programming over its characters.  The
cost is the decimal logarithm of the guesses an attacker needs who tries such
segments in the order of their likelihood.  A value of at least ``STRONG`` is a
secret; placeholders, words and simple walks stay below.  A value that opens with
a quote goes to the matching quote on its line, one without to the next delimiter.

Words are ranked by their frequency in the corpus itself, counted over all
documents by Spark; the ``RANKS`` most frequent are shipped to the tasks.  They
stand behind a short list of words common in passwords.
"""

from __future__ import annotations

import re
from math import log10

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecohort.llm import text as X

KINDS = ("assign", "access", "hex", "guess")
STRONG = 10.0
LEAST = 8  # characters of a value that is judged
RANKS = 10_000
LONGEST_WORD = 20
PERIODS = 9  # repeated blocks have fewer characters
WALK = 32  # keys of one walk; a longer one is several
KEPT_COSTS = 20_000

# Fixed patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CREDENTIAL = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth"
CONTEXT = re.compile(
    rf"""(?ai:{CREDENTIAL})["']?"""
    r"""(?:\x20*(?:=>|:=|[:=])\x20*|\x20(?ai:is)\x20)(?:(["'])([^\n\r]+?)(?:(?<!\\)|(?<=\\\\))\1|["']?([^\s"',;<>]+))""")
URL = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s/@]+)@")
# Every span of a text contains this or follows it; Arrow finds it in the texts of a batch in one linear pass each.
HINT = rf"""(?i:(?:{CREDENTIAL})["']?(?: *[:=]| is ))|://|AKIA|[0-9a-f]{{16}}"""
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")

# Fixed list: words common in passwords and placeholders, roughly by frequency.
COMMON = """password admin root user test guest welcome login secret letmein changeme default example sample demo
master monkey dragon sunshine princess football baseball shadow superman iloveyou trustno love pass access hello
summer winter spring autumn server system secure security private public token temp none null empty value your
here todo replace placeholder dummy fake""".split()
# Fixed rows of the keyboard; a key's neighbours are next to it in its row or near it in the rows above and below.
ROWS = ("`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./")
LEET = str.maketrans("4@31!05$7", "aaeiiosst")


def _neighbours() -> dict[str, str]:
    place = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != "\t"}
    return {c: "".join(d for d, (r2, k2) in place.items() if d != c and abs(r - r2) <= 1 and abs(k - k2) <= 1) for c, (r, k) in place.items()}


NEAR = _neighbours()
CLASS = {**{c: log10(10) for c in "0123456789"}, **{c: log10(26) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}}


def _brute(c: str) -> float:
    return CLASS.get(c, log10(33) if c.isascii() else 2.0)


def ranks(words: list[str]) -> dict[str, int]:
    """Rank from 1 of the common words, then of ``words`` in their order."""
    return {w: k for k, w in reversed(list(enumerate([*COMMON, *words], 1)))}


def guess_cost(value: str, rank: dict[str, int]) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of guesses, cheapest segments as (kind, start, end)) of a value; the empty value costs 0."""
    n = len(value)
    lower = value.lower()
    plain = lower.translate(LEET) if len(lower) == n else lower
    if len(lower) != n:  # lower case of another length would shift positions
        lower = plain = value
    best: list[float] = [0.0] + [float("inf")] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    joint = log10(2)  # every further segment at least doubles the orders to try

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        total = best[i] + cost + (joint if i and not (kind == "brute" and back[i][0] == "brute") else 0)
        if total < best[j]:
            best[j], back[j] = total, (kind, i)

    # same[size][i]: characters from i on that recur ``size`` places later.
    same = [[0] * (n + 1) for _ in range(PERIODS)]
    for size in range(1, PERIODS):
        for i in range(n - size - 1, -1, -1):
            same[size][i] = same[size][i + 1] + 1 if value[i] == value[i + size] else 0

    for i in range(n):
        offer("brute", i, i + 1, _brute(value[i]))
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            k = rank.get(lower[i:j])
            odd = 0.0
            if k is None:
                k = rank.get(plain[i:j])
                odd = log10(2)
            if k is not None:
                upper = sum(c.isupper() for c in value[i:j])
                case = 0.0 if not upper else log10(2) if upper == j - i or (upper == 1 and value[i].isupper()) else (j - i) * log10(2)
                offer("word", i, j, log10(k) + odd + case)
        if value[i].isdigit():
            for pattern, cost in ((DATE, log10(365 * 130 * 3)), (YEAR, log10(130))):
                m = pattern.match(value, i)
                if m:
                    offer("date", i, m.end(), cost)
        for size in range(1, PERIODS):
            times = 1 + same[size][i] // size
            if times > 2 or size > 1 and times > 1:
                offer("repeat", i, i + times * size, sum(map(_brute, value[i : i + size])) + log10(times))
        if i + 2 < n:
            step = ord(lower[i + 1]) - ord(lower[i])
            if step in (1, -1) and value[i].isalnum():
                j = i + 2
                while j < n and ord(lower[j]) - ord(lower[j - 1]) == step:
                    j += 1
                if j - i >= 3:
                    offer("sequence", i, j, _brute(value[i]) + log10(2 * (j - i)))
        j, turns, last = i + 1, 0, None
        while j < min(n, i + WALK) and lower[j] in NEAR.get(lower[j - 1], ""):
            move = ord(lower[j]) - ord(lower[j - 1])
            row = next(r for r in range(4) if lower[j] in ROWS[r]) - next(r for r in range(4) if lower[j - 1] in ROWS[r])
            way = (row, 0 if row else ROWS[[lower[j] in r for r in ROWS].index(True)].index(lower[j]) - ROWS[[lower[j] in r for r in ROWS].index(True)].index(lower[j - 1]))
            turns += way != last
            last = way
            j += 1
            if j - i >= 4 and move:
                offer("walk", i, j, log10(47) + turns * log10(4.6) + log10(j - i))
    parts, j = [], n
    while j:
        kind, i = back[j]
        if parts and kind == parts[-1][0] == "brute":
            parts[-1] = (kind, i, parts[-1][2])
        else:
            parts.append((kind, i, j))
        j = i
    return best[n], parts[::-1]


def spans(text: str, cost) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guesses) by start, then kind; ``cost``: value -> log10 of guesses."""
    found: set[tuple[int, int, int, float | None]] = set()
    judged = {}
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                found.add((m.start(), 0, m.end(), None))
        if "://" in text:
            judged.update((m.span(1), m[1]) for m in URL.finditer(text))
    whole, at = set(), 0
    while m := CONTEXT.search(text, at):
        k = 2 if m[1] else 3
        judged[m.span(k)] = m[k]
        at = m.start(k)  # a stray quote can hide a further credential
        if m[1]:
            whole.add(m.span(k))
    if "AKIA" in text:
        found.update((m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18)
    found.update((m.start(), 2, m.end(), None) for m in HEX.finditer(text))
    past = 0
    for (a, z), value in sorted(judged.items()):
        while (a, z) not in whole and value and value[-1] in ".:!?)]}":  # closes the sentence and not the value
            value = value[:-1]
        if a >= past and len(value) >= LEAST and (c := cost(value)) >= STRONG:
            found.add((a, 3, a + len(value), round(c, 3)))
            past = a + len(value)
    return [(KINDS[k], a, z, c) for a, k, z, c in sorted(found, key=lambda x: x[:3])]


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = RANKS) -> list[str]:
    """The ``size`` most frequent words of 3 to 20 letters (a to z) in all texts, ties by word."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+")).alias("w"))
    counted = words.filter(F.length("w").between(3, LONGEST_WORD)).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(size).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end, guesses>>) of every row, in code points, end exclusive.

    ``words``: the ranked vocabulary; by default that of ``docs``.  A null or
    empty text has no span; repeated rows and null ids are kept.  Spans of one
    kind don't overlap; spans of different kinds may.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary(docs, text_col) if words is None else words))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())])

    def run(batches):
        rank, known = shipped.value, {}

        def cost(value: str) -> float:
            if value not in known:
                if len(known) >= KEPT_COSTS:
                    known.clear()
                known[value] = guess_cost(value, rank)[0]
            return known[value]

        for b in batches:
            texts = X.plain(b.column(1))
            hints = pc.match_substring_regex(texts, HINT).to_pylist()
            found = [[dict(zip(("kind", "start", "end", "guesses"), s)) for s in spans(t.as_py(), cost)] if h else [] for t, h in zip(texts, hints)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], [id_col, "spans"])

    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,guesses:double>>"
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
