"""Operator 3, secret scans: fixed patterns, and the guess cost of values in a credential context.

The guess cost of a value is the least log10 number of guesses over all ways to cut it into words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming. A value that stands after a credential name and is
dear to guess is a secret even if it is too short for the patterns.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from shelfwise.llm import textbytes as tb

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")

#: The base patterns.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of a maximal run, as [0-9a-f]+ finds it
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: A credential name, and the value after it: up to white space, a quote, a comma or a semicolon.
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)"""
                     r"""["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"',;]{6,})""", re.ASCII)
#: The longest name with the sign after it.
_NAME_CHARS = len("private_key:")
#: Texts without one of these names have no match of ASSIGN or CONTEXT.
_NAMES = r"(?i)pass|pwd|secret|token|key|credential"

#: Letters with a capital at most, and full stops and the like after them, are taken for a word of the text.
_LETTERS = re.compile(r"[^\W\d_][^\W\d_A-Z]*[.!?:)\]]*")

#: log10 of the guesses from which a value in a credential context is a secret.
MIN_COST = 9.0

#: Words in the order in which a guesser tries them.
WORDS = ("password pass admin root user login welcome letmein secret token test guest default master changeme hello "
         "monkey dragon sunshine princess football baseball shadow superman batman michael jordan charlie love iloveyou "
         "trustno one two three demo example sample dummy null none true false empty placeholder your my the key api "
         "value string name here some foo bar baz qwerty abc server data base database prod production dev local host "
         "summer winter spring autumn january february march april may june july august september october november "
         "december monday tuesday friday sunday").split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))

#: Rows along which keyboard walks and sequences run.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT: dict[str, set[str]] = {}
for _row in _ROWS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)

_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)"
                   r"|(?:19|20)\d\d", re.ASCII)
_DATE_COST, _YEAR_COST = log10(365 * 120), log10(120)
_WALK_START = log10(47 * 4)
_CUT = log10(2)  # for every segment after the first: where it begins has to be guessed too


def _alphabet(c: str) -> float:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def guess_cost(value: str) -> float:
    """The least log10 number of guesses over all segmentations; 0 for an empty value. Linear in the length."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    best = [0.0] + [float("inf")] * n
    runs_end = [0] * n  # how far a run of one character goes from here
    walk_end = [0] * n  # and a walk along a row in one direction
    for i in range(n - 1, -1, -1):
        runs_end[i] = runs_end[i + 1] if i + 1 < n and value[i + 1] == value[i] else i + 1
    i = 0
    while i < n:
        j = i + 1
        while j < n and low[j] in _NEXT.get(low[j - 1], ()) and (j - i < 2 or low[j] != low[j - 2]):
            j += 1
        for k in range(i, j):
            walk_end[k] = j
        i = j if j - i < 2 else j - 1 if j < n else j
    repeats = {period: [0] * (n + 1) for period in (2, 3, 4)}  # how many characters from here equal those a period on
    for period, same in repeats.items():
        for i in range(n - period - 1, -1, -1):
            same[i] = same[i + 1] + 1 if value[i] == value[i + period] else 0
    spelled = [0.0]
    for c in value:
        spelled.append(spelled[-1] + log10(_alphabet(c)))
    # a brute-force span costs the sum over its characters, so the cheapest start of one is kept as it goes
    brute = float("inf")
    for i in range(n):
        here = best[i] + (_CUT if i else 0)
        brute = min(brute, here - spelled[i])
        best[i + 1] = min(best[i + 1], brute + spelled[i + 1])
        for j in range(i + 2, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j])
            if rank:
                capital = 0 if value[i:j] == low[i:j] else _CUT if value[i + 1:j] == low[i + 1:j] else 2 * _CUT
                best[j] = min(best[j], here + log10(rank) + capital)
        date = _DATE.match(value, i)
        if date:
            best[date.end()] = min(best[date.end()], here + (_YEAR_COST if date.end() - i == 4 else _DATE_COST))
        j = runs_end[i]
        if j - i >= 3:
            best[j] = min(best[j], here + log10(_alphabet(value[i]) * (j - i)))
        for period, same in repeats.items():
            times = same[i] // period + 1
            if times > 1:
                j = i + times * period
                best[j] = min(best[j], here + spelled[i + period] - spelled[i] + log10(times))
        j = walk_end[i]
        if j - i >= 3:
            best[j] = min(best[j], here + _WALK_START + log10(j - i))
    return best[n]


def find_secrets(text: str, named: bool = True, access: bool = True, hexadecimal: bool = True
                 ) -> list[tuple[int, int, int, float | None]]:
    """(start, end, place of the kind in KINDS, guess cost of the value), sorted. The flags say which patterns can match."""
    spans = []
    if named:
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= MIN_ASSIGN:
                spans.append((m.start(), m.end(), 0, guess_cost(m[1])))
    if access:
        spans += [(m.start(), m.end(), 1, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexadecimal:
        spans += [(m.start(), m.end(), 2, None) for m in HEX.finditer(text)]
    if named:
        base = sorted((a, b) for a, b, _, _ in spans)
        ends = np.maximum.accumulate([b for _, b in base]).tolist() if base else []
        starts = [a for a, _ in base]
        m = CONTEXT.search(text)
        while m:
            a, b = m.span(1)
            k = bisect_right(starts, b - 1)
            # a base span may have it
            cost = 0.0 if k and ends[k - 1] > a or _LETTERS.fullmatch(m[1]) else guess_cost(m[1])
            if cost >= MIN_COST:
                spans.append((a, b, 3, cost))
            # a value that is none can end in the name of the next one
            m = CONTEXT.search(text, b if cost >= MIN_COST else max(a, b - _NAME_CHARS))
    return sorted(spans, key=lambda s: s[:3])


_SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long").add("cost", "double")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then secrets: array<struct<kind,start,end,cost>>, by start and then kind as in KINDS.

    Spans are in code points, end exclusive. Base kinds are whole matches of their pattern, leftmost and not overlapping
    within their kind: assign, access, hex. guess is the value after a credential name whose guess cost reaches MIN_COST,
    where no base span overlaps it. cost is the guess cost of the value for assign and guess, null for the others. A null
    or empty text has no spans. Whole texts are scanned, whatever their length; repeated rows get equal spans. A column
    of ``docs`` named secrets is replaced.
    """
    docs = docs.drop("secrets")
    columns = docs.columns
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, text, 4 << 20):
            column = pc.fill_null(piece.column(text), "")
            flags = [pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False).tolist()
                     for p in (_NAMES, "AKIA", "[0-9a-f]{16}")]
            out = [[{"kind": KINDS[k], "start": a, "end": b, "cost": cost} for a, b, k, cost in find_secrets(t.as_py(), *f)]
                   if any(f) else [] for t, *f in zip(column, *flags, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(out, pa.list_(kind))],
                                             names=[*columns, "secrets"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("secrets", ArrayType(_SPAN))]))
