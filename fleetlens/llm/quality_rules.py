"""Quality rules, line-first: judge every line, drop the failing ones, then judge what is left.

Line rules, first match names the reason:

* ``repeat``      the line equals an earlier line of the text and has a word
* ``boilerplate`` it carries a stock phrase of web pages (consent, sign-in, rights)
* ``navigation``  at least two menu separators, and one for every four words
* ``symbols``     at least three of ``#*$%&|<>``, and one for every five words
* ``shouting``    five words or more, over half of the ASCII letters capital, or an "!!" for every third word
* ``punctuation`` under five words and no sentence mark anywhere

A text is rejected where its failing lines hold more than ``max_lost`` percent
of the characters in words. Null and empty texts have no words and fail the
base rule. Every text is read whole; memory is bounded by one Arrow batch. Each row is
judged on its own, so equal rows get equal answers, and ids pass through untouched,
whether they are null, large or repeated. An empty table gives an empty table. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN

BOILERPLATE = (
    r"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|click here|read more|sign in|log in"
    r"|subscribe to|enable javascript|accept cookies|share on (?:facebook|twitter)|skip to (?:main )?content|copyright ©"
)
NAVIGATION = r"[|»›·•]"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_MARK = r"[.!?…:;。！？]"
MAX_LOST = 40
WINDOW = 8

_word = re.compile(WORD_PATTERN)
_boiler = re.compile(BOILERPLATE, re.IGNORECASE)
_nav = re.compile(NAVIGATION)
_sym = re.compile(SYMBOLS)
_mark = re.compile(SENTENCE_MARK)
_upper = re.compile(r"[A-Z]")
_lower = re.compile(r"[a-z]")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, lost_chars long, reasons string, clean_text string"
)


def line_reason(line: str, n_words: int, repeated: bool) -> str:
    """The rule that a line with words fails, or ''."""
    if repeated:
        return "repeat"
    if _boiler.search(line):
        return "boilerplate"
    nav = len(_nav.findall(line))
    if nav >= 2 and nav * 4 >= n_words:
        return "navigation"
    sym = len(_sym.findall(line))
    if sym >= 3 and sym * 5 >= n_words:
        return "symbols"
    if n_words >= 5:
        up = len(_upper.findall(line))
        if (up >= 10 and up > len(_lower.findall(line))) or line.count("!!") * 3 >= n_words:
            return "shouting"
    elif not _mark.search(line):
        return "punctuation"
    return ""


def repeated_window_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined, at, starts = " ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s + len(w) for s, w in zip(starts, words, strict=True)]
    keys = [joined[a:b] for a, b in zip(starts, ends[window - 1 :], strict=False)]
    if len(set(keys)) == n:
        return 0
    first: dict[str, int] = {}
    hit = bytearray(n)
    for i, k in enumerate(keys):
        j = first.setdefault(k, i)
        if j != i:
            hit[i] = hit[j] = 1
    total = reach = 0
    for i in range(n):
        if hit[i]:
            total += i + window - max(i, reach)
            reach = i + window
    return total


def assess(text: str | None, max_lost: int = MAX_LOST) -> tuple:
    """All columns of SCHEMA after doc_id for one text."""
    text = text or ""
    words = _word.findall(text)
    seen: set[str] = set()
    kept_lines, reasons, dup, lost, lines = [], {}, 0, 0, 0
    for line in text.split("\n"):
        line_words = _word.findall(line)
        if not line_words:
            kept_lines.append(line)
            continue
        lines += 1
        repeated = line in seen
        seen.add(line)
        dup += repeated
        why = line_reason(line, len(line_words), repeated)
        if why:
            reasons[why] = reasons.get(why, 0) + 1
            lost += sum(map(len, line_words))
        else:
            kept_lines.append(line)
    chars = sum(map(len, words))
    repeat = repeated_window_words(words)
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    return (
        len(words), chars, len(_sym.findall(text)), dup, repeat, failed, not failed and 100 * lost <= max_lost * chars,
        lines, sum(reasons.values()), lost, ",".join(f"{k}:{v}" for k, v in sorted(reasons.items())), "\n".join(kept_lines),
    )


def clean_lines(docs: DataFrame, max_lost: int = MAX_LOST, with_text: bool = True) -> DataFrame:
    """One row per document: counts, verdict, rule counts and, with_text, the text without failing lines.

    Rows never move: the rules are local to a document, so there is no shuffle.
    """
    schema = SCHEMA if with_text else SCHEMA.removesuffix(", clean_text string")
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [assess(t, max_lost) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in judged], kinds[kind]) for k, (_, kind) in enumerate(fields[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [name for name, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: The same measures for DuckDB, from sets of lines and windows.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_PATTERN}') AS ws FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 9)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(CASE WHEN nxt IS NULL THEN 8 ELSE least(8, nxt - i) END) AS rep
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
l0 AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth,
         regexp_extract_all(line, '{WORD_PATTERN}') AS lw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
l1 AS (
  SELECT doc_id, nth, len(lw) AS nw, length(array_to_string(lw, '')) AS ch, line,
         len(regexp_extract_all(line, '{NAVIGATION}')) AS nav, len(regexp_extract_all(line, '{SYMBOLS}')) AS sym,
         len(regexp_extract_all(line, '[A-Z]')) AS up, len(regexp_extract_all(line, '[a-z]')) AS lo,
         len(regexp_extract_all(line, '!!')) AS shout
  FROM l0 WHERE len(lw) > 0),
l2 AS (
  SELECT doc_id, nth, ch,
         CASE WHEN nth > 1 THEN 1 WHEN regexp_matches(line, '(?i){BOILERPLATE}') THEN 1
              WHEN nav >= 2 AND nav * 4 >= nw THEN 1 WHEN sym >= 3 AND sym * 5 >= nw THEN 1
              WHEN nw >= 5 THEN CASE WHEN (up >= 10 AND up > lo) OR shout * 3 >= nw THEN 1 ELSE 0 END
              WHEN NOT regexp_matches(line, '{SENTENCE_MARK}') THEN 1 ELSE 0 END AS bad
  FROM l1),
agg AS (
  SELECT doc_id, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dup, sum(bad) AS bad, count(*) AS lines,
         sum(CASE WHEN bad = 1 THEN ch ELSE 0 END) AS lost FROM l2 GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(rep, 0) AS n_repeat_words, coalesce(lines, 0) AS n_lines, coalesce(bad, 0) AS n_failed_lines,
         coalesce(lost, 0) AS lost_chars
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN agg ON w.doc_id = agg.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars) AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
FROM f
"""
