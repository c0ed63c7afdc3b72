"""Quality rules by line-first cleaning.

Every line is judged on its own (punctuation, navigation, boilerplate), failing lines are taken
out, and a document that loses too much of its text that way is rejected. Repetition inside the
document is a rule of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lagweave.llm._words import find_words, inside_rows, mix, row_blocks, row_sums, utf8, window_hashes

SYMBOLS = b"#*$%&|<>"
TERMINAL = (b".", b"!", b"?", b":", b";", b",", b'"', b"'", b")", b"]", "…".encode(), "”".encode(), "»".encode())
#: Phrases of lines that sites put on every page.
BOILERPLATE = (
    b"all rights reserved", b"licensed under", b"released under", b"terms of service", b"terms of use", b"privacy policy",
    b"cookie policy", b"accept cookies", b"sign up for our newsletter", b"click here", b"general public license", b"creative commons",
)
SHORT_LINE, BOILER_WORDS = 5, 40

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long,"
    " n_lines_removed long, removed_chars long, cleaned string, base_failed boolean, kept boolean"
)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words breaks a rule.

    Punctuation: more than half of the words shout (end in !! or ??), or fewer than five words
    and no closing mark. Navigation: over 0.3 symbols a word. Boilerplate: a stock phrase in a
    line of at most 40 words.
    """
    n = len(words)
    if n < SHORT_LINE and not words[-1].endswith(TERMINAL):
        return True
    if (b"!!" in line or b"??" in line) and 2 * sum(w.endswith((b"!!", b"??")) for w in words) > n:
        return True
    if 10 * (len(line) - len(line.translate(None, SYMBOLS))) > 3 * n:
        return True
    if n <= BOILER_WORDS:
        low = line.lower()  # bytes: A-Z only
        return any(p in low for p in BOILERPLATE)
    return False


def _letters(raw: bytes) -> int:
    """Code points outside white space."""
    return len(b"".join(raw.split()).decode())


def _judge(text: bytes) -> tuple[int, int, int, int, int, int, str]:
    """word_chars, n_symbols, n_dup_lines, n_lines, n_lines_removed, removed_chars, cleaned."""
    seen: set[bytes] = set()
    lines = chars = lost = removed = 0
    keep = []
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            keep.append(line)
            continue
        lines += 1
        seen.add(line)
        size = len(b"".join(words).decode())
        chars += size
        if line_fails(line, words):
            removed += 1
            lost += size
        else:
            keep.append(line)
    return chars, len(text) - len(text.translate(None, SYMBOLS)), lines - len(seen), lines, removed, lost, b"\n".join(keep).decode()


def _repeat_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, its words and those in 5-word windows that the row has twice or more."""
    _, _, hashes, bounds = find_words(data, offsets)
    counts = np.diff(bounds)
    windows = window_hashes(hashes, 5)
    at = np.flatnonzero(inside_rows(bounds, 5, len(windows)))
    row = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)[at]
    _, which, times = np.unique(mix(windows[at] + row * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    cover = np.zeros(len(hashes) + 6, np.int32)
    cover[twice] += 1
    cover[twice + 5] -= 1
    return counts, row_sums(np.cumsum(cover)[: len(hashes)] > 0, bounds)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeat: float = 0.2) -> DataFrame:
    """One row per input row: counts, the cleaned text and the verdict ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat`` of the words in repeated
    5-word windows. ``kept``: not that, and the failing lines hold at most ``max_lost`` of the
    characters in words. A null text counts as empty: zero counts, cleaned '' and not kept. Ids may
    repeat or be null, they are passed on; further columns of ``docs`` are ignored. Rows are judged
    one by one without a shuffle, so hot sources and copies need no care.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in row_blocks(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                words, repeat = _repeat_words(part, at)
                raw = part.tobytes()
                rows = [_judge(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                chars, symbols, dups, lines, removed, lost, cleaned = zip(*rows)
                failed = (words < min_words) | (repeat > max_repeat * words + 1e-9)
                kept = ~failed & (np.array(lost) <= max_lost * np.array(chars) + 1e-9)
                longs = [pa.array(x, pa.int64()) for x in (words, chars, symbols, dups, repeat, lines, removed, lost)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *longs, pa.array(cleaned, pa.string()), pa.array(failed), pa.array(kept)], names=names)

    names = [id_col, *(x.split()[0] for x in SCHEMA.split(","))]
    return docs.select(id_col, text_col).mapInArrow(judge, f"`{id_col}` {kind}, {SCHEMA}")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of every document, with its base counts and verdict."""
    out = clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "removed_chars")


_PHRASES = " OR ".join(f"contains(low, '{p.decode()}')" for p in BOILERPLATE)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
parsed AS (
  SELECT rid, line, w, len(w) AS n, length(array_to_string(w, '')) AS chars,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines) WHERE len(w) > 0),
judged AS (
  SELECT *, (n < {SHORT_LINE} AND NOT regexp_matches(w[-1], '[.!?:;,"'')\]…”»]$'))
    OR 2 * len(list_filter(w, lambda x: suffix(x, '!!') OR suffix(x, '??'))) > n
    OR 10 * symbols > 3 * n OR (n <= {BOILER_WORDS} AND ({_PHRASES})) AS fails
  FROM parsed),
per AS (
  SELECT rid, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS removed_chars
  FROM judged GROUP BY rid),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
win AS (
  SELECT rid, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p || ' ' || lead(word, 3) OVER p || ' ' || lead(word, 4) OVER p AS five
  FROM words WINDOW p AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos, five IS NOT NULL AND count(*) OVER (PARTITION BY rid, five) > 1 AS dup FROM win),
cover AS (SELECT rid, max(dup::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM twice),
rep AS (SELECT rid, sum(hit)::BIGINT AS n_repeat_words FROM cover GROUP BY rid),
flat AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(removed_chars, 0) AS removed_chars
  FROM d LEFT JOIN per USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * removed_chars <= word_chars AS kept, n_lines_removed, removed_chars
FROM flat
"""
