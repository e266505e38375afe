"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a rejecting expression over a text. ``ordered`` runs every rule on a bounded sample, takes its
cost (seconds over an empty rule) and its selectivity (share rejected), and puts the rules in the order of
rejections per cost. ``verdict`` is one CASE over the rules in that order: a rejected text skips the rest,
so dear rules read only what cheap ones let through. The order has no part in the result.

Results: a null text has no words and is rejected; so are texts under ten words and those of which over a
fifth of the words lie in repeated five-word windows. Counts take in whole texts. Repeated rows give repeated
results; other columns are kept.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and which characters count as symbols.
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 500
SAMPLE_CHARS = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def word_chars(text: str = "text") -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, "")).cast("long")


def count_of(characters: str, text: str = "text") -> Column:
    whole = F.coalesce(text, F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, characters, ""))).cast("long")


def matching(pattern: str, text: str = "text") -> Column:
    """Characters of the text that match the class ``pattern`` negates."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, ""))


def lines(text: str = "text") -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def with_repeats(df: DataFrame, words_column: str, name: str) -> DataFrame:
    """Adds the number of words that lie in five-word windows found twice or more, the first included.

    Windows are hashed, and most texts end at the comparison with the distinct hashes. Else each hash gives its
    low bits to the window's position, one sort brings equal hashes together, and the positions whose words are those
    of a neighbour, sorted again, are added up by the distance to the next. The words decide, so hashes that are equal by
    chance count nothing; a second neighbour on each side is looked at, as such a hash may stand between equal windows.
    """
    w = words_column
    window = ", ".join(f"{w}[i + {k}]" for k in range(WINDOW))
    hashes = f"CASE WHEN size({w}) < {WINDOW} THEN array() ELSE transform(sequence(0, size({w}) - {WINDOW}), i -> xxhash64({window})) END"
    bits = "cast(ceil(log2(size(_attesta_hashes))) AS int)"
    packed = f"transform(_attesta_hashes, (h, i) -> shiftleft(shiftright(h, {bits}), {bits}) + i)"
    place = f"cast({{0}} - shiftleft(shiftright({{0}}, {bits}), {bits}) AS int)"

    def same(other: str) -> str:
        q, at, own = f"get(_attesta_packed, k {other})", place.format(f"get(_attesta_packed, k {other})"), place.format("p")
        equal = " AND ".join(f"{w}[{at} + {k}] = {w}[{own} + {k}]" for k in range(WINDOW))
        return f"CASE WHEN shiftright(p, {bits}) = shiftright({q}, {bits}) THEN {equal} ELSE false END"

    near = " OR ".join(same(other) for other in ("- 1", "+ 1", "- 2", "+ 2"))
    places = f"transform(filter(_attesta_packed, (p, k) -> {near}), p -> {place.format('p')})"
    covered = f"aggregate(transform(_attesta_places, (p, k) -> least({WINDOW}, coalesce(get(_attesta_places, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"
    any_twice = "size(array_distinct(_attesta_hashes)) < size(_attesta_hashes)"
    return (
        df.withColumn("_attesta_hashes", F.expr(hashes))
        .withColumn("_attesta_packed", F.expr(f"CASE WHEN {any_twice} THEN sort_array({packed}) END"))
        .withColumn("_attesta_places", F.expr(f"sort_array({places})"))
        .withColumn(name, F.expr(f"CASE WHEN _attesta_packed IS NULL THEN 0L ELSE {covered} END"))
        .drop("_attesta_hashes", "_attesta_packed", "_attesta_places")
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    found = df.withColumn("_attesta_words", words(text)).withColumn("_attesta_lines", lines(text))
    found = with_repeats(found, "_attesta_words", "n_repeat_words").withColumns(
        {
            "n_words": F.size("_attesta_words").cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": count_of(SYMBOLS, text),
            "n_dup_lines": (F.size("_attesta_lines") - F.size(F.array_distinct("_attesta_lines"))).cast("long"),
        }
    )
    return found.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")).drop("_attesta_words", "_attesta_lines")


def default_rules(text: str = "text") -> list[Rule]:
    """Reject what no prose has: marks between the words, shouting, mostly repeated lines, few letters, odd word lengths."""
    whole = F.coalesce(text, F.lit(""))
    n_words = F.size(words(text))
    letters = matching(r"[^\p{L}]", text)
    own = lines(text)
    return [
        Rule("symbols", count_of(SYMBOLS, text) > 0.1 * n_words),
        Rule("exclamations", (F.length(whole) - F.length(F.replace(whole, F.lit("!!"), F.lit("!")))) > 0.1 * n_words),
        Rule("capitals", matching(r"[^\p{Lu}]", text) > 0.3 * letters),
        Rule("repeated lines", F.size(own) - F.size(F.array_distinct(own)) > 0.5 * F.size(own)),
        Rule("few letters", letters < 0.3 * word_chars(text)),
        Rule("word length", (word_chars(text) < 2 * n_words) | (word_chars(text) > 20 * n_words)),
    ]


def _seconds(df: DataFrame) -> tuple[int, float]:
    start = time.perf_counter()
    return df.count(), time.perf_counter() - start


def ordered(df: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per cost, both taken from a sample of at most ``sample_rows`` rows.

    The sample passes through the driver, so texts over ``SAMPLE_CHARS`` are left out of it: 500 rows, 50 MB at most.
    """
    short = df.where(F.length("text") <= SAMPLE_CHARS).select("text").sample(0.2, seed=7)
    taken = short.take(sample_rows)  # from as few partitions as it needs
    rows = len(taken)
    if not rows:
        return rules
    sample = df.sparkSession.createDataFrame(taken, "text string").cache()
    try:
        sample.count()
        _, idle = _seconds(sample.where(F.length("text") < 0))
        gains = {}
        for rule in rules:
            rejected, took = _seconds(sample.where(rule.rejects))
            gains[rule.name] = (rejected / rows) / max(took - idle, 0.001)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -gains[r.name])


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects the text. Rules after the first rejection are not evaluated."""
    case = None
    for rule in rules:
        case = F.when(rule.rejects, F.lit(False)) if case is None else case.when(rule.rejects, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the counts of ``measured`` and kept; texts that fail the base rules skip the cascade."""
    order = ordered(docs, default_rules() if rules is None else rules)
    return measured(docs).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(order)))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. The dear count of repeats comes last."""
    columns = docs.columns
    short = docs.where(F.size(words()) >= 10).where(verdict(ordered(docs, default_rules())))
    found = with_repeats(short.withColumn("_attesta_words", words()), "_attesta_words", "_attesta_repeats")
    # A plain filter would be pushed below the columns it rests on and write all of them out in each of its places.
    passed = F.when(F.expr("100 * _attesta_repeats <= 20 * size(_attesta_words)"), F.array(F.lit(True)))
    marked = found.withColumn("_attesta_passed", F.explode_outer(passed)).where("_attesta_passed")
    return marked.select(*(F.col(f"`{c}`") for c in columns))


#: DuckDB SQL for the counts and the verdict.
SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), counted AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
  FROM cut
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM counted)
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM (
    SELECT r, i, unnest(range(0, 5)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1
  ) GROUP BY r
), found AS (
  SELECT doc_id, t, letters, capitals, l, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM counted LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.1 * n_words
    OR length(t) - length(replace(t, '!!', '!')) > 0.1 * n_words OR capitals > 0.3 * letters
    OR n_dup_lines > 0.5 * len(l) OR letters < 0.3 * word_chars OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM found
"""
