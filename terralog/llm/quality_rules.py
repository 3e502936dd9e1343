"""Quality rules as weak supervision: rules vote or abstain, no single rule decides.

Every rule says good (1), bad (-1) or nothing (0) of a document.  How often good and bad
documents get each vote of a rule, silence included, is unknown; expectation-maximisation
estimates it, together with the share of good documents, from how often the rules agree
over *all* documents.  A document is kept when the posterior probability of "good" reaches
``KEEP_AT``.  No vote weighs more than ``MOST`` in log odds, so a rule alone is outvoted.

All of it is column expressions.  A round of the estimation is one aggregate over the
stored patterns of votes and their counts, spread over tasks like any table; the driver
sees two sums for each vote of a rule.

Defined results: a null, empty or blank text has no words, fails the base rules and is
not kept; a very long text is measured whole; every input row gives one output row,
repeated rows included; equal texts get equal verdicts; a posterior of just ``KEEP_AT``
keeps; an empty table gives an empty one; other columns of the input, whatever their
names, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import let, stored, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_AT = 0.5
ROUNDS = 20
#: Votes in the order of the figures below, and how often documents are supposed to get
#: each before any is seen, weighed as ``PRIOR`` of all documents.
VOTES = (-1, 0, 1)
OF_GOOD, OF_BAD, PRIOR = (0.05, 0.25, 0.7), (0.3, 0.4, 0.3), 0.02
#: Bounds of a vote's log odds.  A vote never speaks against its own meaning, which fixes
#: what good and bad are, nor louder than ``MOST``; silence says at most ``SILENT``.
LEAST, MOST, SILENT = 0.1, 3.0, 0.5
#: Start and bounds of the share of good documents.
SHARE, SHARE_LOW, SHARE_HIGH = 0.8, 0.5, 0.98


def repeated_words(words: Column) -> Column:
    """Number of words inside 5-word windows that occur twice or more, first ones included.

    Windows are sorted by hash next to their equals, then counted by position, so the
    cost is n log n for any text.
    """

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 5),
            lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]),
        )

    def equal_to(s: Column, i: Column, j: Column) -> Column:
        return F.coalesce(F.get(s, j)["h"] == s[i]["h"], F.lit(False))

    def places(s: Column) -> Column:
        seen = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal_to(s, i, i - 1) | equal_to(s, i, i + 1)
        )
        return F.sort_array(F.transform(seen, lambda i: s[i]["at"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        # Most texts repeat no window at all; a set of the hashes tells without sorting.
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h), let(ordered, lambda s: let(places(s), covered))
        ).otherwise(none)

    none = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) > 5, let(windows(w), repeats)).otherwise(none))


#: Patterns, in the syntax that Java's and RE2's regular expressions share.
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
LETTER_OR_DIGIT = r"[\p{L}0-9]"
PLAIN_WORD = r"^\p{L}+[.,;:!?]?$"
SENTENCE_END = r"[.!?](?:[ \t\n\x0B\f\r]|\z)"
LINE_END = r"""[.!?]["')]?[ \t\x0B\f\r]*\z"""
BULLET = r"^[ \t]*(?:[-*\x{2022}]|[0-9]+[.)])[ \t]"
#: Characters that are counted, by the name of the count.
CLASSES = {
    "n_symbols": SYMBOLS,
    "n_shouts": "!?",
    "n_commas": ",;:",
    "n_digits": "0-9",
    "n_letters": r"\p{L}",
    "n_capitals": r"\p{Lu}",
}
SHORT_WORD = 3


def measures(text: Column) -> Column:
    """One struct of counts for a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_BLANK)))

    def number(items: Column) -> Column:
        return F.size(items).cast("long")

    def like(items: Column, pattern: str) -> Column:
        return number(F.filter(items, lambda x: F.rlike(x, F.lit(pattern))))

    def of_words(w: Column) -> Column:
        return F.struct(
            number(w).alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            number(F.array_distinct(w)).alias("n_distinct"),
            like(w, PLAIN_WORD).alias("n_plain"),
            (number(w) - like(w, LETTER_OR_DIGIT)).alias("n_bare"),
            number(F.filter(w, lambda x: F.length(x) <= SHORT_WORD)).alias("n_short"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            number(x).alias("n_lines"),
            (number(x) - number(F.array_distinct(x))).alias("n_dup_lines"),
            like(x, LINE_END).alias("n_line_ends"),
            like(x, BULLET).alias("n_bullets"),
        )

    return F.struct(
        let(words_of(text), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        F.regexp_count(text, F.lit(SENTENCE_END)).cast("long").alias("n_sentences"),
        *[F.length(F.regexp_replace(text, f"[^{c}]+", "")).cast("long").alias(name) for name, c in CLASSES.items()],
    )


#: Where the struct of measures holds each of them.
PLACES = {
    **{c: f"words.{c}" for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct", "n_plain", "n_bare", "n_short")},
    **{c: f"lines.{c}" for c in ("n_lines", "n_dup_lines", "n_line_ends", "n_bullets")},
    **{c: c for c in ("n_sentences", *CLASSES)},
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: What the rules look at, as SQL.
SHARES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "(n_symbols + n_shouts) / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(n_letters, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "letters": "n_letters / greatest(word_chars, 1)",
    "plain": "n_plain / greatest(n_words, 1)",
    "bare": "n_bare / greatest(n_words, 1)",
    "short": "n_short / greatest(n_words, 1)",
    "sentence": "n_words / greatest(n_sentences, 1)",
    "line_ends": "n_line_ends / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "fresh": "n_distinct / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "commas": "n_commas / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "bullets": "n_bullets / greatest(n_lines, 1)",
}
#: Each rule: when it votes good, when bad.  Between the two it abstains.
RULES = {
    "symbols": ("symbols < 0.02", "symbols > 0.15"),
    "marks": ("marks < 0.02", "marks > 0.06"),
    "capitals": ("capitals < 0.1", "capitals > 0.3"),
    "shouts": ("shouts < 0.08", "shouts > 0.3"),
    "letters": ("letters > 0.9", "letters < 0.8"),
    "plain": ("plain > 0.9", "plain < 0.6"),
    "bare": ("bare < 0.02", "bare > 0.1"),
    "short": ("short > 0.15 AND short < 0.6", "short < 0.08 OR short > 0.8"),
    "sentence": ("sentence >= 4 AND sentence <= 40", "sentence < 2.5 OR sentence > 100"),
    "line_ends": ("line_ends > 0.8", "line_ends < 0.5"),
    "repeats": ("repeats < 0.02", "repeats > 0.15"),
    "dup_lines": ("dup_lines = 0", "dup_lines > 0.3 AND n_lines > 3"),
    "fresh": ("fresh > 0.3", "fresh < 0.1 AND n_words >= 30"),
    "word_length": ("word_length >= 3 AND word_length <= 6.5", "word_length < 2 OR word_length > 7"),
    "commas": ("commas > 0.01 AND commas < 0.2", "commas > 0.4 OR (commas = 0 AND n_words > 60)"),
    "digits": ("digits < 0.02", "digits > 0.15"),
    "bullets": ("bullets < 0.1", "bullets > 0.5"),
}
VOTE = "CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def weights(of_good: list[float], of_bad: list[float]) -> list[float]:
    """Log odds of one rule's votes, within their bounds."""
    odds = [math.log(g / b) for g, b in zip(of_good, of_bad, strict=True)]
    return [min(-LEAST, max(-MOST, odds[0])), min(SILENT, max(-SILENT, odds[1])), min(MOST, max(LEAST, odds[2]))]


def odds(votes: str, model: tuple[float, list[list[float]]]) -> Column:
    """Log odds of good, rules taken as independent given the truth.

    As one SQL text: built of column functions it would cost hundreds of calls a round.
    """
    prior, rules = model
    said = [f"CASE {votes}[{k}] WHEN -1 THEN {w[0]!r}D WHEN 1 THEN {w[2]!r}D ELSE {w[1]!r}D END" for k, w in enumerate(rules)]
    return F.expr(" + ".join([f"{prior!r}D", *said]))


def posterior(votes: str, model: tuple[float, list[list[float]]]) -> Column:
    return 1 / (1 + F.exp(-odds(votes, model)))


def better(sums: dict[tuple[int, int], tuple[float, float]], rules: int) -> tuple[float, list[list[float]]]:
    """The model that one round's sums give: documents with a rule's vote, and how many of them are good."""
    of_first = [sums.get((0, v), (0.0, 0.0)) for v in VOTES]
    every, good = sum(n for n, _ in of_first), sum(g for _, g in of_first)
    prior = PRIOR * every
    new = []
    for k in range(rules):
        cells = [sums.get((k, v), (0.0, 0.0)) for v in VOTES]
        new.append(
            weights(
                [(g + prior * p) / (good + prior) for (_, g), p in zip(cells, OF_GOOD, strict=True)],
                [(n - g + prior * p) / (every - good + prior) for (n, g), p in zip(cells, OF_BAD, strict=True)],
            )
        )
    share = min(SHARE_HIGH, max(SHARE_LOW, good / every))
    return math.log(share / (1 - share)), new


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> tuple[float, list[list[float]]]:
    """Log odds of good, and of each rule's votes, from ``votes, n``: a row per pattern."""
    model = math.log(SHARE / (1 - SHARE)), [weights(list(OF_GOOD), list(OF_BAD)) for _ in range(rules)]
    for _ in range(rounds):
        scored = patterns.select("n", (F.col("n") * posterior("votes", model)).alias("good"), F.posexplode("votes"))
        seen = scored.groupBy("pos", "col").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
        if not seen:
            break
        model = better({(r["pos"], r["col"]): (float(r["n"]), r["good"]) for r in seen}, rules)
    return model


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, each measure and the ``votes`` of every row; the text is read once and left behind."""
    df = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    df = df.select("doc_id", *[F.col(f"m.{at}").alias(name) for name, at in PLACES.items()])
    df = df.select("*", *[F.expr(value).alias(name) for name, value in SHARES.items()])
    votes = F.array(*[F.expr(VOTE.format(good=good, bad=bad)) for good, bad in RULES.values()])
    return df.select("doc_id", *BASE, votes.alias("votes"))


def decided(df: DataFrame, model: tuple[float, list[list[float]]]) -> DataFrame:
    return (
        df.withColumn("base_failed", F.expr(FAILED))
        .withColumn("p_good", posterior("votes", model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
    )


def learned(measures: DataFrame) -> tuple[float, list[list[float]]]:
    """The model from the votes of all documents."""
    patterns = stored(measures.groupBy("votes").agg(F.count("*").alias("n")), "patterns")
    return fit(patterns, len(RULES))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's measures, votes, posterior ``p_good``, ``base_failed`` and ``kept``.

    Measures are stored once, as both the estimate and the decision read them.
    """
    df = stored(measured(docs, id_col, text_col), "measures")
    return decided(df, learned(df)).select("doc_id", *BASE, "base_failed", "votes", "p_good", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, with all their columns.

    Rows have no reliable key to join a decision by, so the row travels as one struct in
    place of the id, and is stored with its measures: a filter on measures that are not
    stored would be moved below them and work them out again for every rule.
    """
    packed = docs.select(F.struct("*").alias("row"), "text")
    df = stored(measured(packed, "row", "text"), "measures")
    return decided(df, learned(df)).filter("kept").select("doc_id.*")


def sql() -> str:
    """The same result in DuckDB's SQL: plain measures, and the estimation as a recursive table."""
    counts = ",\n    ".join(
        f"length(regexp_replace(t, '[^{c}]+', '', 'g')) AS {name}" for name, c in CLASSES.items()
    )
    shares = ", ".join(f"{value} AS {name}" for name, value in SHARES.items())
    cast = ", ".join(VOTE.format(good=good, bad=bad) for good, bad in RULES.values())
    start = ", ".join(f"{[w[k] for w in [weights(list(OF_GOOD), list(OF_BAD))] * len(RULES)]}::DOUBLE[]" for k in range(3))
    line_end = LINE_END.replace("'", "''")

    def log_odds(of_good: str, of_bad: str, good: float, bad: float, low: float, high: float) -> str:
        given_good = f"({of_good} + {PRIOR} * nn * {good}) / (gg + {PRIOR} * nn)"
        given_bad = f"({of_bad} + {PRIOR} * nn * {bad}) / (nn - gg + {PRIOR} * nn)"
        return f"list(least({high}::DOUBLE, greatest({low}::DOUBLE, ln(({given_good}) / ({given_bad})))) ORDER BY k)"

    bounds = ((-MOST, -LEAST), (-SILENT, SILENT), (LEAST, MOST))
    new = ", ".join(
        log_odds(f"g{k}", f"(n{k} - g{k})", OF_GOOD[k], OF_BAD[k], *bounds[k]) for k in range(3)
    )
    cells = ", ".join(
        f"coalesce(sum(n) FILTER (votes[k] = {v}), 0) AS n{i}, coalesce(sum(n * p) FILTER (votes[k] = {v}), 0) AS g{i}"
        for i, v in enumerate(VOTES)
    )
    said = " + ".join(
        f"CASE votes[{k}] WHEN -1 THEN low[{k}] WHEN 1 THEN high[{k}] ELSE silent[{k}] END" for k in range(1, len(RULES) + 1)
    )
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_BLANK}')) AS lines
  FROM documents
), again AS (
  SELECT doc_id, sum(least(5, coalesce(following - place, 5)))::BIGINT AS n_repeat_words
  FROM (
    SELECT doc_id, place, lead(place) OVER (PARTITION BY doc_id ORDER BY place) AS following
    FROM (
      SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, five) AS times
      FROM (
        SELECT doc_id, place, array_to_string(w[place : place + 4], ' ') AS five
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS place FROM d WHERE len(w) >= 5)
      )
    ) WHERE times > 1
  ) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct,
    len(list_filter(w, lambda x: regexp_matches(x, '{PLAIN_WORD}'))) AS n_plain,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '{LETTER_OR_DIGIT}'))) AS n_bare,
    len(list_filter(w, lambda x: length(x) <= {SHORT_WORD})) AS n_short,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '{line_end}'))) AS n_line_ends,
    len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullets,
    len(regexp_extract_all(t, '{SENTENCE_END}')) AS n_sentences,
    {counts}
  FROM d LEFT JOIN again ON again.doc_id = d.doc_id
), s AS (SELECT *, {shares} FROM m),
v AS MATERIALIZED (SELECT *, [{cast}] AS votes FROM s),
patterns AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes),
model AS (
  SELECT 0 AS round, ln({SHARE} / (1 - {SHARE})) AS prior, * FROM (SELECT {start}) AS start(low, silent, high)
  UNION ALL
  SELECT round, ln(share / (1 - share)), low, silent, high FROM (
    SELECT any_value(round) + 1 AS round, least({SHARE_HIGH}, greatest({SHARE_LOW}, any_value(gg) / any_value(nn))) AS share,
      {new}
    FROM (
      SELECT *, n0 + n1 + n2 AS nn, g0 + g1 + g2 AS gg FROM (
        SELECT any_value(round) AS round, k, {cells}
        FROM (SELECT votes, n, round, 1 / (1 + exp(-(prior + {said}))) AS p FROM patterns, model WHERE round < {ROUNDS}) AS scored,
          range(1, {len(RULES) + 1}) AS rule(k)
        GROUP BY k
      )
    ) HAVING count(*) > 0
  ) AS better(round, share, low, silent, high)
), final AS (SELECT * FROM model WHERE round = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({FAILED}) AS base_failed,
  1 / (1 + exp(-(prior + {said}))) >= {KEEP_AT} AND NOT ({FAILED}) AS kept
FROM v, final
"""
