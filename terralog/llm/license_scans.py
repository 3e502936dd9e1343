"""License scans: ordered signature rules on whole texts.

A text is reduced to its words, joined by single blanks, so that one signature covers
all ways of punctuation ("CC-BY 4.0", "cc by 4.0").  Several hundred signatures in order
of priority, each behind a keyword that must occur in the text, give intervals of words.
An interval that lies within one of a signature of higher priority is dropped, so
"cc by nc 4 0" is not reported as "cc by" as well and "gpl 3 or later" not as "gpl 3".
Intervals that only overlap, or that repeat a label elsewhere, stay.

All of it is column expressions: a gate of a few stems decides for most texts, and the
signatures run only behind it.  Places come from splitting at the matches, and one sweep
over the sorted intervals, which carries at most one open interval per signature, settles
what lies within what; so the cost grows with the text and, but for sorting, with the
number of matches.  There is no shuffle.

Defined results: a null or empty text has no words, no place, empty labels and score 0;
of equal intervals the signature of higher priority stays; a very long text is worked
through whole; every input row gives one output row, repeated rows included; an empty
table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import CAPITALS, SMALL, let, small_letters

#: Phrases of the base report, as words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Everything that is not part of a word, once capitals are small.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RUN = 1000  # sums that are made by growing one array

#: Creative Commons elements by their short form, and their names.
COMMONS = {
    "by": "attribution",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
    "by nc": "attribution non ?commercial",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: GNU licenses: short form, name, versions.
GNU = {
    "agpl": ("(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    "lgpl": ("(?:gnu )?(?:lesser|library) general public licen[cs]e", ("2", "2 1", "3")),
    "gfdl": ("(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    "gpl": ("(?:gnu )?general public licen[cs]e", ("1", "2", "3")),
}

#: Other families with versions: label, keyword, name, versions.
VERSIONED = (
    ("apache", "apache", "apache(?: software)?(?: foundation)? licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "development and distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cpl", "common public", "common public licen[cs]e", ("0 5", "1 0")),
    ("eupl", "european union", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open software", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", "academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("lppl", "latex project", "latex project public licen[cs]e", ("1 0", "1 1", "1 2", "1 3")),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("apsl", "apple public", "apple public source licen[cs]e", ("1 0", "1 1", "1 2", "2 0")),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", ("1 0", "1 1", "2 0", "2 1")),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", ("1 0",)),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", ("1 0",)),
    ("sspl", "server side public", "server side public licen[cs]e", ("1",)),
    ("busl", "business source", "business source licen[cs]e", ("1 0", "1 1")),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e", ("1 0",)),
    ("odbl", "open database", "(?:open data commons )?open database licen[cs]e", ("1 0",)),
    ("pddl", "public domain dedication", "public domain dedication and licen[cs]e", ("1 0",)),
    ("psf", "python software", "python software foundation licen[cs]e", ("2",)),
    ("php", "php licen", "php licen[cs]e", ("3 0", "3 01")),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e", ("1 0",)),
    ("upl", "universal permissive", "universal permissive licen[cs]e", ("1 0",)),
    ("qpl", "q public", "q public licen[cs]e", ("1 0",)),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", ("1 0",)),
    ("bsl", "boost software", "boost software licen[cs]e", ("1 0",)),
)

#: Signatures without versions: label, keyword, signature, weight.
PLAIN = (
    ("mit", "mit licen", "(?:the )?mit licen[cs]e", 0.8),
    ("mit", "mit", "licen[cs]ed under (?:the )?mit", 0.8),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "expat", "expat licen[cs]e", 0.8),
    ("mit-0", "no attribution", "mit no attribution", 0.8),
    ("isc", "isc licen", "isc licen[cs]e", 0.8),
    ("isc", "permission to use copy", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[cs]e)?", 0.9),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) bsd licen[cs]e", 0.9),
    ("bsd-2-clause", "bsd", "bsd (?:2|two) clause(?: licen[cs]e)?", 0.9),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[cs]e)?", 0.9),
    ("bsd-3-clause", "bsd", "(?:modified|new|revised) bsd licen[cs]e", 0.9),
    ("bsd-3-clause", "bsd", "bsd (?:3|three) clause(?: licen[cs]e)?", 0.9),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[cs]e)?", 0.9),
    ("bsd-4-clause", "bsd", "bsd (?:4|four) clause(?: licen[cs]e)?", 0.9),
    ("0bsd", "0bsd", "0bsd", 0.8),
    ("0bsd", "zero clause", "zero clause bsd", 0.8),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms", 0.9),
    ("bsd", "bsd", "bsd (?:style )?licen[cs]e", 0.7),
    ("bsd", "bsd", "licen[cs]ed under (?:the )?bsd", 0.7),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", 0.8),
    ("zlib", "as is", "provided as is without any express or implied warranty", 0.6),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.7),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "wtfpl", "wtfpl", 0.8),
    ("wtfpl", "what the fuck", "do what the fuck you want to public licen[cs]e", 0.95),
    ("beerware", "beer", "beer ?ware licen[cs]e", 0.8),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", 0.8),
    ("openssl", "openssl licen", "openssl licen[cs]e", 0.8),
    ("curl", "curl licen", "curl licen[cs]e", 0.7),
    ("ruby", "ruby", "ruby licen[cs]e", 0.7),
    ("vim", "vim", "vim licen[cs]e", 0.7),
    ("json", "shall be used for good", "shall be used for good not evil", 0.95),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "cc zero", "cc zero", 0.8),
    ("cc0", "creative commons zero", "creative commons zero(?: 1 0)?", 0.9),
    ("cc", "creative commons", "creative commons licen[cs]e", 0.6),
    ("cc", "creative commons", "licen[cs]ed under creative commons", 0.6),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "public domain", "public domain", 0.5),
    ("commons-clause", "commons clause", "commons clause", 0.7),
    ("elastic", "elastic licen", "elastic licen[cs]e(?: 2 0)?", 0.7),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict) licen[cs]e", 0.8),
    ("openrail", "rail", "(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", 0.7),
    ("copyleft", "copyleft", "copyleft", 0.5),
    ("free-art", "free art", "free art licen[cs]e", 0.8),
    ("ogl", "open government", "open government licen[cs]e", 0.8),
    ("etalab", "licence ouverte", "licence ouverte", 0.8),
    ("dl-de", "datenlizenz", "datenlizenz deutschland", 0.8),
    ("gpl", "freie dokumentation", "gnu freie dokumentation", 0.6),
    ("reserved", "reserved", "all rights (?:are )?(?:hereby )?reserved", 0.7),
    ("reserved", "droits", "tous droits réservés", 0.7),
    ("reserved", "rechte vorbehalten", "alle rechte vorbehalten", 0.7),
    ("reserved", "derechos reservados", "todos los derechos reservados", 0.7),
    ("some-reserved", "rights reserved", "some rights reserved", 0.7),
    ("proprietary", "proprietary", "proprietary and confidential", 0.7),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this \\S+ )?is (?:strictly )?prohibited", 0.8),
    ("proprietary", "may be reproduced", "no part of this \\S+ may be reproduced", 0.8),
    ("proprietary", "permission", "without (?:prior )?(?:written )?permission", 0.5),
    ("personal-use", "personal use", "for personal use only", 0.5),
    ("no-commercial", "commercial use", "(?:not for|no) commercial use", 0.6),
    ("no-derivatives", "derivative", "no derivative works", 0.5),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)*(?: by)?", 0.6),
    ("copyright", "copyrighted", "this (?:work|text|document|article|page) is copyrighted", 0.6),
)

#: A text without any of these stems matches no signature and no base phrase.
GATE = (
    "licen", "lizenz", "rights", "droits", "rechte", "derechos", "copyright", "copyleft", "permission",
    "public", "redistribution", "unauthori", "propriet", "commons", "cc", "gpl", "gfdl", "mpl", "epl", "cddl",
    "eupl", "bsd", "cecill", "wtfpl", "spdx", "mit", "rail", "reproduced", "derivative", "commercial",
    "personal", "shall", "warranty", "dokumentation",
)


@cache
def rules() -> tuple[tuple[str, str, str, float], ...]:
    """``(label, keyword, signature, weight)`` in order of priority: longer and more exact first."""
    made = []
    for (short, name), version in product(COMMONS.items(), COMMONS_VERSIONS):
        label = f"cc-{short.replace(' ', '-')}-{version.replace(' ', '.')}"
        tail = "(?: international| unported| generic)?"
        made += [(label, "creative commons", f"creative commons {name}(?: licen[cs]e)?(?: version)? {version}{tail}", 0.95)]
        made += [(label, "cc", f"cc {short}(?: licen[cs]e)?(?: v| version)? {version}{tail}", 0.95)]
    for short, (name, versions) in GNU.items():
        for version in reversed(versions):
            dotted = version.replace(" ", ".")
            number = version + ("" if " " in version else "(?: 0)?")
            for later, form in (("-or-later", " (?:or (?:any )?(?:later|newer)(?: version)?|only or later)"), ("", "(?: only)?")):
                made += [(f"{short}-{dotted}{later}", "licen", f"{name}(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?{number}(?: of the licen[cs]e)?{form}", 0.95)]
                made += [(f"{short}-{dotted}{later}", short, f"{short}(?: v| version)? ?v?{number}{form}", 0.9)]
    for label, keyword, name, versions in VERSIONED:
        for version in reversed(versions):
            number = version.removesuffix(" 0") + ("(?: 0)?" if version.endswith(" 0") else "")
            made += [(f"{label}-{version.replace(' ', '.')}", keyword, f"{name}(?: v| version)? ?v?{number}", 0.9)]
    # Without a version: the longer forms of a family first.
    for short, name in sorted(COMMONS.items(), key=lambda x: -len(x[0])):
        made += [(f"cc-{short.replace(' ', '-')}", "creative commons", f"creative commons {name}(?: licen[cs]e)?", 0.85)]
        made += [(f"cc-{short.replace(' ', '-')}", "cc", f"cc {short}(?: licen[cs]e)?", 0.8)]
    for short, (name, _) in GNU.items():
        made += [(short, "licen", name, 0.85), (short, short, f"{short}(?: licen[cs]e)?", 0.6)]
    made += [(label, keyword, name, 0.8) for label, keyword, name, _ in VERSIONED]
    return (*made, *PLAIN)


def normal(text: Column) -> Column:
    """The words of a text in small letters, one blank before each and one at the end."""
    words = F.trim(F.regexp_replace(small_letters(text), GAPS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def base_places(norm: Column, n_words: Column) -> Column:
    """``n``, ``first`` and ``last`` place of each base phrase, in the phrases' order.

    Only the pieces before the first and after the last place are measured.
    """

    def of(phrase: str) -> Column:
        def places(pieces: Column) -> Column:
            n = (F.size(pieces) - 1).cast("long")
            last = n_words - (blanks(pieces[F.size(pieces) - 1]) - 1) - len(phrase.split())
            return F.when(
                n > 0, F.struct(n.alias("n"), (blanks(pieces[0]) - 1).alias("first"), last.alias("last"))
            )

        return let(F.split(norm, f"(?<= ){phrase}(?= )"), places)

    return F.array(*[of(phrase) for phrase in BASE])


def running(values: Column) -> Column:
    """The sums up to each value, itself included.

    An array grows by a copy, so sums are made within runs of ``RUN`` values and the runs'
    totals are added to them.
    """

    def grown(n: Column, value: Callable[[Column], Column]) -> Column:
        """Sums of ``value`` of 0 to ``n`` less 1."""
        return F.aggregate(
            F.sequence(F.lit(0), n - 1),
            F.array().cast("array<long>"),
            lambda sums, i: F.array_append(sums, F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + value(i)),
        )

    def of_run(v: Column, run: Column) -> Column:
        return grown(F.least(F.lit(RUN), F.size(v) - run * RUN), lambda i: v[run * RUN + i])

    def joined(runs: Column) -> Column:
        totals = grown(F.size(runs), lambda i: F.element_at(runs[i], -1))
        return let(
            totals,
            lambda t: F.flatten(
                F.transform(runs, lambda run, i: F.transform(run, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))
            ),
        )

    return let(
        values,
        lambda v: let(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda run: of_run(v, run)),
            joined,
        ),
    )


def intervals(norm: Column, form: Column, rule: Column) -> Column:
    """``first, before_end, rule`` of each match: its first word and, negated, the word after its last.

    There must be a match.
    """

    def placed(pieces: Column, matches: Column) -> Column:
        steps = F.transform(
            matches, lambda _, i: blanks(pieces[i]) + F.when(i == 0, F.lit(-1)).otherwise(blanks(F.get(matches, i - 1)))
        )
        return let(
            running(steps),
            lambda first: F.transform(
                matches,
                lambda m, i: F.struct(
                    first[i].alias("first"), (-1 - first[i] - blanks(m)).alias("before_end"), rule.alias("rule")
                ),
            ),
        )

    return let(
        F.struct(F.split(norm, form).alias("pieces"), F.regexp_extract_all(norm, form, F.lit(0)).alias("matches")),
        lambda x: let(x["pieces"], lambda pieces: let(x["matches"], lambda matches: placed(pieces, matches))),
    )


def uncontained(found: Column) -> Column:
    """The rules, in order, with an interval that lies within none of a rule before them.

    Sorted by first word, longest first, an interval can only lie within those before it
    that are still open.  One that was dropped need not be kept open: what lies within it
    lies within the one that it was dropped for.
    """

    def step(state: Column, x: Column) -> Column:
        def settle(still: Column) -> Column:
            within = F.exists(still, lambda o: (o["before_end"] <= x["before_end"]) & (o["rule"] < x["rule"]))
            return F.when(within, F.struct(still.alias("open"), state["rules"].alias("rules"))).otherwise(
                F.struct(
                    F.array_append(still, F.struct(x["before_end"].alias("before_end"), x["rule"].alias("rule"))).alias("open"),
                    F.array_union(state["rules"], F.array(x["rule"])).alias("rules"),
                )
            )

        return let(F.filter(state["open"], lambda o: -o["before_end"] > x["first"]), settle)

    start = F.struct(
        F.array().cast("array<struct<before_end: bigint, rule: int>>").alias("open"),
        F.array().cast("array<int>").alias("rules"),
    )
    return F.sort_array(F.aggregate(F.sort_array(found), start, step, lambda state: state["rules"]))


def detections(norm: Column) -> Column:
    """Labels of the signatures that stay and the chance that all of them err."""
    labels, keywords, signatures, weights = zip(*rules(), strict=True)
    names, sure = F.lit(list(labels)), F.lit(list(weights))
    forms = F.lit([f"(?<= ){x}(?= )" for x in signatures])
    keys = sorted(set(keywords))
    behind = F.array(*[F.lit([k for k, of in enumerate(keywords) if of == key]) for key in keys])
    there = F.filter(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: F.contains(norm, F.lit(keys)[k]))
    tried = F.flatten(F.transform(there, lambda k: behind[k]))
    matching = F.filter(tried, lambda k: F.rlike(norm, forms[k]))
    found = F.flatten(F.transform(matching, lambda k: intervals(norm, forms[k], k)))
    return let(
        uncontained(found),
        lambda rule: F.struct(
            F.transform(rule, lambda k: names[k]).alias("labels"),
            F.aggregate(rule, F.lit(1.0), lambda wrong, k: wrong * (1 - sure[k])).alias("wrong"),
        ),
    )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of the base phrases, base labels, all labels and a score for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    gate = reduce(lambda a, b: a | b, [F.contains(low, F.lit(stem)) for stem in GATE])
    n_words = F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        n_words.alias("n_words"),
        F.when(gate, normal(text)).alias("norm"),
    )
    df = df.select(
        "doc_id",
        "n_words",
        F.when(F.col("norm").isNotNull(), base_places(F.col("norm"), F.col("n_words"))).alias("places"),
        F.when(F.col("norm").isNotNull(), detections(F.col("norm"))).alias("found"),
    )
    places = F.filter("places", lambda p: p.isNotNull())
    named = F.filter(
        F.zip_with("places", F.lit(list(BASE.values())), lambda p, name: F.when(p.isNotNull(), name)),
        lambda name: name.isNotNull(),
    )
    nothing = F.array().cast("array<string>")
    base = F.coalesce(named, nothing)
    total = F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return df.select(
        "doc_id",
        "n_words",
        F.coalesce(total, F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["last"])).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(
            F.sort_array(F.array_union(base, F.coalesce(F.col("found.labels"), nothing))), ","
        ).alias("labels"),
        F.coalesce(1 - F.col("found.wrong"), F.lit(0.0)).alias("score"),
    )


def spaced(signature: str) -> str:
    """A signature on words with two blanks between, so that matches side by side share none."""
    apart = "(?:  )?".join(part.replace(" ", "  ") for part in signature.split(" ?"))
    return f" (?:{apart}) "


def sql() -> str:
    """The whole report, places by splitting and containment by comparing all intervals of a text."""

    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)

    signatures = [(i, label, key, spaced(x), w) for i, (label, key, x, w) in enumerate(rules())]
    # Base phrases are numbered below zero; they neither suppress nor are suppressed.
    phrases = [(-1 - i, label, phrase, spaced(phrase), 0.0) for i, (phrase, label) in enumerate(BASE.items())]
    return f"""
WITH rules(rule, label, keyword, form, weight) AS (VALUES {values(phrases + signatures)}),
plain AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id,
        trim(regexp_replace(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{GAPS}', ' ', 'g'), ' ') AS words
    FROM documents
),
texts AS MATERIALIZED (
    SELECT r, doc_id, CASE WHEN words = '' THEN 0 ELSE len(string_split(words, ' ')) END AS n_words,
        '  ' || replace(words, ' ', '  ') || '  ' AS apart, ' ' || words || ' ' AS norm
    FROM plain
),
cut AS MATERIALIZED (
    SELECT r, rule, label, weight,
        list_transform(string_split_regex(apart, form), lambda p: len(list_filter(string_split(p, ' '), lambda w: w <> ''))) AS between,
        list_transform(regexp_extract_all(apart, form), lambda m: len(list_filter(string_split(m, ' '), lambda w: w <> ''))) AS inside
    FROM texts JOIN rules ON contains(norm, keyword) WHERE regexp_matches(apart, form)
),
numbered AS (SELECT *, unnest(range(1, len(inside) + 1)) AS i FROM cut),
placed AS MATERIALIZED (
    SELECT r, rule, label, weight, list_sum(between[1:i]) + list_sum(inside[1:i]) - inside[i] AS first_word,
        list_sum(between[1:i]) + list_sum(inside[1:i]) AS after_last
    FROM numbered
),
stays AS (
    SELECT DISTINCT r, rule, label, weight FROM placed AS p WHERE rule >= 0 AND NOT EXISTS (
        SELECT 1 FROM placed AS q WHERE q.r = p.r AND q.rule >= 0 AND q.rule < p.rule
            AND q.first_word <= p.first_word AND q.after_last >= p.after_last)
),
found AS (
    SELECT r, list(label) AS labels,
        1 - list_reduce(list(1 - weight::DOUBLE ORDER BY rule), lambda a, b: a * b) AS score
    FROM stays GROUP BY r
),
base AS (
    SELECT r, count(*) AS n_base, min(first_word) AS first_word, max(first_word) AS last_word, list(DISTINCT label) AS labels
    FROM placed WHERE rule < 0 GROUP BY r
)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
    first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
    coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN found USING (r) LEFT JOIN base USING (r)
"""
