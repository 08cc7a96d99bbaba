"""Line-first quality cleaning, in DataFrame functions alone.

Every line of a text is judged by itself; failing lines are removed, and a
document that loses too much of its text that way is rejected.

Rules for a line (a line without a word is layout, passes and weighs nothing):

* punctuation: a line of ``MIN_PROSE_WORDS`` words or more holds no sentence mark
  at all, or over ``MAX_SYMBOL_PERCENT`` percent of its characters are symbols;
* navigation: ``MIN_SEPARATORS`` separators or more, and at least one for every
  ``WORDS_PER_SEPARATOR`` words;
* boilerplate: a line of at most ``MAX_BOILERPLATE_CHARS`` characters that holds one
  of the phrases of BOILERPLATE.

Document rules: under ``MIN_WORDS`` words; over ``MAX_REPEAT_PERCENT`` percent of
the words inside 8-word windows that occur again; and the line verdict: failing
lines hold over ``MAX_LOST_PERCENT`` percent of the characters in words.

Defined results: a null text counts as empty: all counts 0, base_failed true.
Repeated rows are judged row by row, a very long text whole, in one task's
memory (a row is never split). Other columns pass through untouched; names
that this module computes replace columns of the same name. Windows are compared
as strings to tell whether a text repeats any; inside a text that does, they are
paired by a 64-bit hash.
No row is moved: the plan has no exchange, so no key or source can be hot.

Why it is written as it is: lambdas cost about a microsecond an element and Java's
split by a pattern nearly as much a word, so nothing is done per word on the common
path. The text is brought to single blanks, words are counted by lengths, and all
8-word windows come from one pass of one pattern with a look-ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, let

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
MIN_PROSE_WORDS = 8
MAX_SYMBOL_PERCENT = 15
MIN_SEPARATORS = 3
WORDS_PER_SEPARATOR = 4
MAX_BOILERPLATE_CHARS = 120

SYMBOLS = r"[#*$%&|<>]"
SENTENCE_MARK = r"[.!?…。！？:;,]"
SEPARATORS = "|>»•·"
SEPARATOR = f"[{SEPARATORS}]"
#: Phrases of notices and controls in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "log in to comment",
    "share on facebook",
    "share on twitter",
    "follow us on",
    "click here to",
    "skip to content",
    "back to top",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "allgemeine geschäftsbedingungen",
    "newsletter abonnieren",
    "auf facebook teilen",
    "zum inhalt springen",
    "nach oben",
    "tous droits réservés",
    "accepter les cookies",
    "politique de confidentialité",
    "conditions générales",
    "mentions légales",
    "partager sur facebook",
    "aller au contenu",
    "haut de page",
    "todos los derechos reservados",
    "aceptar cookies",
    "política de privacidad",
    "política de cookies",
    "aviso legal",
    "términos y condiciones",
    "compartir en facebook",
    "saltar al contenido",
    "volver arriba",
)
#: Eight words from a word's start; the match itself takes one word and its blank.
GRAMS = r"(?=([^ ]++(?: [^ ]++){7}))[^ ]++ ?"


def single_blanks(text: Column) -> Column:
    """The words of a text joined by single blanks; rare white space is looked for first."""
    odd = F.contains(text, F.lit("\t"))
    for c in "\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(c))
    rare = F.when(odd, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    plain = F.trim(F.replace(rare, F.lit("\n"), F.lit(" ")))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def _bare(line: Column) -> Column:
    """Characters in words."""
    return F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))


def line_fails(line: Column, odd: Column) -> Column:
    """Whether a line fails a rule; false for a line without a word. ``odd``: whether
    the text holds a symbol or separator at all; without one those rules can't fail."""
    n_words = F.regexp_count(line, F.lit(WORD))
    noisy = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > _bare(line) * MAX_SYMBOL_PERCENT
    n_separators = F.regexp_count(line, F.lit(SEPARATOR))
    menu = (n_separators >= MIN_SEPARATORS) & (n_separators * WORDS_PER_SEPARATOR >= n_words)
    unmarked = ~line.rlike(SENTENCE_MARK) & (n_words >= MIN_PROSE_WORDS)
    canned = (F.length(line) <= MAX_BOILERPLATE_CHARS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (unmarked | canned | (odd & (noisy | menu))) & line.rlike(WORD)


def repeated_words(grams: Column) -> Column:
    """How many words stand in a window that occurs twice or more. ``grams``: the
    windows as strings, in order."""

    def of_sorted(pairs: Column) -> Column:
        same = F.transform(
            pairs,
            lambda x, j: F.when(
                (x["g"] == F.get(pairs, j - 1)["g"]) | (x["g"] == F.get(pairs, j + 1)["g"]), x["i"]
            ),
        )
        starts = F.sort_array(F.filter(same, lambda i: i.isNotNull()))
        return let(
            starts,
            lambda s: F.aggregate(
                F.zip_with(
                    s,
                    F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                    lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
                ),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            ),
        )

    paired = F.array_sort(F.transform(grams, lambda g, i: F.struct(F.xxhash64(g).alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(
        let(paired, of_sorted)
    )


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, kept and clean_text (the passing lines, joined by line feeds).

    Filter by ``kept`` with ``passing_only``: a plain filter above is pushed below the
    projections and would judge every line anew."""
    made = ["_plain", "_chars", "_lines", "_judged", "_fine", "_grams", "_odd"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = df.drop(*made).withColumns(
        {
            "_plain": single_blanks(text),
            "_lines": F.split(text, "\n", -1),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        }
    )
    others = [F.contains(text, F.lit(c)) for c in SEPARATORS if c not in SYMBOLS]
    odd = F.col("n_symbols") > 0
    for has in others:
        odd = odd | has
    two = one.withColumns({"_chars": F.length(F.replace(F.col("_plain"), F.lit(" "), F.lit(""))), "_odd": odd})
    three = two.withColumns(
        {
            "word_chars": F.col("_chars").cast("long"),
            "n_words": F.when(F.col("_chars") == 0, F.lit(0)).otherwise(F.length("_plain") - F.col("_chars") + 1).cast("long"),
            "_grams": F.regexp_extract_all("_plain", F.lit(GRAMS), F.lit(1)),
            "_judged": F.transform("_lines", lambda x: F.struct(x.alias("line"), line_fails(x, F.col("_odd")).alias("bad"))),
            "_fine": F.filter("_lines", lambda x: x.rlike(WORD)),
        }
    )
    any_bad = F.exists("_judged", lambda x: x["bad"])
    lost = F.aggregate("_judged", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["bad"], _bare(x["line"])).otherwise(0))
    passing = F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"])
    four = three.withColumns(
        {
            "n_repeat_words": repeated_words(F.col("_grams")),
            "n_dup_lines": (F.size("_fine") - F.size(F.array_distinct("_fine"))).cast("long"),
            "lost_chars": F.when(any_bad, lost).otherwise(F.lit(0).cast("long")),
            "clean_text": F.when(any_bad, F.array_join(passing, "\n")).otherwise(text),
        }
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    verdict = F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST_PERCENT
    five = four.withColumn("base_failed", base_failed)
    return five.withColumn("kept", ~F.col("base_failed") & verdict).drop(*made)


def passing_only(judged: DataFrame) -> DataFrame:
    """The kept rows of what ``assess`` gives. A row goes through a generator first, which a
    filter does not pass (an outer one: of others Spark infers filters below them)."""
    return judged.select(F.inline_outer(F.array(F.struct(*judged.columns)))).filter("kept")


def query(spark, sf_dir: str) -> DataFrame:
    from lumenframe.llm.common import table

    return assess(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle() -> str:
    """DuckDB SQL for the query, written from the rules by themselves."""
    phrases = "|".join(BOILERPLATE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i + 7] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line FROM w),
j AS (SELECT doc_id, line,
        length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS bare,
        len(regexp_extract_all(line, '{WORD}')) AS nw,
        len(regexp_extract_all(line, '{SEPARATOR}')) AS seps,
        len(regexp_extract_all(line, '{SYMBOLS}')) AS syms
      FROM l),
f AS (SELECT *, nw > 0 AND (syms * 100 > bare * {MAX_SYMBOL_PERCENT}
        OR (NOT regexp_matches(line, '{SENTENCE_MARK}') AND nw >= {MIN_PROSE_WORDS})
        OR (seps >= {MIN_SEPARATORS} AND seps * {WORDS_PER_SEPARATOR} >= nw)
        OR (regexp_matches(lower(line), '{phrases}') AND length(line) <= {MAX_BOILERPLATE_CHARS})) AS bad FROM j),
x AS (SELECT doc_id, sum(CASE WHEN bad THEN bare ELSE 0 END) AS lost,
        count(*) FILTER (WHERE nw > 0) - count(DISTINCT line) FILTER (WHERE nw > 0) AS dups FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, x.dups::BIGINT AS n_dup_lines,
        coalesce(c.n_repeat, 0)::BIGINT AS n_repeat_words, x.lost
      FROM w JOIN x USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND lost * 100 <= word_chars * {MAX_LOST_PERCENT} AS kept
FROM m"""
