"""Quality rules, line first: judge every line, remove the failing ones, reject documents that lose too much.

A line fails if it does not end in terminal punctuation, is made of runs of marks, is a menu or a breadcrumb, or holds
boilerplate (in English, French, German or Spanish). Lines that many documents share are no boilerplate by
themselves: all lines of copied documents are such lines.

Everything is built-in SQL functions on one row at a time: no shuffle, no Python on the executors.

Defined results: a null text counts as an empty one (no words, so it fails the base rule); texts of any length are
judged whole; repeated rows are judged one by one; an empty table gives no rows; other columns of the input pass
through untouched, whatever their names, and columns of the same names as the ones added here are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, words

#: Lines in which runs of these make up a quarter of the words are shouting or noise.
NOISE = r"[!?#$%&*]{2,}"
#: Separators of menus and breadcrumbs; a fifth of the words and at least two make a navigation line.
SEPARATOR = r"[|»•·›]"
#: A line that holds one of these, in any case, is boilerplate.
BOILERPLATE = [
    "all rights reserved", "licensed under", "cookie policy", "accept cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "lorem ipsum", "subscribe to our", "click here to", "copyright (c)",
    "tous droits réservés", "politique de confidentialité", "accepter les cookies", "mentions légales", "conditions d'utilisation",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "nutzungsbedingungen", "javascript aktivieren",
    "todos los derechos reservados", "política de privacidad", "aceptar cookies", "términos de uso", "aviso legal",
]
#: A line that ends in another character than these (and spaces) is a heading, a label or a fragment.
TERMINAL = """.!?…:;。！？"'”’»)\\]"""
UNENDED = rf"[^\x20\x09-\x0D{TERMINAL}][\x20\x09-\x0D]*\z"
UNENDED_LINE = rf"[^\x20\x09-\x0D{TERMINAL}][\x20\x09\x0B-\x0D]*(?:\n|\z)"
#: A document that loses more than this percentage of its words with the failing lines is rejected.
MAX_LOST_PERCENT = 50


def boilerplate(text: Column) -> Column:
    lowered = F.lower(text)
    return reduce(or_, (F.contains(lowered, F.lit(phrase)) for phrase in BOILERPLATE))


def line_fails(line: Column) -> Column:
    """True for a line that breaks a punctuation rule, the navigation or the boilerplate rule; blank lines pass."""
    n = F.regexp_count(line, F.lit(WORD))
    noise, separators = F.regexp_count(line, F.lit(NOISE)), F.regexp_count(line, F.lit(SEPARATOR))
    return line.rlike(UNENDED) | ((noise >= 2) & (noise * 4 >= n)) | ((separators >= 2) & (separators * 5 >= n)) | boilerplate(line)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text."""
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = docs.drop(*(c for c in made if c != text))
    body = F.coalesce(F.col(text), F.lit(""))
    words_, grams, lines, again, order, twice, at, sorted_, covered = fresh(docs, "words", "grams", "lines", "again", "order", "twice", "at", "sorted", "covered")
    out = docs.withColumn(words_, words(F.col(text))).withColumn("n_words", F.size(words_).cast("long"))
    out = out.withColumn(
        grams,
        F.expr(f"transform(slice({words_}, 1, greatest(size({words_}) - 2, 0)), (w, i) -> xxhash64(w, get({words_}, i + 1), get({words_}, i + 2)))"),
    ).withColumn(lines, F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)))
    # equal windows have equal hashes: only texts with equal hashes pay for the exact comparison
    out = out.withColumn(again, F.size(F.array_distinct(grams)) < F.size(grams))
    # a few repeated hashes are looked up window by window; where there are many, all windows are compared
    out = out.withColumn(order, F.expr(f"CASE WHEN {again} THEN sort_array({grams}) END"))
    out = out.withColumn(twice, F.expr(f"array_distinct(filter({order}, (x, k) -> x = get({order}, k - 1)))"))
    out = out.withColumn(
        at,
        F.expr(
            f"CASE WHEN size({twice}) <= 16 THEN filter(sequence(0, size({grams}) - 1), i -> array_contains({twice}, {grams}[i]))"
            f" WHEN {again} THEN sequence(0, size({grams}) - 1) END"
        ),
    )
    out = out.withColumn(
        sorted_,
        F.expr(f"sort_array(transform({at}, i -> struct(concat_ws(' ', {words_}[i], {words_}[i + 1], {words_}[i + 2]) AS g, i AS p)))"),
    )
    out = out.withColumn(
        covered,
        F.expr(
            f"array_distinct(flatten(transform(filter({sorted_}, (x, k) -> "
            f"x.g = get({sorted_}, k - 1).g OR x.g = get({sorted_}, k + 1).g), x -> array(x.p, x.p + 1, x.p + 2))))"
        ),
    )
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join(words_, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.when(F.col(covered).isNull(), 0).otherwise(F.size(covered)).cast("long"),
        }
    ).drop(words_, grams, lines, again, order, twice, at, sorted_, covered)


def judge(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Add the base counts, ``clean_text`` (failing lines removed), ``n_lost_words``, ``base_failed`` and ``kept``."""
    docs = docs.drop(*(c for c in ("clean_text", "n_lost_words", "base_failed", "kept") if c != text))
    out = base_counts(docs, text)
    (marked,) = fresh(out, "marked")
    body = F.coalesce(F.col(text), F.lit(""))
    # no line can fail where the whole text has too few marks for one: such texts are not split
    marks = body.rlike(UNENDED_LINE) | (F.regexp_count(body, F.lit(NOISE)) >= 2) | (F.regexp_count(body, F.lit(SEPARATOR)) >= 2) | boilerplate(body)
    good = F.concat_ws("\n", F.filter(F.split(body, "\n"), lambda line: ~line_fails(line)))
    out = out.withColumn(marked, marks).withColumn("clean_text", F.when(F.col(marked), good).otherwise(body))
    left = F.when(F.col(marked), F.regexp_count("clean_text", F.lit(WORD))).otherwise(F.col("n_words"))
    out = out.withColumn("n_lost_words", F.col("n_words") - left).drop(marked)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") * 100 <= F.col("n_words") * max_lost_percent))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned texts, in the columns they came in."""
    own = dict(zip(docs.columns, fresh(docs.select("text"), *(f"own_{c}" for c in docs.columns)), strict=True)) | {"text": "text"}
    judged = judge(docs.select(*(F.col(c).alias(own[c]) for c in docs.columns)))
    # a filter on ``kept`` itself would move below all projections, each of which it would repeat many times over
    (once,) = fresh(judged, "once")
    out = judged.withColumn(once, F.col("kept") & (F.monotonically_increasing_id() >= 0)).filter(once)
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(own[c])).alias(c) for c in docs.columns))


def query(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
b AS (
  SELECT r, doc_id, t, w, len(w) AS n, list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS nb,
         list_filter(ls, lambda l: NOT (
           regexp_matches(l, '@UNENDED@') OR
           (len(regexp_extract_all(l, '[!?#$%&*]{2,}')) >= 2
             AND len(regexp_extract_all(l, '[!?#$%&*]{2,}')) * 4 >= len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
           OR (len(regexp_extract_all(l, '[|»•·›]')) >= 2
             AND len(regexp_extract_all(l, '[|»•·›]')) * 5 >= len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')))
           OR @BOILERPLATE@
         )) AS good
  FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, n - 1)) AS i FROM b WHERE n >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n_rep FROM rep, (VALUES (0), (1), (2)) s(o) GROUP BY r),
f AS (
  SELECT doc_id, n, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(nb) - len(list_distinct(nb)) AS n_dup_lines,
         coalesce(n_rep, 0) AS n_rep, n - len(regexp_extract_all(array_to_string(good, chr(10)), '[^\x20\x09-\x0D]+')) AS lost
  FROM b LEFT JOIN cov USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words,
       (n < 50 OR 100 * n_rep > 50 * n) AS base_failed,
       NOT (n < 50 OR 100 * n_rep > 50 * n) AND lost * 100 <= n * 50 AS kept
FROM f
""".replace("@UNENDED@", UNENDED.replace("'", "''")).replace("@BOILERPLATE@", " OR ".join("contains(lower(l), '" + p.replace("'", "''") + "')" for p in BOILERPLATE))
