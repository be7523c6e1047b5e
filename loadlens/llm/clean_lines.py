"""Quality rules, line first: punctuation, navigation and boilerplate rules judge each line, failing lines go, and
documents that lose too much text go with them. Built-in functions only; one pass, no shuffle.

A text is judged within its row: a very long one costs its task some ten times its size in memory, for its words and the
windows of eight of them, and never more rows or tasks.

Defined cases: a null text counts as empty; a text without words fails the base rules; a line without words is neither
kept nor lost; repeated rows are judged one by one; an empty table gives an empty result; other columns pass through
``cleaned`` unless they bear the name of a column it adds, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is kept if its kept lines hold at least this share (percent) of the characters of its lines.
MIN_KEPT_PERCENT = 60
BOILERPLATE = (
    "licensed under", "released under the", "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "use cookies", "cookie policy", "enable javascript", "subscribe to our newsletter", "lorem ipsum",
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _count(line: Column, others: str) -> Column:
    """Characters left when runs of the others are taken out."""
    return F.length(F.regexp_replace(line, others, ""))


def line_fails(line: Column) -> Column:
    """True where a line breaks a rule.

    punctuation: '!' and '?' more often than every second word, or markup signs more often than every second word, or
    eight words and more without any mark that ends or parts a clause; navigation: three separators and more, one for
    every three words at least; boilerplate: it holds a fixed phrase.
    """
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)

    def rules(n: Column) -> Column:
        shouted = _count(line, "[^!?]+") * 2 > n
        marked = _count(line, "[^#*$%&<>~^=_]+") * 2 > n
        unparted = (n >= 8) & ~line.rlike(r"[.,;:!?…。]")
        separators = _count(line, "[^|›»•]+")
        return shouted | marked | unparted | ((separators >= 3) & (separators * 3 >= n)) | boiler

    return let(F.size(words_of(line)), rules)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    n = F.size(words)

    def covered(grams: Column) -> Column:
        order = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def from_order(s: Column) -> Column:
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: F.coalesce(F.get(s, j)["g"] == F.get(s, j - 1)["g"], F.lit(False))
                | F.coalesce(F.get(s, j)["g"] == F.get(s, j + 1)["g"], F.lit(False)),
            )
            places = F.array_sort(F.transform(twice, lambda j: F.get(s, j)["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, p: F.struct(
                (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")
            )
            return F.aggregate(places, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(order, from_order))

    grams = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " ")
    )
    return F.when(n <= WINDOW, 0).otherwise(let(grams, covered))


def line_stats(docs: DataFrame, text: str = "text", body: str | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_chars, kept_chars, kept; and
    with the text less its failing lines as column body, where that is named."""
    whole = text_of(text)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars"]

    def measured(words: Column) -> Column:
        def by_line(judged: Column) -> Column:
            lines = F.transform(F.filter(judged, lambda x: x["fails"].isNotNull()), lambda x: x["line"])
            kept = F.transform(F.filter(judged, lambda x: x["fails"] == F.lit(False)), lambda x: x["line"])
            left = F.transform(F.filter(judged, lambda x: ~F.coalesce(x["fails"], F.lit(False))), lambda x: x["line"])
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _count(whole, "[^#*$%&|<>]+").cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.length(F.array_join(lines, "")).cast("long").alias("line_chars"),
                F.length(F.array_join(kept, "")).cast("long").alias("kept_chars"),
                *([F.array_join(left, "\n").alias(body)] if body else []),
            )

        # each line is judged once; one without words neither fails nor passes
        fails = lambda line: F.when(line.rlike(WORD), line_fails(line))
        return let(F.transform(F.split(whole, "\n"), lambda line: F.struct(line.alias("line"), fails(line).alias("fails"))), by_line)

    # a generator of one row: a filter on what is measured isn't moved below it, which would measure twice
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*made, "base_failed", "kept"}]
    out = docs.select(*rest, F.inline(F.array(let(words_of(whole), measured))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("line_chars") * MIN_KEPT_PERCENT)
    )


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, without their failing lines; the columns are those of docs (n_chars follows the text)."""
    passed = line_stats(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias(text)), text, "__body").filter("kept")
    columns = [F.col(f"__row.`{c}`").alias(c) if c != text else F.col("__body").alias(c) for c in docs.columns]
    out = passed.select(*columns)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_line_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return line_stats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "line_chars", "kept_chars",
    )


_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), r AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g
), rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r WHERE c >= 2) GROUP BY rid
), ln AS (
  SELECT rid, l, len([x FOR x IN regexp_split_to_array(l, '[\x20\x09-\x0D]+') IF x <> '']) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), lf AS (
  SELECT rid, l, length(regexp_replace(l, '[^!?]+', '', 'g')) * 2 > n
      OR length(regexp_replace(l, '[^#*$%&<>~^=_]+', '', 'g')) * 2 > n
      OR (n >= 8 AND NOT regexp_matches(l, '[.,;:!?\x{{2026}}\x{{3002}}]'))
      OR (length(regexp_replace(l, '[^|\x{{203a}}\x{{00bb}}\x{{2022}}]+', '', 'g')) >= 3
          AND length(regexp_replace(l, '[^|\x{{203a}}\x{{00bb}}\x{{2022}}]+', '', 'g')) * 3 >= n)
      OR {_PHRASES} AS bad
  FROM ln
), ls AS (
  SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS dup, sum(length(l))::BIGINT AS line_chars,
         sum(CASE WHEN bad THEN 0 ELSE length(l) END)::BIGINT AS kept_chars
  FROM lf GROUP BY rid
), a AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ls USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars * 100 >= line_chars * {MIN_KEPT_PERCENT} AS kept,
       line_chars, kept_chars
FROM a
"""
