"""Quality rules, line first: judge every line, drop the failing ones, reject documents that lose too much.

DataFrame expressions only: one narrow projection over the scan, no shuffle, so it is as wide as the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import GAP, documents, let

SYMBOLS = r"[#*$%&|<>]"
#: Fixed rules per line.
STOPS = ".!?:;…。！？।॥"
CLOSING = "\"'”’»)] \t\n\v\f\r"  # may follow the stop
#: A line of so many sentences may end without a stop.
SENTENCE, SENTENCES = "[.!?] ", 3
NAVIGATION = r"(?i)^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|read more|share|contact us|about us)\b.{0,40}$"
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "lorem ipsum",
    "subscribe to our", "click here",
)
MAX_BARS = 2
MAX_SYMBOL_SHARE = 0.1
MIN_SHOUT = 12
MAX_LOST = 0.3


def _boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in BOILERPLATE])


def line_passes(line: Column, symbols_in_text: Column | None = None, boilerplate_in_text: Column | None = None) -> Column:
    """True for a line that reads like prose: ends a sentence (or holds several) and is neither navigation, boilerplate nor shouting.

    The two optional columns say whether the whole text has any; they only spare work.
    """
    n = F.length(line)
    last = F.right(F.rtrim(line, F.lit(CLOSING)), F.lit(1))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    bars = F.regexp_count(line, F.lit(r"\|"))
    symbolic = (bars > MAX_BARS) | (symbols > MAX_SYMBOL_SHARE * n)
    boiler = _boilerplate(line)
    return (
        ((last != "") & F.contains(F.lit(STOPS), last) | (F.regexp_count(line, F.lit(SENTENCE)) >= SENTENCES))
        & ~(symbolic if symbols_in_text is None else F.when(symbols_in_text, symbolic).otherwise(False))
        & ~(~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= MIN_SHOUT))
        & ~line.rlike(NAVIGATION)
        & ~(boiler if boilerplate_in_text is None else F.when(boilerplate_in_text, boiler).otherwise(False))
    )


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _word_chars(text: Column) -> Column:
    return F.length(F.concat_ws("", F.split(text, GAP))).cast("long")


def _covered(p: Column) -> Column:
    """Words in the union of the 3-word windows that begin at the sorted places p."""
    gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)


def _window(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _repeat_by_text(w: Column) -> Column:
    """Words inside repeated windows: sort the windows' texts, mark equal neighbours, merge."""

    def marked(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["t"] == F.get(s, b)["t"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(s, k)["p"]))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(_window(w, i).alias("t"), i.alias("p")))
    return let(let(F.sort_array(windows), marked), _covered)


#: Low bits of a packed long that hold a window's place; the rest are bits of its hash.
PLACE = 20


def _repeat_words(words: Column) -> Column:
    """The same count, mostly on longs: texts without equal window hashes have none; else (hash bits, place) are sorted as longs.

    Neighbours with equal hash bits are compared as text. If any differ, or the text has 2**20 windows, the count is taken by text.
    """
    place = (1 << PLACE) - 1

    def packed(w: Column) -> Column:
        def one(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
            return h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))

        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), one)

    def by_hash(w: Column) -> Column:
        high = lambda x: F.shiftright(x, PLACE)
        at = lambda x: x.bitwiseAND(F.lit(place)).cast("int")

        def pairs(s: Column) -> Column:  # neighbours with equal hash bits, as two places
            found = F.transform(s, lambda x, k: F.when(high(x) == high(F.get(s, k + 1)), F.struct(at(x).alias("a"), at(F.get(s, k + 1)).alias("b"))))
            return F.filter(found, lambda x: x.isNotNull())

        def count(p: Column) -> Column:
            places = F.sort_array(F.array_distinct(F.flatten(F.transform(p, lambda x: F.array(x["a"], x["b"])))))
            true = F.forall(p, lambda x: _window(w, x["a"]) == _window(w, x["b"]))
            return F.when(F.size(p) == 0, F.lit(0).cast("long")).when(true, let(places, _covered)).otherwise(_repeat_by_text(w))

        return let(let(F.sort_array(packed(w)), pairs), count)

    few, many = F.size(words) < 4, F.size(words) > place
    return F.when(few, F.lit(0).cast("long")).when(many, let(words, _repeat_by_text)).otherwise(let(words, by_hash))


def line_first_clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """doc_id, clean_text, base statistics and verdict of every document.

    Null text counts as empty: no words, base_failed. Extra input columns are ignored; duplicate ids give one row each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", GAP), lambda x: x != "")
    base = docs.select("doc_id", text.alias("text"))
    base = base.select(
        "*", F.filter(F.split("text", "\n"), _has_word).alias("lines"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _boilerplate(F.col("text")).alias("boiler"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.concat_ws("", w)).cast("long").alias("chars"), _repeat_words(w).alias("again"))).alias("w"),
    )
    passes = lambda x: line_passes(x, F.col("n_symbols") > 0, F.col("boiler"))
    counted = base.select(
        "doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("w.again").alias("n_repeat_words"),
        F.array_join(F.filter("lines", passes), "\n").alias("clean_text"),
        let(F.col("lines"), lambda a: F.struct(
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"),
            _word_chars(F.concat_ws("", F.filter(a, lambda x: ~passes(x)))).alias("lost"),
        )).alias("judged"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        counted.withColumns({"n_dup_lines": F.col("judged.dup"), "kept_chars": F.col("word_chars") - F.col("judged.lost")})
        .drop("judged")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("kept_chars") >= (1 - max_lost) * F.col("word_chars")))
    )


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_first_clean(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


_SQL_SPACES = r"[ \t\n\v\f\r]"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SQL_SPACES}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS t
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS again FROM rep, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
l AS (SELECT doc_id, x, length(regexp_replace(x, '{_SQL_SPACES}', '', 'g')) AS c
      FROM (SELECT doc_id, unnest(lines) AS x FROM w)),
good AS (SELECT doc_id, sum(c) AS c FROM l
  WHERE (len(regexp_extract_all(x, '{SENTENCE}')) >= {SENTENCES} OR regexp_matches(x, '[.!?:;\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}\x{{0964}}\x{{0965}}]["''\x{{201D}}\x{{2019}}\x{{00BB}})\] \t\n\v\f\r]*$'))
    AND length(x) - length(replace(x, '|', '')) <= {MAX_BARS}
    AND length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) <= {MAX_SYMBOL_SHARE} * length(x)
    AND NOT (NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}') AND length(x) >= {MIN_SHOUT})
    AND NOT regexp_matches(x, '(?i)^[ \t\n\v\f\r]*(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|read more|share|contact us|about us)\b.{{0,40}}$')
    AND NOT ({" OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)})
  GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{_SQL_SPACES}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(again, 0)::BIGINT AS n_repeat_words, coalesce(good.c, 0)::BIGINT AS kept_chars
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN good USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= {1 - MAX_LOST} * word_chars AS kept, kept_chars FROM f
"""
