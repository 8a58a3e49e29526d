"""Numbers, scale words, currencies and spans in text, as column expressions that stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from crossgauge.functions.text import corruption_flags, to_ascii_digits

#: Scale words by multiplier.
SCALES = {
    1e3: ("हजार", "हज़ार", "হাজার", "వేల", "వేయి", "ఆయిరం", "ആയിരം", "thousand"),
    1e5: ("लाख", "লাখ", "লক্ষ", "లక్షల", "లక్ష", "ലക്ഷം", "lakh", "lakhs"),
    1e6: ("मिलियन", "মিলিয়ন", "మిలియన్", "ദശലക്ഷം", "million"),
    1e7: ("करोड़", "करोड", "কোটি", "కోట్ల", "కోటి", "കോടി", "crore", "crores"),
    1e9: ("बिलियन", "বিলিয়ন", "బిలియన్", "ബില്യൺ", "अरब", "billion"),
    1e12: ("ट्रिलियन", "ট্রিলিয়ন", "trillion"),
}
#: Currency tokens by code.
CURRENCIES = {
    "INR": ("₹", "rs", "rs.", "inr", "रुपये", "रुपए", "रु", "रुपया", "টাকা", "রুপি", "রুপী", "రూపాయల", "రూపాయి", "రూ", "രൂപ"),
    "USD": ("$", "usd", "डॉलर", "ডলার", "డాలర్", "ഡോളർ", "dollar", "dollars"),
    "EUR": ("€", "euro", "यूरो", "ইউরো"),
    "GBP": ("£", "pound", "पाउंड", "পাউন্ড"),
}
PERCENTS = ("%", "प्रतिशत", "फीसदी", "শতাংশ", "শতকরা", "శాతం", "ശതമാനം", "percent")
#: A comma between digits that groups, a plain number, a grouped number, and the reach of a scale word.
GROUPING_COMMA = r",(?<=\d,)\s*(?=\d{3}(?!\d))"
PLAIN = r"\d+(?:\.\d+)?"
GROUPED = r"\d+(?:,\s?\d{2,3}(?!\d))*(?:\.\d+)?"
REACH = 12
TOLERANCE = 1e-6


#: A number of folded text without grouping commas, and up to REACH characters behind it that aren't digits.
VALUE = rf"({PLAIN})([^0-9]{{0,{REACH}}})"
_WORDS = sorted(((w, m) for m, ws in SCALES.items() for w in ws), key=lambda x: -len(x[0]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`value`, evaluated once a row, as the variable of `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_thousands(text: Column) -> Column:
    return F.regexp_replace(text, GROUPING_COMMA, "")


def currencies(text: Column) -> Column:
    """Sorted distinct codes whose tokens occur in the lower-cased text."""
    return let(F.lower(text), _codes)


def _codes(low: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_any_of(low, tokens), code) for code, tokens in sorted(CURRENCIES.items())]))


def _any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])


def percent_markers(text: Column) -> Column:
    return let(F.lower(text), _percents)


def _percents(low: Column) -> Column:
    """Null texts have no count; a marker that isn't there costs no regular expression."""
    count = lambda p: F.when(~F.contains(low, F.lit(p)), F.lit(0)).otherwise(F.regexp_count(low, F.lit(re.escape(p) if p == "%" else p)))
    return sum((count(p) for p in PERCENTS), F.lit(0))


def parse_number(text: Column) -> Column:
    """One numeric field as a double: digits folded, separators dropped; null if it isn't a number."""
    return F.rtrim(F.regexp_replace(to_ascii_digits(text), r"[,\s]", ""), F.lit(".,")).try_cast("double")


def numerals(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(to_ascii_digits(text), F.lit(f"({PLAIN})"), 1))


def numeral_count_matches(source: Column, target: Column) -> Column:
    return numerals(source) == numerals(target)


def span_matches(text: Column, start: Column, end: Column, number: Column) -> Column:
    """Whether text[start:end] is the number as written."""
    return F.substring(text, start + 1, end - start) == F.trim(number)


# ---- values with scale words


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(a))


def scale_of(gap: Column) -> Column:
    """The multiplier of the longest scale word in what stands behind a number, 1 if there is none."""
    return F.coalesce(*[F.when(F.contains(gap, F.lit(w)), F.lit(m)) for w, m in _WORDS], F.lit(1.0))


def values(text: Column) -> Column:
    """Numbers of a text as doubles in order, each times the longest scale word within REACH characters and before another digit."""
    return _values(to_ascii_digits(F.coalesce(text, F.lit(""))))


def _values(folded: Column) -> Column:
    return let(strip_thousands(folded), lambda t: F.zip_with(F.regexp_extract_all(t, F.lit(VALUE), 1), F.regexp_extract_all(t, F.lit(VALUE), 2), lambda n, gap: n.cast("double") * scale_of(gap)))


def _occurrences(numbers: Column) -> Column:
    """Sorted values, each with its number among equal ones."""
    return let(F.array_sort(numbers), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("v"), (i - F.array_position(s, x)).alias("k"))))


def _without(a: Column, b: Column) -> Column:
    return F.transform(F.array_except(a, b), lambda o: o["v"])


def multiset_difference(left: Column, right: Column) -> Column:
    """struct(dropped, added), both ascending: values of left without a partner in right, and the other way round.

    Equal values are partners first; of the others a value takes the least close one that is left over.
    """
    none = F.array().cast("array<double>")

    def step(acc, v):
        at = F.array_min(F.array_compact(F.transform(acc["added"], lambda x, i: F.when(close(v, x), i))))

        def taken(k):
            rest = F.concat(F.slice(acc["added"], F.lit(1), k), F.slice(acc["added"], k + 2, F.size(acc["added"])))
            return F.struct(F.when(k.isNull(), F.array_append(acc["dropped"], v)).otherwise(acc["dropped"]).alias("dropped"), F.when(k.isNull(), acc["added"]).otherwise(rest).alias("added"))

        return let(at, taken)

    def rest(a, b):
        return F.aggregate(_without(a, b), F.struct(none.alias("dropped"), _without(b, a).alias("added")), step)

    return let(_occurrences(left), lambda a: let(_occurrences(right), lambda b: rest(a, b)))


def compare_entities(source: Column, target: Column) -> Column:
    """struct(preserved, dropped, added, currency_lost, percent_lost, corrupted): what a translation kept; null texts are empty."""
    return values_compared(source, target)["c"]


def values_compared(source: Column, target: Column) -> Column:
    """struct(values, c): the source's values, and compare_entities. A text is folded and lower-cased once, whatever is looked for in it."""
    source, target = (F.coalesce(x, F.lit("")) for x in (source, target))

    def told(v, d, lost, fewer):
        kept = (F.size(d["dropped"]) == 0) & (F.size(d["added"]) == 0) & (F.size(lost) == 0) & (fewer == 0)
        c = F.struct(kept.alias("preserved"), d["dropped"].alias("dropped"), d["added"].alias("added"), lost.alias("currency_lost"), fewer.alias("percent_lost"), corruption_flags(target).alias("corrupted"))
        return F.struct(v.alias("values"), c.alias("c"))

    def told_of(a, b):
        lost, fewer = F.array_except(a["codes"], b["codes"]), F.greatest(F.lit(0), a["percents"] - b["percents"])
        return let(multiset_difference(a["values"], b["values"]), lambda d: let(lost, lambda c: let(fewer, lambda p: told(a["values"], d, c, p))))

    def read(text):
        folded = lambda t: let(F.lower(t), lambda low: F.struct(_values(t).alias("values"), _codes(low).alias("codes"), _percents(low).alias("percents")))
        return let(to_ascii_digits(text), folded)

    return let(read(source), lambda a: let(read(target), lambda b: told_of(a, b)))


def entity_flags(comparison: Column) -> Column:
    """Corruption masks entity loss."""
    loss = ~comparison["preserved"] & (F.size(comparison["corrupted"]) == 0)
    return F.concat(comparison["corrupted"], F.when(loss, F.array(F.lit("entity_loss"))).otherwise(F.array().cast("array<string>")))


# ---- spans


def candidates(text: Column, pattern: str = GROUPED) -> Column:
    """array of struct(start, end, value) of the numbers of a text, in characters; folding digits keeps offsets."""
    both = f"([^0-9]*)({pattern})"
    empty = F.array().cast("array<struct<start: int, end: int, value: double>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["n"])
        return F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), parse_number(x["n"]).alias("value"))).alias("out"))

    def found(t):
        pairs = F.zip_with(F.regexp_extract_all(t, F.lit(both), 1), F.regexp_extract_all(t, F.lit(both), 2), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: F.filter(acc["out"], lambda c: c["value"].isNotNull()))

    return let(to_ascii_digits(F.coalesce(text, F.lit(""))), found)


def scale_shifted(source: Column, target: Column, value: Column) -> Column:
    """Whether the quantity that the value denotes among the source's values is among the target's, which come with their scale words."""
    scaled = lambda v: (value != 0) & F.try_divide(v, value).isin(*SCALES)
    return F.exists(source, lambda v: (close(v, value) | F.coalesce(scaled(v), F.lit(False))) & F.exists(target, lambda t: close(v, t)))


def recover_span(target: Column, number: Column, source: Column) -> Column:
    """struct(start, end, matched, recovered, flags): where the annotated number stands in a translation, matched by value."""
    target, source = (F.coalesce(x, F.lit("")) for x in (target, source))

    def matching(found, value):
        return F.filter(found, lambda c: close(value, c["value"]))

    def told(value, moved, hits):
        hit = F.get(hits, F.lit(0))
        none = F.size(hits) == 0
        missing = F.when(moved, F.array(F.lit("span_not_recovered"), F.lit("span_scale_shift"))).otherwise(F.array(F.lit("span_not_recovered")))
        several = F.when(F.size(hits) > 1, F.array(F.lit("span_ambiguous"))).otherwise(F.array().cast("array<string>"))
        flags = F.when(value.isNull(), F.array(F.lit("span_unparseable_source"))).when(none, missing).otherwise(several)
        return F.struct(hit["start"].alias("start"), hit["end"].alias("end"), F.substring(target, hit["start"] + 1, hit["end"] - hit["start"]).alias("matched"), hit.isNotNull().alias("recovered"), flags.alias("flags"))

    def by_value(value):
        def by_hits(grouped):
            moved = F.coalesce((F.size(grouped) == 0) & (source != "") & scale_shifted(values(source), values(target), value), F.lit(False))
            plain = lambda m: F.when((F.size(grouped) > 0) | m | value.isNull(), grouped).otherwise(matching(candidates(target, PLAIN), value))
            return let(moved, lambda m: let(plain(m), lambda hits: told(value, m, hits)))

        return let(matching(candidates(target), value), by_hits)

    return let(parse_number(number), by_value)
