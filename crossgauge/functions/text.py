"""Text and Unicode expressions; all but the NFC test and the token weights stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

#: Script blocks without the shared dandas, and each numbering system's zero.
SCRIPTS = {
    "Deva": "[ऀ-ॣ०-ॿ]",
    "Beng": "[ঀ-৿]",
    "Telu": "[ఀ-౿]",
    "Mlym": "[ഀ-ൿ]",
}
ZEROS = {"Deva": 0x0966, "Beng": 0x09E6, "Telu": 0x0C66, "Mlym": 0x0D66, "ASCII": 0x30}
SCRIPT_OF = {"hin": "Deva", "ben": "Beng", "tel": "Telu", "mal": "Mlym"}
REPLACEMENT, ZWNJ, ZWJ = "�", "‌", "‍"
#: Corruption patterns.
PLACEHOLDER = r"<[^>]{1,40}>"
ESCAPE = r"(?iu)u09[0-9a-f]{2}|u093[0-9a-f]|യു[0-9]|ইউ[0-9]|यू[0-9]|యు[0-9]"
PUNCTUATION = "[।॥,.!?;:\"'()\\[\\]—-]"
#: Case endings by language.
SUFFIXES = {
    "hin": ("में", "से", "को", "की", "का", "के", "पर", "ने"),
    "ben": ("দের", "গুলো", "টির", "এর", "কে", "তে", "র", "এ"),
    "tel": ("లోని", "నుండి", "తోని", "లో", "కి", "ను", "తో", "కు"),
    "mal": ("യിലെ", "ിന്റെ", "ോടെ", "ിൽ", "ൽ", "ിന്", "ോട്", "ുടെ"),
}
#: Suffixes of the stand-in languages of the test tables.
LATIN_SUFFIXES = {"en": ("ing", "ed", "es", "s"), "de": ("en", "er", "e"), "fr": ("ment", "es", "e"), "es": ("mente", "os", "as", "o", "a")}
STRIP = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def _class(zero: int) -> str:
    return f"[{chr(zero)}-{chr(zero + 9)}]"


def script_counts(text: Column) -> Column:
    return F.create_map(*[x for name, cls in SCRIPTS.items() for x in (F.lit(name), F.regexp_count(text, F.lit(cls)))])


def foreign_scripts(text: Column, own: Column) -> Column:
    """Scripts other than `own` that occur in the text, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(script_counts(text), lambda k, v: (k != own) & (v > 0))))


def digit_counts(text: Column) -> Column:
    return F.create_map(*[x for name, zero in ZEROS.items() for x in (F.lit(name), F.regexp_count(text, F.lit(_class(zero))))])


def to_ascii_digits(text: Column) -> Column:
    others = [z for n, z in ZEROS.items() if n != "ASCII"]
    return F.translate(text, "".join(chr(z + d) for z in others for d in range(10)), "0123456789" * len(others))


def digit_systems(text: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(digit_counts(text), lambda k, v: v > 0)))


def digit_transition(source: Column, target: Column) -> Column:
    """none, gained, dropped, same or converted, by the digit systems of two texts."""
    a, b = digit_systems(source), digit_systems(target)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "none")
        .when(F.size(a) == 0, "gained")
        .when(F.size(b) == 0, "dropped")
        .when(a == b, "same")
        .otherwise("converted")
    )


@F.pandas_udf(BooleanType())
def is_nfc(text: pd.Series) -> pd.Series:
    """Whether a text is in NFC; null stays null."""
    from unicodedata import is_normalized

    return text.map(lambda t: None if t is None else is_normalized("NFC", t))


@F.pandas_udf(LongType())
def token_weights(key: pd.Series, n: pd.Series) -> pd.Series:
    """Sum of keys.md5_bucket(100, key, i) over a document's token numbers i from 1 to n; null keys are left out of the hash as there."""
    from hashlib import md5

    def total(k, n):
        start = md5(b"" if k is None else f"{k}:".encode())
        out = 0
        for i in range(1, n + 1):
            h = start.copy()
            h.update(b"%d" % i)
            out += int.from_bytes(h.digest()[:4]) % 100
        return out

    return pd.Series([total(k, m) for k, m in zip(key, n, strict=True)], dtype="int64")


def length_ratio(source: Column, target: Column) -> Column:
    return (F.length(target) + 1) / (F.length(source) + 1)


def placeholder_leaked(source: Column, target: Column) -> Column:
    return target.rlike(PLACEHOLDER) & ~source.rlike(PLACEHOLDER)


def escape_leaked(text: Column) -> Column:
    return text.rlike(ESCAPE)


def encoding_corrupted(text: Column) -> Column:
    return F.contains(text, F.lit(REPLACEMENT))


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def corruption_flags(text: Column) -> Column:
    return flags(placeholder_leak=text.rlike(PLACEHOLDER), escape_leak=escape_leaked(text))


def clean_words(text: Column) -> Column:
    """White-space words without punctuation, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), lambda w: strip(F.regexp_replace(w, PUNCTUATION, ""))), lambda w: w != "")


def stem_matches(term: Column, stem: Column) -> Column:
    """The stem is the term, the term less its last letter (4 letters or more), or the term and one combining mark."""
    n = F.length(term)
    marked = (F.length(stem) == n + 1) & F.startswith(stem, term) & F.substring(stem, -1, 1).rlike(r"[\p{Mn}\p{Mc}]")
    return (stem == term) | ((n >= 4) & ((stem == F.substring(term, F.lit(1), n - 1)) | marked))


def strip_suffix(word: Column, suffixes: tuple[str, ...]) -> Column:
    """struct(stem, suffix): the longest suffix that leaves a stem; else the word and ''."""
    pattern = "^(.+?)(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$"
    cut = word.rlike(pattern)
    return F.struct(F.when(cut, F.regexp_extract(word, pattern, 1)).otherwise(word).alias("stem"), F.when(cut, F.regexp_extract(word, pattern, 2)).otherwise("").alias("suffix"))


def first_term(text: Column, lexicon: list[str]) -> Column:
    """The first term of the lexicon that the text contains, or null."""
    return F.get(F.filter(F.array(*map(F.lit, lexicon)), lambda t: F.contains(text, t)), 0)


def overlapping_tokens(text: Column, term: Column, offsets: Column) -> Column:
    """Indices of the tokens, structs (s, e), that overlap the term's first occurrence; (0, 0) tokens are special and left out."""
    start = F.instr(text, term) - 1
    end = start + F.length(term)
    hit = lambda o: (o["e"] > start) & (o["s"] < end) & ~((o["s"] == 0) & (o["e"] == 0)) & (start >= 0)
    return F.array_compact(F.transform(offsets, lambda o, i: F.when(hit(o), i)))


def token_count(text: Column) -> Column:
    """The white-space stand-in for a tokenizer."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def fragmentation_ratio(source: Column, target: Column) -> Column:
    """Target tokens per source token; null where the source has none."""
    return F.try_divide(token_count(target).cast("double"), F.nullif(token_count(source).cast("double"), F.lit(0.0)))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.lit(100.0) * x)


def signed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", x)


def clip(text: Column, n: int = 60) -> Column:
    one = F.regexp_replace(text, r"\s+", " ")
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("…"))).otherwise(one)
