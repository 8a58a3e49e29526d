"""License scan by canonical digest: whole texts, runs of lines and lines are normalised and matched to known digests.

Canonical form: lower case, equivalent spellings folded, copyright lines dropped, punctuation and white space made
single blanks. The known side is a fixed table of notices and of whole licence texts, so it is broadcast by
construction; the join stays map-side and the corpus is never shuffled. Runs of lines are looked for from lines that
start as a known text does: a text has a fixed count of words, so a start has one end a text, and only that is hashed.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from crossgauge.llm.common import documents
from crossgauge.llm.license_texts import TEXTS

#: Licence notices (SPDX id, family, notice text).
NOTICES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "This project is licensed under the Apache License 2.0."),
    ("BSD-2-Clause", "permissive", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "permissive", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "non-commercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "share-alike", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "public-domain", "Licensed under CC0 1.0."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "permissive", "Released under the ISC License."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MPL-2.0", "copyleft", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: Spellings that mean the same word in a licence.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub-license", "sublicense"),
    ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("fulfil", "fulfill"),
    ("noncommercial", "non commercial"), ("creative commons attribution", "cc by"), ("gnu gpl", "gnu general public license"),
)
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright\b|\(c\)|©).*$"


def canonical(text: Column) -> Column:
    """Canonical form as a column; null stays null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {_plain(a)} "), F.lit(f" {_plain(b)} "))
    return F.trim(out)


def _plain(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def canonical_text(text: str) -> str:
    """The same form on the driver, for the known notices."""
    out = f" {_plain(re.sub(COPYRIGHT_LINE, '', text.lower()))} "
    for a, b in SPELLINGS:
        out = out.replace(f" {_plain(a)} ", f" {_plain(b)} ")
    return out.strip()


def known_digests(spark: SparkSession, notices=NOTICES, texts=TEXTS) -> DataFrame:
    rows = {(hashlib.sha256(canonical_text(t).encode()).hexdigest(), i, f) for i, f, t in notices} | {(x, i, f) for i, f, _, _, _, x in texts}
    return spark.createDataFrame(sorted(rows), "digest string, license_id string, family string")


#: Every spelling of every notice and whole text has one of these in its lower-cased text; canonical_text can't make them from anything else.
STEMS = ("licen", "permi")
#: First words by which a run of lines is recognised as the start of a known text.
HEAD = 3
#: A line that starts with `copyright` and goes on so is part of a wrapped licence, not somebody's notice.
_BODY = re.compile(r"copyright\W+(notices?|holders?|owners?|licen[cs]es?|laws?|and|or|in|on|to|the|is|of|for|by law|statement|interest|protection|permission|treaty|disclaimer|status|patent|related|the software)\b")
_OWN = re.compile(r"[\W_]*(copyright\b|\(c\)|©)")
_YEAR = re.compile(r"\b(19|20)\d\d\b|copyright|[<\[{](year|yyyy)")
_PARTS = [(_plain(a).split(), _plain(b).split()) for a, b in SPELLINGS]


def line_words(line: str) -> list[str]:
    """Words of one line of a licence; none for copyright notices and `all rights reserved`."""
    low = line.lower()
    at = _OWN.match(low)
    if at and not (_BODY.match(low, at.start(1)) if at[1] == "copyright" else not _YEAR.search(low)):
        return []
    words = re.findall(r"[a-z0-9]+", low)
    return [] if words == ["all", "rights", "reserved"] else words


def _folded(words: list[str], last: list[bool]) -> tuple[list[str], list[bool]]:
    """Equivalent spellings made one; last: whether a word ends its line."""
    for a, b in _PARTS:
        if a[0] not in words:
            continue
        w, e, i = [], [], 0
        while i < len(words):
            if words[i : i + len(a)] == a:
                w += b
                e += [False] * (len(b) - 1) + [last[i + len(a) - 1]]
                i += len(a)
            else:
                w.append(words[i])
                e.append(last[i])
                i += 1
        words, last = w, e
    return words, last


def run_words(text: str) -> list[str]:
    """Canonical words of a text of several lines."""
    words = [w for x in text.split("\n") for w in line_words(x)]
    return _folded(words, [False] * len(words))[0]


def known_runs(notices=NOTICES, texts=TEXTS) -> dict:
    """First words -> [(words, digest, license_id, family)] of the notices and texts, longest first."""
    out: dict[tuple, set] = {}
    for i, f, t in notices:
        w = canonical_text(t).split()
        out.setdefault(tuple(w[:HEAD]), set()).add((len(w), hashlib.sha256(" ".join(w).encode()).hexdigest(), i, f))
    for i, f, head, n, _, digest in texts:
        out.setdefault(tuple(head.split()), set()).add((n, digest, i, f))
    return {k: sorted(v, reverse=True) for k, v in out.items()}


def runs(text: str, known: dict) -> list[tuple[str, str, str]]:
    """(license_id, family, scope) of the runs of two or more lines with words that equal a known text.

    scope is 'text' if no other line has words, else 'lines'. A run inside a longer one of the same licence doesn't
    count, nor does a whole text that the digest of the whole text finds anyway.
    """
    lines = [w for w in map(line_words, text.split("\n")) if w]
    words = [x for w in lines for x in w]
    last = [k == len(w) - 1 for w in lines for k in range(len(w))]
    found, at = [], 0
    for line in lines:
        head, _ = _folded(words[at : at + 4 * HEAD], last[at : at + 4 * HEAD])
        for n, digest, i, f in known.get(tuple(head[:HEAD]), ()):
            w, e = _folded(words[at : at + 2 * n + 8], last[at : at + 2 * n + 8])
            if n <= len(w) and e[n - 1] and n > len(_folded(line, [False] * len(line))[0]) and hashlib.sha256(" ".join(w[:n]).encode()).hexdigest() == digest:
                stop = at + n if len(w) == len(words[at : at + 2 * n + 8]) else at + _raw(words[at:], last[at:], n)
                found.append((at, stop, digest, i, f))
        at += len(line)
    whole = hashlib.sha256(canonical_text(text).encode()).hexdigest() if found else ""
    out = []
    for a, b, digest, i, f in found:
        inside = any((c, d) != (a, b) and c <= a and b <= d and i == j for c, d, _, j, _ in found)
        everything = a == 0 and b == len(words)
        if not inside and not (everything and whole == digest):
            out.append((i, f, "text" if everything else "lines"))
    return out


def _raw(words: list[str], last: list[bool], n: int) -> int:
    """How many words as they stand make the first n folded ones: the line end where the count is reached."""
    for k in range(max(1, n // 2), min(len(words), 2 * n + 8) + 1):
        if last[k - 1] and len(_folded(words[:k], last[:k])[0]) == n:
            return k
    return n


#: Known digests that are broadcast; a larger table is joined by exchange.
KNOWN_ROWS = 1 << 20


def license_scan(docs: DataFrame, known: DataFrame, longest: int | None = None, stem: str | tuple[str, ...] | None = None, known_lines: dict | None = None) -> DataFrame:
    """doc_id, license_id, family, scope ('text', 'lines' or 'line'), n_hits: every known licence that a document holds as a whole text, a run of lines or a line.

    longest: the most characters that a known canonical text has; a longer unit can't equal one and isn't hashed
    (canonical text is never longer than the unit with one blank a character, so nothing is lost).
    stem: letters, one of which any unit equal to a known text must hold as they are; others aren't normalised.
    known_lines: the known texts for runs of lines (known_runs() by default).
    Null and empty texts give no rows; repeated lines count in n_hits, and so do rows with one doc_id (null ids are one);
    other columns are not read; an empty table gives no row.
    """
    base = docs.select("doc_id", F.col("text").alias("_t")).where(F.col("_t").isNotNull())
    units = base.select(
        "doc_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("text").alias("scope"), F.col("_t").alias("unit"))),
                F.transform(F.split("_t", "\n"), lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))),
            )
        ).alias("u"),
    ).select("doc_id", "u.scope", "u.unit")
    stems = (stem,) if isinstance(stem, str) else stem or ()

    def may_hold(c):
        return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(x)) for x in stems], F.lit(not stems))

    units = units.where(may_hold("unit"))
    units = units.withColumn("canon", canonical(F.col("unit"))).where(F.col("canon") != "")
    if longest is not None:
        units = units.where(F.length("canon") <= longest)
    few = known.count() <= KNOWN_ROWS
    hits = units.withColumn("digest", F.sha2("canon", 256)).join(F.broadcast(known) if few else known, "digest")
    table = known_runs() if known_lines is None else known_lines

    def in_runs(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for x in runs(t, table)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([pa.array([x.as_py() for x in cols[0]], batch.schema.field(0).type), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["doc_id", "license_id", "family", "scope"])

    whole = base.where(may_hold("_t") & F.contains(F.col("_t"), F.lit("\n"))).mapInArrow(in_runs, StructType([base.schema["doc_id"], *[StructField(c, StringType()) for c in ("license_id", "family", "scope")]]))
    hits = hits.select("doc_id", "license_id", "family", "scope").unionByName(whole)
    return hits.groupBy("doc_id", "license_id", "family", "scope").agg(F.count("*").alias("n_hits"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and whole licence texts in all documents."""
    texts = [canonical_text(t) for _, _, t in NOTICES]
    stems = STEMS if all(any(x in t for x in STEMS) for t in texts) else None
    return license_scan(documents(spark, sf_dir), known_digests(spark), max([*map(len, texts), *[n for *_, n, _ in TEXTS]]), stems)


def _sql_canonical(x: str) -> str:
    out = rf"regexp_replace(lower({x}), '(?m)^[ \t]*(copyright\b|\(c\)|\x{{00a9}}).*$', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {_plain(a)} ', ' {_plain(b)} ')"
    return f"trim({out})"


ORACLE = f"""
WITH known(license_id, family, canon) AS (SELECT DISTINCT license_id, family, {_sql_canonical('notice')} FROM
  (VALUES {", ".join(f"('{i}', '{f}', '{t}')" for i, f, t in NOTICES)}) AS n(license_id, family, notice)),
u AS (SELECT doc_id, 'text' AS scope, text AS unit FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, scope, {_sql_canonical('unit')} AS canon FROM u)
SELECT doc_id, license_id, family, scope, count(*) AS n_hits FROM c JOIN known USING (canon) GROUP BY ALL
"""
