"""Language identification by string kernels.

Kernel: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set of byte n-grams (n = 1 to 3, A-Z lower-cased)
that occur in a text: a blended-spectrum presence kernel. Training texts are a bounded sample; landmarks are some of
them (Nystroem), and one-versus-rest kernel ridge regression is solved on the driver. A batch of texts is scored by
two matrix products: presence x landmarks, kernel x weights.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import _LOWER, chunks, documents, held_out, string_bytes

UNDETERMINED = "und"
#: N-grams outside the landmarks only count for |G(x)|, through so many hash slots.
OTHER = 4096
#: Bounds of the fitted sample: labelled texts, shared evenly by the languages, their longest size in bytes (so at most 200 MB reach
#: the driver), landmarks per language.
SAMPLE = 3000
LONGEST = 1 << 16
LANDMARKS = 40
RIDGE = 1e-2
#: Texts times columns of a dense presence matrix.
CELLS = 1 << 23
#: A document whose best score is lower is rejected by the pipeline.
MIN_SCORE = 0.3
#: So is one of whose byte 3-grams without digits, by occurrences, a smaller part occurs in the landmarks: a score near 0.5 only says
#: that a text is unlike every learned language.
MIN_KNOWN = 0.5


def _grams(data: np.ndarray, off: np.ndarray):
    """(document, code) arrays for n = 1, 2, 3; codes of different n differ; no n-gram spans two texts."""
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    low = _LOWER[data].astype(np.int32)
    yield doc, low
    for n in (2, 3):
        if len(low) < n:
            return
        ok = doc[n - 1 :] == doc[: len(doc) - n + 1]
        code = low[: len(low) - 1] * 256 + low[1:] if n == 2 else (low[:-2] * 256 + low[1:-1]) * 256 + low[2:]
        yield doc[: len(code)][ok], code[ok] + (0, 0, 256, 256 + 65536)[n]


_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CODES = 256 + 65536 + (1 << 24)


class Kernel:
    """Landmark n-grams as columns, then the fitted weights."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(labels))
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        chosen: list[int] = []
        for lang in self.langs:
            chosen += [i for i, x in enumerate(labels) if x == lang][:landmarks]
        data = np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8)
        sub = np.concatenate(([0], np.cumsum([len(texts[i]) for i in chosen]))).astype(np.int64)
        self.codes = np.unique(np.concatenate([c for _, c in _grams(data, sub)] or [np.zeros(0, np.int32)]))
        self._table = None
        self.width = len(self.codes)
        marks, size = self.presence(data, sub)
        self.marks = np.ascontiguousarray((marks / np.sqrt(np.maximum(size, 1))[:, None]).T)  # columns are landmarks
        kmm = (marks @ self.marks) / np.sqrt(np.maximum(size, 1))[:, None]
        value, vector = np.linalg.eigh(kmm.astype(np.float64))
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        gram, cross = 0.0, 0.0
        step = 256
        for i in range(0, len(texts), step):
            part = np.frombuffer(b"".join(texts[i : i + step]), np.uint8)
            phi = self.kernel(part, off[i : i + step + 1] - off[i]) @ root
            y = np.array([[1.0 if x == lang else -1.0 for lang in self.langs] for x in labels[i : i + step]])
            gram, cross = gram + phi.T @ phi, cross + phi.T @ y
        self.weights = (root @ np.linalg.solve(gram + ridge * len(texts) * np.eye(root.shape[1]), cross)).astype(np.float32)

    def table(self) -> np.ndarray:
        """n-gram code -> column; made once in each process."""
        if self._table is None:
            table = np.empty(_CODES, np.uint16 if self.width + OTHER <= 1 << 16 else np.uint32)
            for i in range(0, _CODES, 1 << 18):  # the other n-grams' slots, without large arrays on the way
                code = np.arange(i, min(i + (1 << 18), _CODES), dtype=np.uint32)
                table[i : i + len(code)] = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)) + np.uint32(self.width)
            table[self.codes] = np.arange(self.width)
            self._table = table
        return self._table

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def presence(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros((len(off) - 1, self.width + OTHER), bool)
        table = self.table()
        for doc, code in _grams(data, off):
            seen[doc, table[code]] = True
        return seen[:, : self.width].astype(np.float32), seen.sum(1)

    def known(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per text the share of its 3-grams without a digit that occur in a landmark; 1 for texts too short to have a 3-gram."""
        n, hit = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for k, (doc, code) in enumerate(_grams(data, off)):
            if k == 2:
                low = code - (256 + 65536)
                ok = ~(_DIGIT[low >> 16] | _DIGIT[low >> 8 & 255] | _DIGIT[low & 255])
                n = np.bincount(doc[ok], minlength=len(n))
                hit = np.bincount(doc[ok], self.table()[code[ok]] < self.width, len(hit))
        return np.where(np.diff(off) < 3, 1.0, hit / np.maximum(n, 1))

    def kernel(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros((len(off) - 1, self.marks.shape[1]), np.float32)
        step = max(1, CELLS // (self.width + OTHER))
        for i in range(0, len(out), step):  # some texts at a time: a batch of short ones would make a wide matrix
            cut = off[i : i + step + 1]
            seen, size = self.presence(data[cut[0] : cut[-1]], cut - cut[0])
            out[i : i + step] = (seen @ self.marks) / np.sqrt(np.maximum(size, 1))[:, None].astype(np.float32)
        return out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.kernel(data, off) @ self.weights


def training_sample(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """At most `sample` (text, lang) rows that aren't held out, chosen by a hash of the id; bounded in rows and bytes.

    Every language gets an equal part, the `sample` most frequent ones if there are more. Of rows with one id and
    language the one with the least text counts; held-out rows, null ids, null languages and empty texts are left out.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.octet_length("text").between(1, longest)) & F.coalesce(~held_out(), F.lit(False)))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return []
    each = sample // len(counts)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("o")
    shares = docs.sparkSession.createDataFrame([(r["lang"], math.ceil(min(1.0, 1.5 * each / r["count"]) * (1 << 30))) for r in counts], "lang string, share long")
    few = usable.select("doc_id", order, "text", "lang").join(F.broadcast(shares), "lang").where("o < share")  # at most `sample` languages
    few = few.groupBy("lang", "o", "doc_id").agg(F.min("text").alias("text"))
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("o", "doc_id"))).where(F.col("k") <= each)
    return [(r["text"], r["lang"]) for r in ranked.orderBy("o", "lang", "doc_id").select("text", "lang").toLocalIterator()]


def identify(docs: DataFrame, kernel: Kernel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; `und` with score 0 for null texts and texts without a letter.

    Without any labelled row (kernel None) everything is `und`. Long texts are read whole. Null ids stay null and aren't
    held out; repeated rows each give a row; of tied languages the first by name counts; other columns are not read.
    """

    model = docs.sparkSession.sparkContext.broadcast(kernel)  # bounded: landmarks only

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, lang, score in _judged(batch, 2, model.value):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def _judged(batch, text: int, kernel: Kernel | None):
    """(rows, languages, scores) of the parts of a batch whose column number `text` is the text."""
    import regex

    letter = regex.compile(r"\p{L}")
    for i, j in chunks(batch.column(text)):
        part = batch.slice(i, j - i)
        texts = part.column(text)
        lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if kernel is not None:
            f = kernel.scores(*string_bytes(texts))
            best = f.argmax(1)
            value = np.clip((1 + f[np.arange(len(f)), best]) / 2, 0, 1)
            for r, t in enumerate(texts.to_pylist()):
                if t and letter.search(t):
                    lang[r], score[r] = kernel.langs[best[r]], value[r]
        yield part, lang, score


def keep_identified(docs: DataFrame, kernel: Kernel | None, least: float = MIN_SCORE, known: float = MIN_KNOWN) -> DataFrame:
    """docs' rows, all columns, whose language is determined with a score of at least `least` and whose 3-grams are known to a share of at least `known`."""
    model, at = docs.sparkSession.sparkContext.broadcast(kernel), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, lang, score in _judged(batch, at, model.value):
                seen = np.zeros(len(lang)) if model.value is None else model.value.known(*string_bytes(part.column(at)))
                yield part.filter(pa.array([x != UNDETERMINED and bool(s >= least and k >= known) for x, s, k in zip(lang, score, seen, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel | None:
    rows = training_sample(docs, sample)
    if not rows:
        return None
    return Kernel([t.encode() for t, _ in rows], [x for _, x in rows], landmarks, ridge)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model trained on a bounded sample of labelled ones that aren't held out."""
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
