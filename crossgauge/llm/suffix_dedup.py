"""Exact substring dedup over the corpus: common-prefix interval trees on a sparse suffix array.

Any 200 bytes hold an anchor: the least 50-gram hash of the window, chosen by content alone, so equal windows hold
equal anchors at equal places. Only anchored suffixes are sorted. The work goes by anchor:

1. every anchor travels as a packed posting (hash of its 50-gram, hash of its context, place); its context is the
   150 bytes before it and 200 from it on, as far as its document goes. Equal contexts are one class whose members
   are wholly repeated; inside a map task they collapse before the exchange, so a hot passage sends one row a task.
2. anchors that have more than one class are compared as text: suffixes from the anchor are sorted (the enhanced suffix
   array), a stack scan of their common prefixes gives the interval tree, and inside every interval the members are
   ordered by what stands before them; runs that agree for 200 bytes in all are maximal repeats, kept with all their
   occurrences, whose left extensions differ (or end).
3. an anchor with more than HOT classes (a passage that a large part of the documents hold, each with other text around)
   is not compared in one task: its suffixes are cut into all their 200-byte windows, which are counted by anchor and hash.
4. what the repeats cover is cut from the documents.

Python holds one document batch or the contexts of one anchor (at most HOT of 350 bytes) at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgauge.llm.common import BROADCAST_IDS, chunks, documents, fresh, mix64, only, prefix_hash, span_hash, stash, stash_map, string_bytes, without

LENGTH = 200
GRAM = 50
POSTINGS_A_BUCKET = 1_000_000
#: Distinct contexts of one anchor that are compared in one task.
HOT = 8192


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, place, bytes before, bytes from it on, gram hash, context hash) of every anchor of the texts."""
    none = np.zeros(0, np.int64)
    n_grams = len(data) - gram + 1
    if n_grams < 1 or len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hash(data)
    begin = np.arange(n_grams)
    h = span_hash(sums, begin, begin + gram)
    low = (h >> np.uint64(32) << np.uint64(32)) | begin.astype(np.uint64)
    width, least = 1, low
    window = length - gram + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n_windows = len(data) - length + 1
    least = np.minimum(least[:n_windows], least[window - width : window - width + n_windows])
    size = np.diff(off)
    valid = np.zeros(n_windows + 1, np.int64)
    long_ = size >= length
    np.add.at(valid, off[:-1][long_], 1)
    np.add.at(valid, off[:-1][long_] + size[long_] - length + 1, -1)
    chosen = np.zeros(n_grams, bool)
    chosen[(least[np.cumsum(valid[:-1]) > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    doc = np.searchsorted(off, place, side="right") - 1
    before = np.minimum(length - gram, place - off[doc])
    after = np.minimum(length, off[doc + 1] - place)
    context = span_hash(sums, place - before, place + after) ^ mix64(before.astype(np.uint64) + np.uint64(1))
    return doc, place - off[doc], before, after, h[place], context


def _postings(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, key, place, before, after, gram, kind): kind 1 if the context is repeated, 2 if its anchor has other contexts, 3 if both."""
    kinds = np.dtype([("gram", "<u8"), ("context", "<u8"), ("place", "<u4"), ("doc", "<u4"), ("before", "<u2"), ("after", "<u2"), ("twice", "u1")])

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in chunks(batch.column(2), 1 << 20):
                part = batch.slice(i, j - i)
                doc, place, before, after, gram, context = anchors(*string_bytes(part.column(2)))
                if not len(doc):
                    continue
                rec = np.zeros(len(doc), kinds)
                for name, x in (("gram", gram), ("context", context), ("place", place), ("doc", doc), ("before", before), ("after", after)):
                    rec[name] = x
                rec = rec[np.lexsort((rec["context"], rec["gram"]))]
                same = (rec["gram"][1:] == rec["gram"][:-1]) & (rec["context"][1:] == rec["context"][:-1])
                rec["twice"][:-1] |= same
                rec["twice"][1:] |= same
                spread = mix64(rec["gram"])  # anchors are least hashes: their own high bits are small
                more = np.concatenate(([False], same))  # a class's further members here are settled: they go anywhere
                rec["twice"][more] = 2
                spread[more] = mix64(rec["place"][more].astype(np.uint64) * np.uint64(1 << 32) + rec["doc"][more])
                bucket = ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                ids = np.stack([np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy()], 1)
                rows = []
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = rec[order[cut[b] : cut[b + 1]]]
                    there, own["doc"] = np.unique(own["doc"], return_inverse=True)
                    table = ids[there]
                    rows.append((b, own.tobytes(), table[:, 0].tolist(), table[:, 1].tolist()))
                kinds_out = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_out, strict=True)], names=["bucket", "rec", "ids", "keys"])

    def gather(batches):
        import pyarrow as pa

        def judged(parts):
            rec = np.concatenate([r for r, _, _ in parts])
            base = np.repeat(np.cumsum([0] + [len(i) for _, i, _ in parts[:-1]]), [len(r) for r, _, _ in parts])
            ids, keys = pa.concat_arrays([i for _, i, _ in parts]), pa.concat_arrays([k for _, _, k in parts])
            owner = base + rec["doc"]
            kind = np.zeros(len(rec), np.int32)
            kind[rec["twice"] == 2] = 1
            live = np.flatnonzero(rec["twice"] < 2)
            live = live[np.lexsort((rec["context"][live], rec["gram"][live]))]
            g, c = rec["gram"][live], rec["context"][live]
            if len(live):
                new_g = np.concatenate(([True], g[1:] != g[:-1]))
                new_c = new_g | np.concatenate(([True], c[1:] != c[:-1]))
                cls, grp = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
                many = np.bincount(cls)[cls] > 1
                many |= np.bincount(cls, rec["twice"][live])[cls] > 0
                several = np.bincount(grp, new_c)[grp] > 1
                kind[live] = many + 2 * (several & new_c)
            use = np.flatnonzero(kind)
            r = rec[use]
            cols = [ids.take(pa.array(owner[use])), keys.take(pa.array(owner[use])), *(pa.array(r[x].astype(np.int32)) for x in ("place", "before", "after")), pa.array(r["gram"].astype(np.int64)), pa.array(kind[use])]
            return pa.record_batch(cols, names=["doc_id", "key", "place", "before", "after", "gram", "kind"])

        now, parts = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.column(0)[row].as_py()
                if b != now and parts:
                    yield judged(parts)
                    parts = []
                now = b
                parts.append((np.frombuffer(batch.column(1)[row].as_py(), kinds), batch.column(2)[row].values, batch.column(3)[row].values))
        if parts:
            yield judged(parts)

    packed = docs.select("doc_id", "key", "text").mapInArrow(emit, "bucket int, rec binary, ids array<long>, keys array<long>")
    return stash_map(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), gather, "doc_id long, key long, place int, before int, after int, gram long, kind int", "anchors")


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def maximal_repeats(contexts: list[tuple[bytes, bytes]], length: int = LENGTH):
    """(common bytes before, common bytes from the anchor on, [(member, its own longest agreement before)]) of every maximal repeat.

    contexts: (reversed bytes before the anchor, bytes from it on).
    """
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    rank = {i: r for r, i in enumerate(sorted(range(len(contexts)), key=lambda i: contexts[i][0]))}
    prefix = [_common(contexts[a][1], contexts[b][1]) for a, b in zip(order, order[1:], strict=False)] + [0]
    stack: list[tuple[int, int]] = []  # (common prefix, left bound) of the open intervals
    for i, now in enumerate(prefix):
        left = i
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            yield from _runs(contexts, rank, order[left : i + 1], min(depth, length), length)
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, left))


def _runs(contexts, rank, members, depth, length):
    """Inside one interval: runs of members that agree before the anchor for what the depth leaves of the length."""
    members = sorted(members, key=rank.__getitem__)
    before = [_common(contexts[a][0], contexts[b][0]) for a, b in zip(members, members[1:], strict=False)]
    need, k = length - depth, 0
    while k < len(before):
        if before[k] < need:
            k += 1
            continue
        end = k
        while end < len(before) and before[end] >= need:
            end += 1
        run = before[k:end]
        yield min(run), depth, [(m, max(run[max(0, x - 1) : x + 1])) for x, m in enumerate(members[k : end + 1])]
        k = end


def _scan(batches):
    """Rows (gram, doc_id, key, place, before, context), sorted by the first four: the spans that repeats cover, as places from and to."""
    import pyarrow as pa

    def close(part):
        pairs = [(ctx[:n][::-1], ctx[n:]) for _, _, _, n, ctx in part]
        most_before, most_after = [-1] * len(part), [0] * len(part)  # all spans of a member hold its anchor: their union is one span
        for _, depth, members in maximal_repeats(pairs):
            for m, before in members:
                most_before[m], most_after[m] = max(most_before[m], before), max(most_after[m], depth)
        return [(part[m][0], part[m][1], part[m][2] - b, part[m][2] + d) for m, (b, d) in enumerate(zip(most_before, most_after, strict=True)) if d]

    def pack(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "key", "start", "stop"])

    now, part = None, []
    for batch in batches:
        out = []
        for gram, *rest in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if gram != now:
                if len(part) > 1:
                    out += close(part)
                now, part = gram, []
            elif part[-1][:3] == rest[:3]:  # the same row again
                continue
            part.append(rest)
        yield pack(out)
    if len(part) > 1:
        yield pack(close(part))


def _contexts(batches):
    """Rows (doc_id, key, asked, text): the text around every anchor that is asked for."""
    import pyarrow as pa

    done = None
    for batch in batches:
        for row in range(batch.num_rows):  # one document's contexts at a time
            if (now := (batch.column(0)[row], batch.column(1)[row])) == done:  # the same row again
                continue
            done = now
            text = (batch.column(3)[row].as_py() or "").encode()
            a = batch.column(2)[row].values
            place, before, after = (a.field(k).to_numpy() for k in range(3))
            ctx = [text[p - b : p + f] for p, b, f in zip(place.tolist(), before.tolist(), after.tolist(), strict=True)]
            same = [pa.array([batch.column(c)[row].as_py()] * len(place), pa.int64()) for c in range(2)]
            yield pa.record_batch([a.field(3), *same, a.field(0), a.field(1), pa.array(ctx, pa.binary())], names=["gram", "doc_id", "key", "place", "before", "context"])


def _windows(batches):
    """For each of the same rows: its ids, its anchors' places, and every window of LENGTH bytes that holds an anchor's gram: which anchor, its gram, a hash, a place."""
    done = None
    for batch in batches:
        for row in range(batch.num_rows):
            if (now := (batch.column(0)[row], batch.column(1)[row])) == done:  # the same row again
                continue
            done = now
            sums = prefix_hash(np.frombuffer((batch.column(3)[row].as_py() or "").encode(), np.uint8))
            a = batch.column(2)[row].values
            place, before, after = (a.field(k).to_numpy().astype(np.int64) for k in range(3))
            first, n = place - before, np.maximum(0, before + np.minimum(after, LENGTH) - LENGTH + 1)
            which = np.repeat(np.arange(len(n)), n)
            start = first[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield now[0].as_py(), now[1].as_py(), which, a.field(3).to_numpy()[which], span_hash(sums, start, start + LENGTH).view(np.int64), start


def _count_windows(batches):
    import pyarrow as pa

    for batch in batches:
        found = [(g, h) for *_, g, h, _ in _windows([batch])]
        if not found:
            continue
        gram, h = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((h, gram))
        gram, h = gram[order], h[order]
        begin = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(gram[begin]), pa.array(h[begin]), pa.array(np.diff(np.append(begin, len(h))))], names=["gram", "window", "n"])


def _asked(places: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, key, asked places, text of the documents that have any."""
    asked = places.groupBy("doc_id", "key").agg(F.collect_list(F.struct("place", "before", "after", "gram")).alias("asked"))
    return asked.join(docs, ["key"]).where(asked.doc_id.eqNullSafe(docs.doc_id)).select(asked.doc_id, "key", "asked", "text")


def _hot_spans(asked: DataFrame) -> DataFrame:
    """doc_id, key, start, stop covered by the windows of the asked anchors that occur twice, known by 64 bits of the gram and 64 of the window.

    All windows of an anchor hold it, so what they cover is one span.
    """
    twice = asked.mapInArrow(_count_windows, "gram long, window long, n long").groupBy("gram", "window").agg(F.sum("n").alias("n")).where("n > 1").select("gram", "window")
    twice = stash(twice, "windows")
    held = None
    if twice.count() <= BROADCAST_IDS:
        table = twice.toArrow()
        gram, window = (table.column(k).to_numpy() for k in range(2))
        order = np.argsort(window)
        held = asked.sparkSession.sparkContext.broadcast((gram[order], window[order]))

    def cover(batches):
        import pyarrow as pa

        known = None if held is None else held.value
        for doc_id, key, which, gram, h, start in _windows(batches):
            if known is not None:
                at = np.minimum(np.searchsorted(known[1], h), max(0, len(known[1]) - 1))
                use = (known[1][at] == h) & (known[0][at] == gram) if len(known[1]) else np.zeros(len(h), bool)
                which, gram, h, start = which[use], gram[use], h[use], start[use]
            cols = [pa.array([doc_id] * len(h), pa.int64()), pa.array([key] * len(h), pa.int64()), pa.array(which.astype(np.int32)), pa.array(gram), pa.array(h), pa.array(start.astype(np.int32))]
            yield pa.record_batch(cols, names=["doc_id", "key", "which", "gram", "window", "start"])

    rows = asked.mapInArrow(cover, "doc_id long, key long, which int, gram long, window long, start int")
    if held is None:
        rows = rows.join(twice, ["gram", "window"], "left_semi")
    return rows.groupBy("doc_id", "key", "which").agg(F.min("start").alias("start"), (F.max("start") + LENGTH).alias("stop")).select("doc_id", "key", "start", "stop")


def repeated_spans(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, key, start, stop: byte spans of documents (by id and hash of the text) that repeated 200-byte strings cover; they overlap."""
    spark, hot = docs.sparkSession, hot or HOT
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    postings = int(size * 2 / (LENGTH - GRAM + 2))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // POSTINGS_A_BUCKET))
    found = _postings(docs, buckets)
    spans = found.where(F.col("kind").isin(1, 3)).where(f"before + after >= {LENGTH}").select("doc_id", "key", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop"))
    several = found.where("kind >= 2")
    total = several.count()
    grams = stash(several.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram"), "hot", total // hot)  # at most total / hot rows
    cold = without(several, grams, "gram")
    contexts = _asked(cold, docs).mapInArrow(_contexts, "gram long, doc_id long, key long, place int, before int, context binary")
    tree = contexts.repartition("gram").sortWithinPartitions("gram", "doc_id", "key", "place").mapInArrow(_scan, "doc_id long, key long, start int, stop int")
    spans = spans.union(tree)
    if grams.count():
        heat = several.join(grams, "gram", "left_semi")
        keys = stash(heat.select("key").distinct(), "keys", total)
        asked = stash(_asked(heat, only(docs, keys, keys.count(), "key")), "asked")
        spans = spans.union(_hot_spans(asked))
    return spans


def _kept(data: bytes, spans) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many maximal spans there are."""
    out, at, n = [], 0, 0
    for start, stop in _merged(spans or ()):
        out.append(data[at:start])
        at, n = stop, n + 1
    return b"".join([*out, data[at:]]), n


def _merged(spans):
    now = None
    for s in sorted((x["start"], x["stop"]) for x in spans):
        if now and s[0] <= now[1]:
            now = (now[0], max(now[1], s[1]))
        else:
            if now:
                yield now
            now = s
    if now:
        yield now


def _merge(batches):
    """Rows (doc_id, key, spans): the spans merged, so that equal rows each get a short list."""
    import pyarrow as pa

    for batch in batches:
        merged = [[{"start": a, "stop": b} for a, b in _merged(spans)] for spans in batch.column(2).to_pylist()]
        yield pa.record_batch([*batch.columns[:2], pa.array(merged, batch.schema.field(2).type)], names=batch.schema.names)


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the covered spans of each row, merged, null if it has none."""
    own, doc, key, found = (fresh(docs, f"_{x}") for x in ("id", "doc", "key", "spans"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), text)})
    spans = repeated_spans(keyed.select(F.col(own).alias("doc_id"), F.col(key).alias("key"), text.alias("text")))
    spans = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # equal rows have equal spans
    spans = spans.mapInArrow(_merge, "doc_id long, key long, spans array<struct<start: int, stop: int>>").toDF(doc, f"{key}2", found)
    joined = keyed.join(spans, (F.col(key) == F.col(f"{key}2")) & F.col(own).eqNullSafe(F.col(doc)), "left")
    return joined.select(*docs.columns, found), found


def dedup_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text counts as empty; texts under 200 bytes lose nothing; equal rows lose the same. Long texts are read whole.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = (text or "").encode()
                left, n = _kept(data, spans)
                rows.append((doc_id, len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, _ = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs' rows and columns with the covered bytes cut from text (a character that is cut in two goes) and n_chars made new."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = [None if t is None else t if not s else _kept(t.encode(), s)[0].decode(errors="ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            cols = batch.columns[:-1]
            cols[at] = pa.array(text, pa.string())
            yield pa.record_batch(cols, names=batch.schema.names[:-1])

    out = _with_spans(docs)[0].mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 200-byte strings that occur twice take from each document."""
    return dedup_spans(documents(spark, sf_dir))
