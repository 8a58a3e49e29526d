"""Exact n-gram Jaccard self-join by prefix filters under several global orders.

Texts are sets of hashed 5-word shingles; texts with one set are one class. Two classes with Jaccard >= 0.8 differ in
at most a fifth of either, so under any global order their first floor(n / 5) + l tokens share at least l. Order one (tokens of
heavy slots of a fixed-size count sketch last, else by hash; l = 1 + n // 10) is joined over the corpus: postings travel
as packed blocks, and a class whose prefix shares too few tokens with other classes can have no link and drops out.
What is left is looked at on whole sets: order two puts a class's tokens by how many of these classes have them, rarest
first; a class whose tokens are its own to more than a fifth drops out, and those that share a token of order two's first
floor(n / 5) + 1 meet: every such token leads its classes to the smallest of them, its hub, so a group is a hub's own
neighbourhood and never a chain of neighbourhoods. Inside a group, pairs must share prefix tokens under order one and a
third (hash) order, the filters are intersected, and the remaining pairs are verified on their whole sets. A pair that
meets at several hubs is counted at the first. A group too large for a task is split into pairs of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgauge.llm.common import CHUNK, chunks, documents, fresh, mix64, only, row_key, stash, stash_map, string_bytes, unstash, without, words
from crossgauge.llm.components import connected_components, least_reachable

SHINGLE = 5
NUM, DEN = 80, 100
#: Classes of a group, and tokens of their sets, that are compared in one task; larger groups go as pairs of blocks. Their shared tokens are counted in slices of COLUMNS.
BLOCK = 1024
TOKENS_A_BLOCK = 1 << 21
COLUMNS = 4096
POSTINGS_A_BUCKET = 2_000_000
#: Postings that a map task gathers before it packs them by bucket, and rows of a batch that leaves Python.
POSTINGS_A_PACK, ROWS_OUT = 1 << 18, 1 << 16
#: Slots of the sketch that tells heavy tokens, summed in SLICES parts. It only orders tokens: any order gives the same links.
SKETCH_BITS, SLICES = 19, 16
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _extra(n):
    return 1 + n // 10


def _prefix(n):
    return n - -(-n * NUM // DEN) + _extra(n)


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token) of every distinct shingle, sorted by both, and the set size of every document."""
    h, doc, _, _ = words(data, off)
    n_docs = len(off) - 1
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    m = len(h) - SHINGLE + 1
    if m > 0:
        token = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            token = mix64(token + h[k : k + m])
        whole = doc[:m] == doc[SHINGLE - 1 :]
        token, owner = token[whole], doc[:m][whole]
    else:
        token, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short.tolist()):
            for x in h[first[d] : first[d] + count[d]]:
                few[i : i + 1] = mix64(few[i : i + 1] + x + np.uint64(1))
        token, owner = np.concatenate((token, few)), np.concatenate((owner, short))
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    if len(token):
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
        token, owner = token[new], owner[new]
    return owner, token, np.bincount(owner, minlength=n_docs)


def _classes(owner: np.ndarray, token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit id of every document's set, as signed numbers; order of the tokens doesn't matter."""
    total = np.zeros(len(size), np.uint64)
    if len(token):
        mixed = mix64(token ^ np.uint64(0x51ED270B27B4F3CF))
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        total[owner[begin]] = np.add.reduceat(mixed, begin)
    return mix64(total + size.astype(np.uint64)).view(np.int64)


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of id and text), n_shingles, cls of every row (slice -1), and every task's token counts by slot of the sketch, in slices."""

    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = ["doc_id", "key", "n_shingles", "cls", "slice", "counts"]
        for batch in batches:
            for i, j in chunks(batch.column(2)):
                owner, token, size = shingle_sets(*string_bytes(batch.column(2).slice(i, j - i)))
                sketch += np.bincount(_slot(token), minlength=len(sketch)).astype(np.uint32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(_classes(owner, token, size)), pa.array(np.full(j - i, -1, np.int32)), pa.nulls(j - i, pa.binary())], names=names)
        rows = [(None, None, None, None, k, part.tobytes()) for k, part in enumerate(np.split(sketch, SLICES)) if part.any()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names=names)

    return stash_map(docs.select("doc_id", "key", "text"), run, "doc_id long, key long, n_shingles long, cls long, slice int, counts binary", "sets")


def _slot(token: np.ndarray) -> np.ndarray:
    return (mix64(token) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def heavy_slots(parts: DataFrame) -> np.ndarray:
    """A mask over the sketch's slots: those whose count stands out from the mean. 2**SKETCH_BITS numbers reach the driver."""

    def add(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                x = np.frombuffer(blob, np.uint32).astype(np.uint64)
                total[k] = total[k] + x if k in total else x
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES))
    for r in parts.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        counts[r["slice"]] = np.frombuffer(r["counts"], np.uint64)
    mean = counts.mean()
    return counts.ravel() > mean + 6 * mean**0.5 + 8


def _ordered(owner: np.ndarray, token: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Order one of tokens that are sorted by (owner, token): the heavy ones of an owner last."""
    return np.argsort(2 * owner + heavy[_slot(token)], kind="stable")


def _packed(token: np.ndarray, owner: np.ndarray, cls: np.ndarray, size: np.ndarray, buckets: int):
    """Postings as a record batch, a row for each bucket of the tokens: their low bits, their owners, and the owners' classes and sizes."""
    import pyarrow as pa

    bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    table = np.stack([cls, size.astype(np.int64)])
    low = token.astype(np.uint32)
    rows = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        at = order[cut[b] : cut[b + 1]]
        there, own = np.unique(owner[at], return_inverse=True)
        rows.append((b, low[at].tobytes(), own.astype(np.uint32 if len(there) > 65535 else np.uint16).tobytes(), np.ascontiguousarray(table[:, there]).tobytes()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "tokens", "owners", "table"])


def _packs(parts, buckets: int):
    """Record batches of (token, owner, cls, size) parts, POSTINGS_A_PACK postings or more in each but the last."""
    kept, n = [], 0

    def pack():
        base = np.cumsum([0] + [len(c) for _, _, c, _ in kept[:-1]])
        owner = np.concatenate([o + b for (_, o, _, _), b in zip(kept, base, strict=True)])
        return _packed(np.concatenate([t for t, *_ in kept]), owner, np.concatenate([c for _, _, c, _ in kept]), np.concatenate([s for *_, s in kept]), buckets)

    for part in parts:
        kept.append(part)
        n += len(part[0])
        if n >= POSTINGS_A_PACK:
            yield pack()
            kept, n = [], 0
    if n:
        yield pack()


def _shared(packed: DataFrame, buckets: int) -> DataFrame:
    """token, cls, n, k of packed postings: the tokens that k >= 2 classes have. A token is known by its bucket and its low 32 bits."""

    def gather(batches):
        import pyarrow as pa

        def several(token):
            same = token[1:] == token[:-1]
            return np.concatenate(([False], same)) | np.concatenate((same, [False]))

        def shared(bucket, parts):
            token, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            order = order[several(token[order])]
            token, cls, n = token[order], cls[order], n[order]
            order = np.lexsort((cls, token))
            token, cls, n = token[order], cls[order], n[order]
            if len(token):  # copies of a class's text count once
                new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
                token, cls, n = token[new], cls[new], n[new]
                twice = several(token)
                token, cls, n = token[twice], cls[twice], n[twice]
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
            count = np.diff(np.append(begin, len(token)))
            cols = ((bucket << 32) + token.astype(np.int64), cls, n, np.repeat(count, count))
            for i in range(0, len(token), ROWS_OUT):
                yield pa.record_batch([pa.array(c[i : i + ROWS_OUT]) for c in cols], names=["token", "cls", "n", "k"])

        now, parts = None, []
        for batch in batches:
            for b, t, o, table in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != now and parts:
                    yield from shared(now, parts)
                    parts = []
                now = b
                token, table = np.frombuffer(t, np.uint32), np.frombuffer(table, np.int64).reshape(2, -1)
                own = np.frombuffer(o, np.uint32 if len(o) == 4 * len(token) else np.uint16)
                parts.append((token, table[0][own], table[1][own]))
        if parts:
            yield from shared(now, parts)

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "token long, cls long, n long, k long")


def shared_prefixes(docs: DataFrame, buckets: int, heavy) -> DataFrame:
    """token, cls, n, k: order one's prefix tokens that k >= 2 classes have. heavy: broadcast mask of the sketch."""

    def prefixes(batches):
        for batch in batches:
            for i, j in chunks(batch.column(0)):
                owner, token, size = shingle_sets(*string_bytes(batch.column(0).slice(i, j - i)))
                cls = _classes(owner, token, size)
                token = token[_ordered(owner, token, heavy.value)]
                place = np.arange(len(token)) - (np.cumsum(size) - size)[owner]
                use = place < _prefix(size)[owner]
                yield token[use], owner[use], cls, size

    def emit(batches):
        yield from _packs(prefixes(batches), buckets)

    return _shared(docs.select("text").mapInArrow(emit, "bucket int, tokens binary, owners binary, table binary"), buckets)


def shared_tokens(held: DataFrame, buckets: int) -> DataFrame:
    """token, cls, n, k: the tokens of whole sets (cls, n, tokens) that k >= 2 classes have."""

    def rows(batches):
        for batch in batches:
            cls, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            stop = np.cumsum(size)
            i = 0
            while i < len(size):  # some rows at a time
                j = max(i + 1, int(np.searchsorted(stop, stop[i] - size[i] + CHUNK // 8, side="right")))
                token = batch.column(2).slice(i, j - i).flatten().to_numpy().view(np.uint64)
                yield token, np.repeat(np.arange(j - i), size[i:j]), cls[i:j], size[i:j]
                i = j

    def emit(batches):
        yield from _packs(rows(batches), buckets)

    return _shared(held.select("cls", "n", "tokens").mapInArrow(emit, "bucket int, tokens binary, owners binary, table binary"), buckets)


def _overlaps(parts: list[np.ndarray]) -> np.ndarray:
    """How many tokens any two parts share; COLUMNS shared tokens at a time."""
    k = len(parts)
    tokens, where, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(k), [len(p) for p in parts]), (np.cumsum(n > 1) - 1)[where]
    use = n[where] > 1
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((k, k), np.int32)
    for low in range(0, int((n > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        rows, there = np.unique(row[a:b], return_inverse=True)  # parts without any of these tokens are left out
        x = np.zeros((len(rows), int(column[b - 1]) - low + 1), np.float32)
        x[there, column[a:b] - low] = 1
        out[np.ix_(rows, rows)] += (x @ x.T).astype(np.int32)
    return out


def _links(sets: list[np.ndarray], left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard >= 0.8; with `left` given (a mask), only pairs of one left and one other."""
    k = len(sets)
    size = np.array([len(s) for s in sets])
    allowed = (size[:, None] * DEN >= size[None, :] * NUM) & (size[None, :] * DEN >= size[:, None] * NUM)
    if left is not None:
        allowed &= left[:, None] != left[None, :]
    allowed = np.triu(allowed, 1)
    for mixed in (False, True):  # candidates share a prefix token under each order
        if not allowed.any():
            break
        allowed &= _overlaps([(np.sort(mix64(s ^ _SECOND)) if mixed else s)[: _prefix(len(s))] for s in sets]) > 0
    i, j = np.nonzero(allowed)
    if len(i) <= 4 * k:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        both = _overlaps(sets)[i, j].astype(np.int64)
    hit = DEN * both >= NUM * (size[i] + size[j] - both)
    return i[hit], j[hit]


def _verify(batches):
    """Rows (grp, i, j, blk, cls, set, hubs), sorted by (grp, i, j): for each class its least linked class in the part, and its links.

    Links that an earlier hub sees too are left to it.
    """
    import pyarrow as pa

    def close(part):
        left = None if part[0][0][1] == part[0][0][2] else np.array([r[0][3] == r[0][1] for r in part])
        cls = np.array([r[1] for r in part], np.int64)
        a, b = _links([r[2] for r in part], left)
        earlier = [r[3][r[3] < part[0][0][0]] for r in part]
        if len(a) and any(map(len, earlier)):
            here = _overlaps(earlier)[a, b] == 0
            a, b = a[here], b[here]
        degree = np.bincount(np.concatenate((a, b)), minlength=len(cls))
        there = np.flatnonzero(degree)
        return cls[there], cls[least_reachable(a, b, len(cls))][there], degree[there]

    def pack(found):
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] or [()] * 3
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["cls", "root", "n_links"])

    part: list = []
    for batch in batches:
        found = []
        lists, near = batch.column(5), batch.column(6)
        tokens = [lists[r].values.to_numpy().view(np.uint64) for r in range(batch.num_rows)]
        hubs = [near[r].values.to_numpy() for r in range(batch.num_rows)]
        for grp, i, j, blk, cls, own, hub in zip(*(batch.column(c).to_pylist() for c in range(5)), tokens, hubs, strict=True):
            if part and part[0][0][:3] != (grp, i, j):
                found.append(close(part))
                part = []
            part.append(((grp, i, j, blk), cls, own, hub))  # tokens in order one
        yield pack(found)
    if part:
        yield pack([close(part)])


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component (a class of the document's component; null without shingles), component_id, n_links of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", row_key())
    found = summaries(docs)
    seen = found.where("slice < 0").select("doc_id", "key", "n_shingles", "cls")
    heavy = spark.sparkContext.broadcast(heavy_slots(found.where("slice >= 0")))  # 2**SKETCH_BITS flags
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, total = (x or 0 for x in seen.agg(F.count("*"), F.sum("n_shingles")).first())
    buckets = max(parts, -(-int(0.3 * total) // POSTINGS_A_BUCKET))
    classes = stash(seen.where("n_shingles > 0").groupBy("cls").agg(F.min("key").alias("key"), F.min("doc_id").alias("least")), "classes", rows)
    shared = shared_prefixes(docs, buckets, heavy)
    least = F.expr("n * 8 div 10")  # the smallest set that a set of n can link with, at most
    slack = F.floor(F.col("n") * F.col("n") / F.lit(1 << 32))  # tokens of one huge set that fall together
    enough = shared.groupBy("cls", "n").agg(F.count("*").alias("c")).where(F.col("c") + slack >= 1 + F.floor(least / 10)).select("cls")
    members = stash(classes.join(enough, "cls", "left_semi").select(F.col("cls").alias("want"), "key"), "members", rows)
    n_members = members.count()

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in chunks(batch.column(1)):
                owner, token, size = shingle_sets(*string_bytes(batch.column(1).slice(i, j - i)))
                cls = _classes(owner, token, size)
                token = token[_ordered(owner, token, heavy.value)]
                at = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
                out = pa.record_batch([pa.array(cls), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(token.view(np.int64)))], names=["cls", "n", "tokens"])
                yield out.filter(pa.array(batch.column(0).slice(i, j - i).to_numpy() == cls))

    held = members.join(only(docs, members, n_members, "key"), "key").select("want", "text")
    held = stash_map(held, sets, "cls long, n long, tokens array<long>", "candidates")
    if held.count() > n_members:  # a class's chosen row is there more than once
        held = stash(held.dropDuplicates(["cls"]), "candidates")
    buckets = max(parts, -(-(held.agg(F.sum("n")).first()[0] or 0) // POSTINGS_A_BUCKET))

    w = W.partitionBy("cls")
    several = shared_tokens(held, buckets).withColumns({"own": F.col("n") - F.count("*").over(w), "place": F.row_number().over(w.orderBy("k", "token"))})
    core = several.where(F.col("place") + F.col("own") - F.floor(F.col("n") * F.col("n") / F.lit(1 << 32)) <= F.col("n") - F.expr(f"(n * {NUM} + {DEN - 1}) div {DEN}") + 1).select("token", "cls", "n")
    core = stash(core, "core")  # as many tasks as it has parts: a task keeps the sorted rows of all its parts until it ends
    hubs = core.groupBy("token").agg(F.min(F.struct("n", "cls")).alias("hub"), F.count("*").alias("k")).where("k > 1")  # the smallest has the fewest neighbours
    groups = stash(core.join(hubs, "token").select(F.col("hub.cls").alias("grp"), "cls", "n").distinct(), "groups")
    unstash(core)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("tokens") / TOKENS_A_BLOCK)).cast("int")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).select("grp", blocks.alias("blocks"))
    near = groups.groupBy("cls").agg(F.collect_list("grp").alias("hubs"))  # a fifth of the set's tokens, at most
    sets_ = held.select("cls", "tokens").join(near, "cls")
    placed = groups.select("grp", "cls").join(sizes, "grp").withColumn("blk", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets_, "cls")
    pairs = pairs.select("grp", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cls", "tokens", "hubs")
    links = pairs.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "cls")
    links = stash_map(links, _verify, "cls long, root long, n_links long", "links")
    unstash(held)
    linked = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), most=links.count())
    degree = links.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    # names are settled by class, so that only one join sees every document
    linked = linked.select(F.col("node").alias("cls"), "component").join(degree, "cls").join(classes.select("cls", "least"), "cls")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(names, "component").select("cls", "component", "component_id", "n_links")
    of_class = classes.join(linked, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), F.coalesce("component_id", "least").alias("component_id"), "n_links")
    out = seen.join(of_class, "cls", "left")
    return out.select("doc_id", "key", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (classes linked with the document's) of every row.

    Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows and rows with one doc_id
    each give a row; rows without a doc_id are linked like others, and the id of a component is the least there is.
    """
    return _named(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs' rows, all columns, without near duplicates: of every component the row with the least doc_id (null last) stays, once.

    Rows without shingles are linked with nothing and all stay, repeated ones too. Columns may have any names.
    """
    named = stash(_named(docs).select("doc_id", "key", "component").where("component is not null"), "named", docs.count())
    rows = named.count()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    key = fresh(docs, "_key")
    gone = stash(named.select("key").distinct().join(kept, "key", "left_anti").toDF(key), "gone", rows)
    twice = stash(named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").join(kept, "key", "left_semi").select(F.col("key").alias(key)), "twice", rows)
    rest = without(docs.withColumn(key, row_key()), gone, key)
    if n := twice.count():  # rows that are there more than once
        rest = without(rest, twice, key).unionByName(only(rest, twice, n, key).join(twice, key, "left_semi").dropDuplicates([key]))
    return rest.select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class at a Jaccard similarity of 0.8."""
    return jaccard_components(documents(spark, sf_dir))
