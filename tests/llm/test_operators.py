"""The training-data operators against brute force, round trips and planted cases; each with nulls, empties, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from crossgauge.llm import decontaminate, histogram_shard, language_id, license_scan, line_quality, ngram_jaccard, packing, quality_classifier, suffix_dedup, token_files
from crossgauge.llm.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, shard int, score double, key long, kept string, cls long"


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(str(rng.choice(WORDS)) + str(rng.integers(50)) for _ in range(n))


def corpus():
    base, passage = prose(1, 120), prose(99, 60)
    near = base.split()
    near[7] = "changed"
    texts = [base, base, " ".join(near), prose(2), passage + "\n" + prose(3), prose(4) + "\n" + passage, "", None, "  \n ", "two words", "two words", "é" * 300, "x" * 450, prose(5, 3000), base + " tail"]
    return [(i, t, None if i % 5 == 4 else "en", "s", None, "clash", 1, 0.5, 3, "k", 4) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup_equals_brute_force(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # with 1 every anchor of several contexts goes by windows
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_spans(docs).collect()}
    data = {r[0]: (r[1] or "").encode() for r in corpus()}
    seen = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.dedup_spans(empty).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 20])
def test_one_passage_in_many_texts_and_many_equal_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    passage = prose(77, 45)
    texts = [prose(2000 + i, 25) + passage + prose(4000 + i, 25) for i in range(60)] + [prose(5000 + i, 25) + passage[: 230 + i] + prose(6000 + i, 25) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, prose(9, 60))] * 300 + [(None, prose(8, 60)), (None, prose(8, 60)), (None, prose(7, 60))]
    got = suffix_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[(i, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_maximal_repeats_report_all_occurrences():
    tail = b"r" * 200
    groups = list(suffix_dedup.maximal_repeats([(b"abc", tail), (b"abd", tail), (b"xyz", tail)]))
    assert [(before, depth, sorted(m for m, _ in members)) for before, depth, members in groups] == [(0, 200, [0, 1, 2])]


def _brute_components(texts):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, inverted = {}, defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for x in sets[i]:
            inverted[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_jaccard_equals_brute_force(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert got == _brute_components([(r[0], r[1]) for r in corpus()])
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    base = prose(11, 100).split()
    rows = []
    for i in range(24):
        w = list(base)
        for k in range(i % 4):
            w[(17 * i + 31 * k) % 100] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_components(rows)


@pytest.mark.parametrize("per_task", [10**6, 40])
def test_components(spark, per_task):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(500, 540)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), edges_a_task=per_task).collect()}
    assert got == {x: find(x) for x in root}


def test_packing_plan_is_valid_and_tight():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 2049, 4000).tolist())
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, count, sequence, offset in packing.plan(counts):
        ranks[length] += range(first, first + count)
        for k in range(count):
            bins[sequence + k].append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048 and sum(3 * n > 2048 for _, n in items) <= 2
    assert len(bins) <= 1.12 * sum(n * c for n, c in counts.items()) / 2048
    assert packing.plan({}) == []


def test_packing_covers_every_token(docs, empty):
    tokenizer = _tokenizer()
    want = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in corpus()}
    rows = packing.pack_documents(docs).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, ids in want.items():
        own = sorted(parts[i])
        assert own[0][1] == 0 and sum(p[2] for p in own) == len(ids) and all(p[2] == 2048 for p in own[1:])
        assert [p[3] for p in own] == [zlib.crc32(np.array(ids[p[1] : p[1] + p[2]], "<u4").tobytes()) for p in own]
    assert packing.pack_documents(empty).count() == 0


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


@pytest.mark.parametrize("text", ["", "a", " a", "a b\nc", "a\tb  c", "x\n\ny", " \n", "a b c", "it's 's don't, 5.5.", "<|endoftext|> z", "a <|endoftext|> b", "a<|endoftext|>b, <|endoftext| >c", "é.. b…. c×. a, é, x., .", "ab,\ncd. ef!!\n*** $$$ gh%%%", "नमस्ते दुनिया. १२", "ʰa b, c", "y" * 5000])
def test_encoder_equals_the_tokenizer(text):
    from crossgauge.llm.tokens import TOKENIZER, Encoder, tokenizer_path

    assert Encoder(tokenizer_path(TOKENIZER), slot_bits=10).encode(text).tolist() == _tokenizer().encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from crossgauge.llm.tokens import TOKENIZER, Encoder, tokenizer_path

    ours, theirs = Encoder(tokenizer_path(TOKENIZER), slot_bits=6, kept_ids=64), _tokenizer()

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(list("ab,. \n\t'sé×…1٣ \u00a0\u0085Ж!<|>")), max_size=40))
    def same(text):
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids

    same()


def test_token_files_round_trip(docs, empty):
    tokenizer = _tokenizer()
    shards = token_files.write_token_files(docs, shard_ids=300)
    got = {r["doc_id"]: r for r in token_files.read_token_files(shards).collect()}
    start = 0
    for i, text, *_ in corpus():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), i
        start += len(ids)
    shard = token_files.Shard(shards.orderBy("part", "shard").first()["blob"])
    assert shard.document(0).tolist() == tokenizer.encode(corpus()[0][1], add_special_tokens=False).ids + [0]
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_token_files_keep_rows_without_an_id(spark):
    rows = [(None, "one two"), (-1, "three"), (None, None), (0, "<|endoftext|> four"), (0, "<|endoftext|> four")]
    got = token_files.read_token_files(token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({None: 2, -1: 1, 0: 2})
    want, tokenizer = Counter(), _tokenizer()
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == want


@pytest.mark.parametrize("first", [500, 65_300, 70_000])
@pytest.mark.parametrize("pairs", [1, 7, 2048])
def test_repair_goes_on_until_no_pair_is_frequent(pairs, first):
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 500, 200)
    ids = np.concatenate([np.tile(phrase, 64), rng.integers(0, 40, 5000), np.zeros(3000, np.int64)]).astype(np.uint16)
    cut = np.sort(rng.choice(len(ids), 30, replace=False))
    lengths = np.diff(np.concatenate(([0], cut[cut > 0], [len(ids)])))
    shard = token_files.Shard(token_files.encode_shard(list(range(len(lengths))), ids, lengths, first, pairs))
    assert shard.expand(shard.symbols()).tolist() == ids.tolist()
    ends = np.cumsum(lengths)
    assert all(shard.document(k).tolist() == ids[e - n : e].tolist() for k, (e, n) in enumerate(zip(ends, lengths, strict=True)))
    depth = [0] * first
    for a, b in shard.rules.tolist():
        depth.append(1 + max(depth[a], depth[b]))
    assert max(depth) > 6 and len({tuple(r) for r in shard.rules.tolist()}) == len(shard.rules)
    seen = Counter()
    for k in range(len(lengths)):
        s, last = shard.symbols(int(shard.begin[k]), int(shard.per_doc[k])).tolist(), None
        for i, pair in enumerate(zip(s, s[1:], strict=False)):
            if pair == last and pair[0] == pair[1]:  # of a run of one symbol, every other pair counts
                last = None
                continue
            seen[pair], last = seen[pair] + 1, pair
    assert max(seen.values()) < token_files.FEWEST


def test_repair_rules_do_not_span_documents():
    ids = np.array([5, 6] * 40 + [7], np.uint16)
    blob = token_files.encode_shard([1, 2, 3], ids, np.array([3, 41, 37]), 100)
    shard = token_files.Shard(blob)
    assert len(shard.rules) and shard.expand(shard.symbols()).tolist() == ids.tolist()
    assert [shard.document(k).tolist() for k in range(3)] == [ids[:3].tolist(), ids[3:44].tolist(), ids[44:].tolist()]


def test_language_id(spark, docs, empty):
    de, fr = "der hund und die katze sind nicht im haus " * 4, "le chien et la maison ne sont pas dans le jardin " * 4
    rows = [(i, (de if i % 2 else fr)[i % 30 :], "de" if i % 2 else "fr") for i in range(60)] + [(90, "123 !!", None), (91, None, "de"), (92, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kernel = language_id.fit(df, landmarks=5)
    got = {r["doc_id"]: r for r in language_id.identify(df, kernel).collect()}
    assert all(got[i]["lang_pred"] == x and 0 <= got[i]["score"] <= 1 for i, _, x in rows[:60])
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.fit(empty) is None and language_id.keep_identified(docs, language_id.fit(docs)).columns == docs.columns


def test_texts_unlike_every_learned_language_are_rejected(spark):
    import base64

    learned = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    kernel = language_id.fit(learned)
    noise = np.random.default_rng(1).bytes(1500)
    foreign = ["人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق.", "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता प्राप्त है।", base64.b64encode(noise).decode(), base64.b64encode(noise * 200).decode(), noise.hex()]
    assert language_id.keep_identified(spark.createDataFrame([(i, t, None) for i, t in enumerate(foreign)], learned.schema), kernel).count() == 0
    assert language_id.keep_identified(learned, kernel).count() == learned.count()


def test_quality_classifier_learns(spark):
    good, bad = [prose(i, 60) + "." for i in range(80)], [" | ".join(prose(100 + i, 60).upper().split()) for i in range(80)]
    table, bias = quality_classifier.train([t.encode() for t in good[:60] + bad[:60]], [1] * 60 + [0] * 60)
    rows = list(enumerate([*good[60:], *bad[60:], "", None]))
    got = {r["doc_id"]: r for r in quality_classifier.score(spark.createDataFrame(rows, "doc_id long, text string"), table, bias).collect()}
    assert [got[i]["predicted"] for i in range(40)] == [1] * 20 + [0] * 20
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_decontamination(spark, empty):
    items = [(i, prose(200 + i, 20 + 10 * i)) for i in range(8)] + [(8, None), (9, "")]
    rows = [(i, prose(300 + i, 150) + " " + items[i][1].upper() + " " + prose(400 + i, 90)) for i in range(8)] + [(20, prose(500, 400)), (21, None), (22, ""), (23, " ".join(items[3][1].split()[:12]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    edited = items[6][1].split()
    edited[-4] = "edited"
    frame = frame.union(spark.createDataFrame([(30, prose(600, 100) + " " + " ".join(edited) + " " + prose(601, 100))], frame.schema))
    found = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [*((i, i) for i in range(8)), (30, 6)]
    in_blocks = decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), index_bytes=400)
    assert sorted((r["doc_id"], r["item_id"]) for r in in_blocks.collect()) == [*((i, i) for i in range(8)), (30, 6)]
    exact = lambda x: sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in x.collect())
    assert exact(in_blocks) == exact(found)  # scores and thresholds are the whole test set's
    unnamed = spark.createDataFrame([(None, items[2][1]), (None, items[2][1]), (5, items[5][1])], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, unnamed).collect()) == [(2, None), (5, 5)]
    assert decontaminate.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_block_max_wand_equals_scoring_everything():
    """Every passage against every segment by the BM25 formula, without an index."""
    rng = np.random.default_rng(5)
    common = [np.uint64(x) for x in range(1, 30)]
    rare = [np.uint64(x) for x in range(1000, 1400)]
    texts = [" ".join(f"w{int(x)}" for x in rng.choice(np.array(common + rare[: 40 + 3 * i], np.uint64), int(rng.integers(5, 150)))) for i in range(120)]
    index = decontaminate.Index(list(enumerate(texts)))
    segments = [h for _, h in decontaminate._segments(texts, decontaminate.STEP)]
    df, mean = Counter(int(w) for h in segments for w in set(h.tolist())), np.mean([len(h) for h in segments])

    def impacts(h):
        return {w: np.log(1 + (len(segments) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(h) / mean)) for w, n in Counter(h.tolist()).items()}

    weights = [impacts(h) for h in segments]
    passages = [np.unique(np.concatenate([segments[i][: int(rng.integers(1, 70))], segments[(7 * i) % len(segments)][:9]])) for i in range(len(segments))]
    want = sorted(round(x, 6) for p in passages for w in weights if (x := sum(v for k, v in w.items() if k in set(p.tolist()))) >= 0.7 * sum(w.values()))
    terms = [np.searchsorted(index.terms, p) for p in passages]
    got = list(index._above(np.concatenate(terms), np.cumsum([0] + [len(t) for t in terms[:-1]])))
    assert sorted(round(s, 6) for _, _, s in got) == want and len(want) > 50


def test_decontamination_finds_every_one_word_edit():
    import pyarrow as pa

    from crossgauge.llm.common import string_bytes, words

    items = [(n, prose(800 + n, n)) for n in range(15, 65)]
    index = decontaminate.Index(items)

    def hits(texts):
        h, doc, _, _ = words(*string_bytes(pa.array(texts, pa.string())))
        return {(d, i) for d, i, *_ in index.search(h, doc)}

    for n, text in items:
        w = text.split()
        edits = [" ".join([prose(900 + n, 50), *w[:k], "edited", *w[k + 1 :], prose(990 + n, 50)]) for k in range(n)]
        assert {(k, n) for k in range(n)} <= hits(edits), n
        loose = " ".join(x for y in zip(w, prose(950 + n, n).split(), strict=True) for x in y)
        assert not hits([" ".join(w[::-1]), loose, " ".join(w[: (2 * n + 2) // 3])]), n


def test_histogram_sort_shards(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = [(i, "same" if i % 3 == 0 else f"text {i}", 16 + i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string, size long")
    got = histogram_shard.histogram_shard(df, F.col("t"), F.col("id"), F.col("size"), shards=8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and max(abs(v - mean) for v in sizes.values()) <= 0.01 * mean + 70
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert histogram_shard.histogram_shard(empty, F.col("text"), F.col("doc_id"), F.col("n_chars")).count() == 0
    for cell in (2, 10**6):  # clashing names; one text in most rows
        clash = docs.withColumns({"_h1": F.lit(1), "_key": F.lit("k"), "slot": F.lit(9), "_size": F.lit(0), "_cell": F.lit(3)})
        out = histogram_shard.histogram_shard(clash, F.lit("one"), F.col("doc_id"), F.col("doc_id"), shards=3, rows_a_cell=cell)
        assert sorted(out.columns) == sorted(clash.columns)
        slots = defaultdict(list)
        for r in out.collect():
            slots[r["shard"]].append(r["slot"])
        assert sum(map(len, slots.values())) == 15 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_line_rules(spark, docs, empty):
    clean = "\n".join(prose(600 + i, 12) + "." for i in range(6))
    menu = "\n".join([clean, *["Home | About | News | Contact | Shop | Help | Login | Search more things here"] * 1, "CLICK HERE NOW", *[" | ".join(prose(700 + i, 14).split()) for i in range(6)]])
    twice = " ".join(["one two three four"] * 30)
    rows = [(0, clean), (1, menu), (2, twice), (3, None), (4, "a\na\n\n b"), (5, clean + "\nBuy cookies: accept our cookie policy.")]
    got = {r["doc_id"]: r for r in line_quality.line_first_clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(6)] == [True, False, False, False, False, True]
    far = "\n".join(x + " " * 20 + '”)' * 6 for x in clean.split("\n"))  # the stop is far from the line's end
    r = line_quality.line_first_clean(spark.createDataFrame([(7, far), (8, far.replace(".", ""))], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["kept"]) for x in r) == [(7, True), (8, False)]
    assert got[2]["n_repeat_words"] == 120 and got[2]["base_failed"]
    assert (got[4]["n_dup_lines"], got[4]["n_words"], got[3]["n_words"]) == (1, 3, 0)
    assert got[5]["clean_text"] == clean
    assert line_quality.line_first_clean(empty).count() == 0 and line_quality.line_first_clean(docs).count() == 15


def test_license_digests(spark, empty):
    known = license_scan.known_digests(spark)
    rows = [(0, "text\nlicenced under the APACHE licence, version 2.0\nend"), (1, "Copyright 2020 Someone\nReleased under the MIT License."), (2, "We like the MIT License."), (3, None), (4, "")]
    got = sorted((r["doc_id"], r["license_id"], r["scope"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect())
    assert got == [(0, "Apache-2.0", "line"), (1, "MIT", "line"), (1, "MIT", "text")]
    assert license_scan.license_scan(empty, known).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses_and_wrapped_notices(spark):
    import os
    import textwrap

    known = license_scan.known_digests(spark)
    rows = [(0, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT), (1, "intro words\nLicensed under the\nApache Licence, Version 2.0.\nmore words"), (2, MIT.replace("free of charge", "for a fee"))]
    rows += [(3 + k, "int main;\n" + "\n".join(" * " + x for x in textwrap.wrap(MIT, 30 + k)) + "\nint x;") for k in range(30)]  # some wraps start a line with `copyright`
    want = [(0, "MIT", "text", 1), (1, "Apache-2.0", "lines", 1), *[(3 + k, "MIT", "lines", 1) for k in range(30)]]
    shipped = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "BSD": "BSD-3-Clause", "MPL-2.0": "MPL-2.0"}
    for k, (name, spdx) in enumerate(shipped.items()):
        if os.path.exists(f"/usr/share/common-licenses/{name}"):
            with open(f"/usr/share/common-licenses/{name}") as f:
                rows.append((50 + k, f.read()))
            want.append((50 + k, spdx, "text", 1))
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known, max(n for *_, n, _ in license_scan.TEXTS), license_scan.STEMS).collect()
    assert sorted((r["doc_id"], r["license_id"], r["scope"], r["n_hits"]) for r in got) == sorted(want)


def test_one_of_each_keeps_the_least_of_every_component(spark, docs, empty):
    base, other = prose(1, 120), prose(2)
    rows = [(5, base), (3, base), (3, base), (None, base), (9, other), (9, prose(7)), (None, prose(8)), (None, prose(8)), (4, ""), (4, ""), (None, None), (8, base + " tail")]
    got = ngram_jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == Counter([(3, base), (9, other), (9, prose(7)), (None, prose(8)), (4, ""), (4, ""), (None, None)])
    clash = docs.withColumn("_key", docs.doc_id * 2)
    kept = ngram_jaccard.one_of_each(clash)
    assert kept.columns == clash.columns and all(r["_key"] == 2 * r["doc_id"] for r in kept.collect())
    assert ngram_jaccard.one_of_each(empty).count() == 0


def test_uncontaminated_drops_rows_not_ids(spark, docs, empty):
    item = prose(50, 40)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, prose(1)), (1, f"x {item} y"), (None, f"{item}"), (None, prose(2)), (2, None), (3, ""), (1, prose(1))]
    got = decontaminate.uncontaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert Counter(tuple(r) for r in got) == Counter([(1, prose(1)), (1, prose(1)), (None, prose(2)), (2, None), (3, "")])
    assert decontaminate.uncontaminated(empty, items).count() == 0
    assert decontaminate.uncontaminated(docs, items.limit(0)).count() == docs.count()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, "/root/testdata/sf0.001").cache()
        if name != "packing":
            assert after.columns == now.columns
            assert after.count() <= now.count()
        now = after
    assert now.count() > 0


def test_thousands_of_equal_rows_without_an_id(spark):
    """Each text gets its spans once, so equal rows cost in proportion."""
    text = prose(11, 350)
    rows = [(None, text)] * 5000 + [(1, prose(12, 80)), (None, None), (None, None)]
    got = suffix_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    n = len(text.encode())
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == {
        (None, n, n, 1, nothing): 5000, (None, 0, 0, 0, nothing): 2, (1, len(prose(12, 80)), 0, 0, hashlib.sha256(prose(12, 80).encode()).hexdigest()): 1}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shared_passages_do_not_chain(spark, monkeypatch):
    """Texts of passages from a pool, hardly any linked: groups are neighbourhoods, not the whole corpus; near copies and links are all found."""
    rng = np.random.default_rng(6)
    pool = [prose(10_000 + i, 30) for i in range(400)]
    texts = ["\n".join(pool[k] for k in rng.choice(400, 6, replace=False)) for _ in range(400)]
    for i in range(0, 40, 2):  # near copies of some
        w = texts[i].split()
        w[int(rng.integers(len(w)))] = "changed"
        texts.append(" ".join(w))
        texts.append(texts[i] + " tail")
    seen = []
    whole = ngram_jaccard.stash

    def watched(df, name="stash", rows=None):
        out = whole(df, name, rows)
        if name == "groups":
            seen.append(out.groupBy("grp").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(ngram_jaccard, "stash", watched)
    got = {r["doc_id"]: r for r in ngram_jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    sets = [shingles(t) for t in texts]
    links = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(links[i]) for i in range(len(texts))}
    assert all(got[a]["component_id"] == got[b]["component_id"] for a in links for b in links[a])
    assert len({r["component_id"] for r in got.values()}) == 400
    assert seen and max(seen) < 60


@pytest.mark.parametrize("block, tokens", [(8, 1 << 21), (1024, 2000)])
def test_groups_in_pairs_of_blocks(spark, monkeypatch, block, tokens):
    """A cluster of near copies cut into blocks by classes or by tokens: every link once."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "TOKENS_A_BLOCK", tokens)
    rng, base = np.random.default_rng(7), prose(13, 150).split()
    texts = []
    for _ in range(60):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 5)), replace=False):
            w[k] = f"edit{rng.integers(1000)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["n_links"] for r in ngram_jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    sets = [frozenset(shingles(t)) for t in texts]
    classes = set(sets)
    assert got == {i: sum(s != t and 5 * len(s & t) >= 4 * len(s | t) for t in classes) for i, s in enumerate(sets)}


@pytest.mark.parametrize("first", [65_500, 65_534, 65_535, 70_000, 300])
def test_symbols_may_outgrow_16_bits(first):
    rng = np.random.default_rng(8)
    words = [rng.integers(0, min(first, 60_000), 6) for _ in range(300)]
    docs = [np.concatenate([words[k] for k in rng.zipf(1.3, 40) % 300]).astype(np.uint32) for _ in range(200)]
    blob = token_files.encode_shard(list(range(200)), np.concatenate(docs), np.array([len(x) for x in docs]), first, pairs=64)
    shard = token_files.Shard(blob)
    assert (shard.expand(shard.symbols()) == np.concatenate(docs)).all() and len(shard.rules) > 100
    assert all((shard.document(k) == docs[k]).all() for k in range(0, 200, 17))
