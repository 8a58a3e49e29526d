"""Online packing against a plain encoder and its rules, collocations against SQL and plain counting, alignment against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from crossgauge.llm import collocations, online_packing, token_alignment
from crossgauge.llm.common import string_bytes
from crossgauge.llm.online_packing import Packer, Piece
from crossgauge.llm.segments import ByteLevel, Folded, Pieces, segments
from crossgauge.llm.tokens import _byte_symbols, tokenizer_path
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, ids string, `row` int, pair string, gram int, n double, h string, word string, sequence_id int"
ODD = [
    "", " ", "  ", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\t b", "foo  bar", "foo   bar.", " x", "a<|endoftext|>b. C", "A<|ENDOFTEXT|>b", "é.", "É, x", "it's. 'S 12,3.4", "x" * 3000 + " y", "a▁b",
    "<0x41> <s>", "\x00a\x1c b", "AB́ ﬁ .", "é .", "İ I", "ΑΣ. ΑΣ", "\r\n x \x85y", "a.\n\n\nb ,", ". , .", "a..", "日本語 テスト。", " x ​z", "ab\n", "\nab", " \n", "the cat. the cat! the cat", "The cat, the cat",
]


def rows():
    rng = np.random.default_rng(3)
    words = ["the", "Cat", "sat", "on,", "a", "mat.", "naïve", "x9", "?"]
    prose = [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(40)]
    texts = [*ODD, None, *prose, prose[0], prose[0], prose[1] * 60, "long " * 40_000]
    return [(None if i in (3, 50) else i, t, [None, "en", "fr"][i % 3], "x", 1, "p", 2, 0.5, "h", "w", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("kind, name, front", [(Folded, "word_bpe_49k.json", ""), (ByteLevel, "byte_bpe_50k.json", " "), (Pieces, "piece_bpe_32k.model", " ")])
def test_segments_give_the_tokenizers_ids(kind, name, front):
    rng = np.random.default_rng(1)
    letters = list(" \n\t.,aBé'sİ 　<|>日7́")
    texts = [r[1] or "" for r in rows()] + ["".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(3000)]
    texts = [front + t if t else "" for t in texts]
    enc = kind(tokenizer_path(name), slot_bits=8, kept_ids=1 << 10)  # a small table is emptied again and again
    ids, count = enc.batch(*string_bytes(pa.array(texts)))
    ends = np.cumsum(count)
    for t, e, n in zip(texts, ends.tolist(), count.tolist(), strict=True):
        want = enc.model.encode(t[1:]) if kind is Pieces else enc.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[e - n : e].tolist() == (want if t else []), t


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check_packing(got, docs, capacity):
    """Each id in one piece, offsets gapless; returns the padding."""
    want = defaultdict(list)
    for i, ids in docs:
        want[i].append(ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    pad = 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        pad += capacity - at if at & (at - 1) else 0
    for i, lists in want.items():
        for n in {len(x) for x in lists}:
            same = [x for x in lists if len(x) == n]
            pieces = by_doc.pop((i, n))
            assert sum(r["length"] for r in pieces) == n * len(same)
            for r in pieces:
                part = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for x in same]
                assert r["ids_crc32"] in {zlib.crc32(p) for p in part}
            if len(same) == 1:
                at = 0
                for r in sorted(pieces, key=lambda r: r["start"]):
                    assert r["start"] == at
                    at += r["length"]
    assert not by_doc
    return pad


def test_online_packing(docs, empty):
    texts = [(r[0], r[1]) for r in rows()]
    want = list(zip([i for i, _ in texts], plain_ids([t for _, t in texts]), strict=True))
    for settings in ({}, {"capacity": 64, "windows": 2, "least_cut": 1, "ids_a_task": 1}, {"capacity": 100, "windows": 3, "least_cut": 10}):
        got = online_packing.online_pack(docs, **settings).collect()
        pad = check_packing(got, want, settings.get("capacity", 4096))
        if settings.get("least_cut", 0) == 1:
            assert pad == 0
        assert pad <= 0.1 * sum(len(x) for _, x in want)
    assert online_packing.online_pack(empty).count() == 0


def test_leftovers_of_many_tasks_are_merged_in_rounds(spark):
    texts = [(i, " ".join(["word"] * (i % 37 + 1))) for i in range(3000)]
    got = online_packing.online_pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(24), capacity=128, windows=4, ids_a_task=1)
    got = got.collect()
    pad = check_packing(got, [(i, x) for (i, _), x in zip(texts, plain_ids([t for _, t in texts]), strict=True)], 128)
    assert max(r["sequence_id"] for r in got) >> 58 >= 2 and pad <= 0.05 * sum(i % 37 + 2 for i in range(3000))


def test_packer_places_best_and_emits_the_fullest():
    def piece(i, n):
        return Piece(i, 0, np.arange(n), n)

    p = Packer(capacity=10, windows=2, least_cut=3)
    for i, n in enumerate((6, 7, 3)):
        p.put(piece(i, n))
    assert [[x.doc_id for x in s] for s in p.done] == [[1, 2]]  # 3 fits the window of 7 best, which is full then
    p.put(piece(3, 9))
    p.put(piece(4, 8))  # none holds it; the fullest has a gap of 1, which is padded
    assert [x.doc_id for x in p.done[-1]] == [3]
    p.put(piece(5, 5))  # the fullest has a gap of 2; then of 4, which the head of the document fills
    assert [[(x.doc_id, x.start, len(x.ids)) for x in s] for s in p.done[-1:]] == [[(4, 0, 8)]]
    p.flush()
    assert sum(len(x.ids) for s in p.done for x in s) == 38
    assert all((n := sum(len(x.ids) for x in s)) == 10 or n & (n - 1) == 0 or s[0].doc_id in (3, 4) for s in p.done)


def same_rows(got, want):
    def key(r):
        return r["lang"], r["rank"]

    got = sorted((r.asDict() for r in got.collect()), key=key)
    want = sorted(want.df().to_dict("records"), key=key)
    assert got == want


@pytest.mark.parametrize("least, block", [(100, collocations.BLOCK), (4, 500)])
def test_collocations_equal_their_sql(spark, least, block):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = collocations.collocations(spark.read.parquet(f"{SF}/documents.parquet"), least=least, block=block)
    same_rows(got, con.sql(collocations.ORACLE.replace(">= 100", f">= {least}")))


def plain_collocations(table, least, top):
    """By counting every sequence."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in table:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        big = {g: a for g, a in counts.items() if a >= least and len(g) > 1}
        inside = {(g[i:j], a) for g, a in big.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) if j - i < len(g)}
        found = []
        for g, a in big.items():
            if (g, a) not in inside:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("block", [collocations.BLOCK, 7])
def test_collocations_equal_plain_counting(docs, empty, block):
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=60, block=block).collect())
    assert got == plain_collocations(rows(), 5, 60)
    assert collocations.collocations(empty).count() == 0


def test_a_prefix_that_most_rows_share(spark):
    """Projections of one prefix are spread over tasks and blocks; full filters only ship more."""
    rng = np.random.default_rng(5)
    table = [(i, " ".join(f"of the w{rng.integers(30)} v{rng.integers(3)}" for _ in range(40)), "en") for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(6)
    want = plain_collocations(table, 20, 300)
    for bits, block in ((collocations.FILTER_BITS, 64), (6, 1 << 18)):
        texts = df.select("lang", "text")
        words = collocations.word_counts(texts, 20)
        grams = {len(r["gram"]) for r in collocations.phrase_counts(texts, words, 20, block=block, bits=bits).collect()}
        assert grams == {2, 3, 4, 5}
        assert sorted(tuple(r) for r in collocations.collocations(df, least=20, top=300, block=block).collect()) == want


def test_scores_beyond_64_bits(spark):
    """The exact integer quotient of products that pass 64 bits, as the operator writes it."""
    a, n, left, right = 9_000_000_000_000, 15_000_000_000_000, 9_100_000_000_007, 9_200_000_000_011
    e = f"(cast(1000 AS decimal(38,0)) * cast({a} AS decimal(38,0)) * cast({n} AS decimal(38,0))) div (cast({left} AS decimal(38,0)) * cast({right} AS decimal(38,0)))"
    assert spark.sql(f"SELECT {e} AS s").first()["s"] == 1000 * a * n // (left * right)


def plain_alignment(table):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    symbol = {c: b for b, c in _byte_symbols().items()}

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for i, text, *_ in table:
        raw = (" " + text).encode() if text else b""
        a = [(x, bytes(symbol[c] for c in first.id_to_token(x))) for x in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(x, piece(x)) for x in second.encode(text)] if text else []
        if b"".join(y for _, y in a) != raw or b"".join(y for _, y in b) != raw:
            a, b = [], []
        ends, at = {}, 0
        for k, (_, y) in enumerate(a):
            at += len(y)
            ends[at] = k
        at = last_a = last_b = 0
        links, groups = [], []
        for k, (x, y) in enumerate(b):
            at += len(y)
            if at in ends:
                links.append((a[ends[at]][0], x))
                groups.append(",".join(str(z) for z, _ in a[last_a : ends[at] + 1]) + "|" + ",".join(str(z) for z, _ in b[last_b : k + 1]))
                last_a, last_b = ends[at] + 1, k + 1
        counts.update(links)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return Counter((i, na, nb, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for i, na, nb, g, ls, sha in out)


@pytest.mark.parametrize("lookup", [token_alignment.LOOKUP_PAIRS, 0])
def test_alignment_equals_plain_loops(docs, empty, lookup, monkeypatch):
    monkeypatch.setattr(token_alignment, "GATHERED", 100)
    got = Counter(tuple(r) for r in token_alignment.link_statistics(docs, lookup_pairs=lookup).collect())
    assert got == plain_alignment(rows())
    assert token_alignment.link_statistics(empty, lookup_pairs=lookup).count() == 0


def test_alignment_of_the_query_table(spark):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in token_alignment.op13_token_alignment(spark, SF).collect()) == plain_alignment(table)


def test_overlaps_of_owner_arrays(docs):
    """Byte owners by hand, and every overlap of a document against a loop over bytes."""
    over_a, over_b, link_a, link_b = token_alignment.align(np.array([2, 1, 3]), np.array([1, 2, 2, 1]))
    assert list(zip(over_a.tolist(), over_b.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(1, 1), (2, 3)]
    enc_a, enc_b = segments(ByteLevel, "byte_bpe_50k.json"), segments(Pieces, "piece_bpe_32k.model")
    for r in token_alignment.aligned_documents(docs.where("length(text) < 500")).collect():
        own = [[k for k, i in enumerate(ids) for _ in enc.bytes[i]] for enc, ids in ((enc_a, r["a_ids"]), (enc_b, r["b_ids"]))]
        pairs = list(zip(*own, strict=True))
        assert [tuple(p) for p in r["overlaps"]] == list(dict.fromkeys(pairs))
        assert [tuple(p) for p in r["links"]] == [p for p, q in zip(pairs, [*pairs[1:], (-1, -1)], strict=False) if p[0] != q[0] and p[1] != q[1]]
