import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievelog.llm import bpe, packing, token_counts

from .conftest import lose

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def test_encoding_and_decoding(docs, rows, ranked):
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs, RANKS).collect()}
    for i, t in rows:
        ids = ranked.encode_ordinary(t or "")
        r = got[i]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    lists = {r["doc_id"]: r for r in bpe.encode_documents(docs, RANKS).collect()}
    assert all(lists[i]["token_ids"] == ranked.encode_ordinary(t or "") and bytes(lists[i]["decoded"]) == (t or "").encode() for i, t in rows)


def test_random_texts_by_every_vocabulary(ranked):
    import pyarrow as pa

    rnd = random.Random(3)
    letters = "abcdelmrstv  \n\t''ÉéßñΩж12³\x1c\x85 !?#``¨«  \r\n…—"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 500, "ab" * 300, "  ", "\n\n a", " 's", "''s", "x'll've're'"]
    for path in (RANKS, JSON, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")):
        library = bpe.merges(path).library
        for block in bpe.blocks(iter([pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})]), path, ["i"]):
            for rows, ids, begin, _ in block.ids():
                for d, i in enumerate(rows.column("i").to_pylist()):
                    assert ids[begin[d] : begin[d + 1]].tolist() == list(library(texts[i])), (path, texts[i])


def test_counts(docs, rows, hf, none):
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, JSON).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(hf.encode(t or "", add_special_tokens=False).ids))
    assert token_counts.count_tokens(none, JSON).collect() == []


def check_packing(pieces, texts, hf, capacity):
    """Every piece is where it says, and sequences have no gaps; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = np.array([*hf.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > capacity)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(docs, rows, hf, capacity, none):
    pieces = packing.pack_documents(docs, JSON, capacity, 2).collect()
    n = check_packing(pieces, dict(rows), hf, capacity)
    assert n <= 1.05 * sum(r["length"] for r in pieces) / capacity + 2
    assert packing.pack_documents(none, JSON, capacity, 2).collect() == []


def test_repeated_rows_are_packed_each(spark, hf):
    twice = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x")], "doc_id long, text string")
    places = [(r["sequence_id"], r["offset"]) for r in packing.pack_documents(twice, JSON, 1024, 2).collect()]
    assert len(set(places)) == 3


def test_plan_of_random_lengths():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([10, 30, 100, 1024])
        counts = {rnd.randint(1, capacity): rnd.randint(1, rnd.choice([3, 60])) for _ in range(rnd.randint(0, 80))}
        table, bins = packing.plan(counts, capacity), {}
        for s, n in counts.items():
            own = table[table[:, 0] == s]
            for i in range(n):
                r = own[np.searchsorted(own[:, 1], i, "right") - 1]
                bins.setdefault(r[2] + (i - r[1]) // r[3], []).append((r[4] + (i - r[1]) % r[3] * s, s))
        for b in bins.values():
            at = 0
            for offset, s in sorted(b):
                assert offset == at
                at += s
            assert at <= capacity and sum(3 * s > capacity for _, s in b) <= 2 or 3 * max(s for _, s in b) > capacity
        least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
        assert len(bins) <= 1.25 * least + 2


def thue_morse(n):
    """Words that a polynomial modulo 2^64 can't tell from their complements."""
    own = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return own, own.translate(str.maketrans("ab", "ba"))


def mixed_script():
    rnd = random.Random(6)
    kinds = ["abcdefgh", "你好世界中文漢字", "ひらがなカタカナ", "한국어문장", "😀🎉👍🏽🇩🇪", "𝒜𝒷𐍈𞤀", "١٢٣४५Ⅷ½", "͸Ᲊ\U000e0100Ƛ", " 　 \n\t"]
    return ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(1, 80))) for _ in range(400)]


def test_every_code_point_has_the_kind_that_both_libraries_give_it(hf, ranked):
    from sievelog.llm import pretokens

    kinds = pretokens.kinds()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind in (pretokens.LETTER, pretokens.NUMBER, pretokens.OTHER):  # a run of one kind is a single pre-token
        text = "".join(chr(c) for c in points if kinds[c] == kind)
        assert len(hf.pre_tokenizer.pre_tokenize_str(text)) == 1
        assert len(text) > 1000


def test_texts_of_all_scripts_and_structured_words(spark, hf, ranked):
    texts = [*mixed_script(), *(w for n in (1024, 2048, 4096) for w in thue_morse(n)), "hello 😀 world", "你好 hello"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bpe._library.cache_clear()
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, JSON).collect()}
    lists = {r["doc_id"]: (r["token_ids"], bytes(r["decoded"])) for r in bpe.encode_documents(frame, RANKS).collect()}
    for i, t in enumerate(texts):
        assert counts[i] == len(hf.encode(t, add_special_tokens=False).ids)
        assert lists[i] == (ranked.encode_ordinary(t), t.encode())


def test_no_document_is_left_to_the_library_but_those_with_special_texts():
    import pyarrow as pa

    from sievelog.llm.arrays import utf8
    from sievelog.llm.vocabulary import special_documents

    data, off = utf8(pa.array([*mixed_script(), "x<|endoftext|>y", None, "z"]))
    assert special_documents(bpe.merges(JSON).added, data, off).tolist() == [400]


def test_words_with_equal_hashes(monkeypatch, ranked):
    """With hashes of a few bits nearly all words clash; the other 64 bits tell, and the library steps in."""
    import pyarrow as pa

    from sievelog.llm import arrays

    whole = arrays.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda data, a, b, seed=0: whole(data, a, b, seed) if seed else whole(data, a, b) & np.uint64(0xFF))
    bpe.merges.cache_clear()
    texts = mixed_script()[:80] + ["plain words of a text", "another text of plain words"]
    try:
        for block in bpe.blocks(iter([pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})]), JSON, ["i"]):
            for rows, ids, begin, _ in block.ids():
                for d, i in enumerate(rows.column("i").to_pylist()):
                    assert ids[begin[d] : begin[d + 1]].tolist() == bpe.merges(JSON).library(texts[i])
    finally:
        bpe.merges.cache_clear()


def test_a_lost_shard_is_an_error(spark, docs):
    counts = token_counts.count_tokens(docs, JSON)
    assert counts.agg({"n_tokens": "sum"}).first()[0] > 0
    lose("vocabulary", "n")
    with pytest.raises(Exception, match="is lost"):
        counts.agg({"n_tokens": "sum"}).first()


def test_long_text_over_slices(spark, hf, ranked):
    """A text of several slices and one longer than a slice in one table."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (500_000, 10, 300_000, 0)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in bpe.encode_digests(frame, RANKS).collect()}
    for i, t in enumerate(texts):
        ids = ranked.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
