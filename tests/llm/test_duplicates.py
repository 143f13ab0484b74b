import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from sievelog.llm import chunk_dedup, jaccard_join, order_minhash
from sievelog.llm.components import components

from .conftest import lose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows, percent=75):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check_links(frame, rows, percent=75):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_documents(frame, percent).collect()}
    want = groups(rows, percent)
    assert got == want
    return want


def test_links(docs, rows):
    want = check_links(docs, rows)
    assert max(Counter(c for _, c in want.values()).values()) > 6


@pytest.mark.parametrize(("rare", "light", "small"), [(3, 2, 2), (2, 40, 3), (64, 24, 8)])
def test_links_by_every_kind_of_key(spark, monkeypatch, rare, light, small):
    """With few rare tokens and small keys, so that combinations, heavy sets and comparisons between components all take part."""
    import random

    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rnd, rows = random.Random(rare), []
    for _ in range(4):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([20, 60, 90]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [f"v{rnd.randrange(4)}"], [own[k], f"v{rnd.randrange(4)}"]])
            rows.append((len(rows), " ".join(own)))
    check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("percent", [20, 30, 50, 66, 75, 90, 100])
def test_links_of_any_likeness(spark, monkeypatch, percent):
    """Also of small sets, where a single shingle is enough, and with nearly every token a frequent one."""
    import random

    monkeypatch.setattr(jaccard_join, "RARE", 2)
    monkeypatch.setattr(jaccard_join, "LIGHT", 6)
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "OPENED", 3)
    rnd, rows = random.Random(percent), []
    for size in (6, 6, 9, 30, 60, 120):
        base = [f"w{rnd.randrange(400)}" for _ in range(size)]
        for _ in range(22):
            own = list(base)
            for _ in range(rnd.randint(0, max(2, size // 8))):
                k = rnd.randrange(len(own))
                own[k : k + 1] = rnd.choice([[], [f"v{rnd.randrange(3)}"], [own[k], f"v{rnd.randrange(3)}"]]) if len(own) > 3 else [own[k], "v"]
            a = rnd.randrange(0, max(1, size // 6))
            rows.append((len(rows), " ".join(own[a:] or ["x"])))
    want = check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows, percent)
    assert len({c for _, c in want.values()}) > 3


def test_links_of_structured_words(spark):
    """Two words that a polynomial modulo 2^64 can't tell apart."""
    own = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, f"w x y z {own}"), (2, f"w x y z {own.translate(str.maketrans('ab', 'ba'))}")]
    assert {c for _, c in check_links(spark.createDataFrame(rows, "doc_id long, text string"), rows).values()} == {1, 2}


def test_a_lost_shard_is_an_error(spark, docs):
    kept = jaccard_join.keep_first(docs)
    lose("gone", "keys")
    with pytest.raises(Exception, match="is lost"):
        kept.collect()
    cut = chunk_dedup.dedup_substrings(docs)
    lose("chunks", "place")
    with pytest.raises(Exception, match="is lost"):
        cut.collect()


def test_no_shared_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    from sievelog.llm import shared

    none = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: none, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    real, shared.ship = shared.ship, lambda s: s
    try:
        with pytest.raises(shared.StoreError, match="spark.checkpoint.dir"):
            shared.shared_folder(SimpleNamespace(sparkContext=context, conf=none), "x")
    finally:
        shared.ship = real


def test_exchange_of_two_levels(spark, docs, rows, monkeypatch):
    """More shards than a task makes payloads: the same results, and rows that follow the tasks, not their square."""
    from sievelog.llm import shared

    monkeypatch.setattr(shared, "FAN", 8)
    monkeypatch.setattr(shared, "LEAST", 64)
    check_links(docs, rows)
    cut = {r["doc_id"]: r["n_cut"] for r in chunk_dedup.dedup_substrings(docs).collect()}
    monkeypatch.undo()
    assert cut == {r["doc_id"]: r["n_cut"] for r in chunk_dedup.dedup_substrings(docs).collect()}


def test_links_of_odd_rows(spark, none):
    assert jaccard_join.link_documents(none).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "u v w x y z"), (9, "u v w x y z")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard_join.link_documents(odd).collect())
    assert got == [(0, None), (4, 4), (4, 4), (4, 4), (9, 4)]


def test_first_of_each_group_stays(docs, rows, spark, none):
    want = groups(rows)
    got = {r["doc_id"]: r["text"] for r in jaccard_join.keep_first(docs).collect()}
    assert got == {i: t for i, t in rows if want[i][1] == i}
    assert jaccard_join.keep_first(none).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (0, "a b c d e f"), (4, "a b c d e f"), (9, ""), (10, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in jaccard_join.keep_first(odd).collect()) == [(False, 0), (False, 9), (False, 10), (True, None)]


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (3, 3), (200, 100)] + [(1000, 1000 + k) for k in range(50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 161), 200]}, 5: 5, 7: 5, 9: 5, **{i: 1000 for i in range(1000, 1050)}}


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    h, got = 0, chunk_dedup.gear(data)
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) & 0xFFFF
        if i >= chunk_dedup.WINDOW - 1:
            assert got[i] == h


def test_chunks_resist_shifts():
    import pyarrow as pa

    from sievelog.llm.arrays import utf8
    from .conftest import prose
    import random

    text = prose(random.Random(4), 400)
    data, off = utf8(pa.array([text, "inserted words " + text]))
    ends, first = chunk_dedup.chunks(data, off)
    parts = [[data[a:b].tobytes() for a, b in zip([off[d], *ends[first[d] : first[d + 1] - 1]], ends[first[d] : first[d + 1]], strict=True)] for d in (0, 1)]
    assert b"".join(parts[0]).decode() == text and len(set(parts[0]) & set(parts[1])) > 0.9 * len(parts[0])


def test_passages_are_cut(docs, rows):
    texts = dict(rows)
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(docs).collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "lang", "n_chars", "n_chunks", "n_cut", "cut_spans"}
    many = lambda ts, k: {s for s, n in Counter(s for t in ts for s in {tuple((t or "").split()[i : i + k]) for i in range(len((t or "").split()) - k + 1)}).items() if n > 1}
    assert many(texts.values(), 51) and not many((r["text"] for r in got.values()), 51)
    whole = many(texts.values(), 8)
    for i, t in texts.items():
        r, left = got[i], t
        assert (r["text"] is None) == (t is None)
        for s in reversed(r["cut_spans"]):
            left = left[: s["begin"]] + left[s["begin"] + s["length"] :]
        assert left == r["text"]
        w = (t or "").split()
        own = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        if not (set(own) & whole) and not any(n > 1 for n in own.values()) and 1 < len(w) < 500:
            assert r["text"] == t  # nothing repeats, nothing goes
    gone = Counter(texts.values())
    assert sum(r["text"] == texts[1] for r in got.values()) == 1 and gone[texts[1]] > 1  # one of the copies stays


def pieces(text):
    import pyarrow as pa

    from sievelog.llm.arrays import utf8

    data, off = utf8(pa.array([text]))
    ends = chunk_dedup.chunks(data, off)[0].tolist()
    return [data[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


def test_chunks_of_several_documents_side_by_side_are_no_passage(spark):
    import random

    rnd, made = random.Random(21), None
    fresh = lambda n: " ".join("".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(n))
    while made is None:
        others = [fresh(60) + " " for _ in range(5)]
        picked = [pieces(t)[4] for t in others]
        text = fresh(40) + " " + b"".join(picked).decode() + fresh(40)
        own = pieces(text)
        at = own.index(picked[1]) if picked[1] in own else 0
        if own[at : at + 4] == picked[1:] and sum(map(len, picked[1:])) >= 100:
            made = text
    rows = [*enumerate(others), (10, made), (11, fresh(40) + " " + b"".join(picked).decode() + fresh(40))]
    got = {r["doc_id"]: r for r in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), least=100).collect()}
    assert got[10]["text"] == made and all(got[i]["text"] == t for i, t in enumerate(others))
    whole = b"".join(picked[1:]).decode()  # which the last document does share with the one before
    assert whole in rows[-1][1] and whole not in got[11]["text"]


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0xE01, 0xE2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_text_without_spaces(spark, letters):
    import random

    rnd = random.Random(5)
    fresh = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    text = fresh(4000)
    a, b = pieces(text), pieces(fresh(7) + text)
    assert all(p.decode() for p in a) and b"".join(a).decode() == text and len(set(a) & set(b)) > 0.95 * len(a)
    passage = fresh(150)
    rows = [(i, fresh(90 + 7 * i) + passage + fresh(80)) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), least=100).collect()}
    assert got[0] == rows[0][1] and all(passage[60:-60] not in got[i] and got[i][:50] == rows[i][1][:50] for i in (1, 2))


def test_dedup_without_rows(none):
    assert chunk_dedup.dedup_substrings(none).collect() == []


def test_fingerprints(docs, rows, none):
    got = {r["doc_id"]: r for r in order_minhash.edited_fingerprints(docs).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    sketch = order_minhash.Sketch()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half, r = len(t) // 2, got[i]
        edited = t[: len(t) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, following = (sketch.of(order_minhash._points(x)) for x in (t, edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"], plain[i]) == (own.tobytes().hex(), other.tobytes().hex(), own.tobytes().hex())
        assert r["near_edited"] == order_minhash.likeness(own, other) and r["near_next"] == order_minhash.likeness(own, following)
    assert order_minhash.edited_fingerprints(none).collect() == []


def test_fingerprints_follow_the_order_of_the_text():
    import random

    from .conftest import prose

    sketch, rnd = order_minhash.Sketch(), random.Random(8)
    t = prose(rnd, 400)
    words = t.split(" ")
    near = list(words)
    near[200] = "changed"
    swapped = words[200:] + words[:200]
    a, b, c, d = (sketch.of(order_minhash._points(x)) for x in (t, " ".join(near), " ".join(swapped), prose(rnd, 400)))
    assert order_minhash.likeness(a, b) > 0.85 > order_minhash.likeness(a, c) > order_minhash.likeness(a, d) and order_minhash.likeness(a, d) < 0.1


def test_fingerprint_against_the_definition():
    """Occurrence-numbered k-mers, the next l hashes from each start on, in text order: element by element."""
    import random

    from sievelog.llm.arrays import mixed

    k1, k2, m64 = int(order_minhash._K1), int(order_minhash._K2), 2**64 - 1
    mix = lambda x: int(mixed(np.array([x & m64], np.uint64))[0])
    sketch, rnd = order_minhash.Sketch(k=3, m=16), random.Random(9)
    for n, letters in ((3, "ab"), (4, "ab"), (10, "ab"), (200, "abc"), (3000, "abcdefghijklmnopqrstuvwxyz "), (3000, "ab")):
        t = "".join(rnd.choice(letters) for _ in range(n))
        seen, elements = Counter(), []
        for i in range(n - 2):
            h = 0
            for c in t[i : i + 3]:
                h = (h * k1 + ord(c) + k2) & m64
            number, gram = seen[t[i : i + 3]], mix(h)
            seen[t[i : i + 3]] += 1
            elements.append((mix(gram + number * k2) if number else gram, i))
        ranked, want = sorted(elements), []
        for c in range(16):
            at = sum(h < c * (2**64 // 16) for h, _ in ranked)
            picked = sorted((ranked[(at + j) % len(ranked)] for j in range(min(2, len(ranked)))), key=lambda e: e[1])
            out = 0
            for j, (h, _) in enumerate(picked):
                out = mix(out * k1 + h + j + 1)
            want.append(out >> 48)
        assert sketch.of(order_minhash._points(t)).tolist() == want
