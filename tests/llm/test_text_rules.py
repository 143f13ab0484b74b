import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievelog.llm import kneser_ney, quality_trees, repetition

from .conftest import lose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def covered(words, n):
    runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return {i + j for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for j in range(n)}


def test_measures_and_verdict(docs, rows):
    rules = repetition.Rules()
    got = {r["doc_id"]: r for r in repetition.judge_documents(docs).collect()}
    kept = {r["doc_id"]: r["text"] for r in repetition.keep_good(docs).collect()}
    for i, t in rows:
        t, r = t or "", got[i]
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen, later = set(), []
        for x in lines:
            if x in seen:
                later.append(x)
            seen.add(x)
        chars = sum(map(len, words))
        assert (r["words"], r["word_chars"], r["symbols"], r["lines"]) == (len(words), chars, sum(c in "#*$%&|<>" for c in t), len(lines))
        assert (r["dup_lines"], r["dup_line_chars"]) == (len(later), sum(len(w) for x in later for w in WORD.findall(x)))
        assert r["repeat_words"] == len(covered(words, 3))
        failed = len(words) < 50 or 100 * len(covered(words, 3)) > 50 * len(words)
        keep = not failed and len(later) <= rules.line_count * len(lines) and r["dup_line_chars"] <= rules.lines * chars and r["symbols"] <= rules.symbols * len(words)
        for n, most in rules.ngrams:
            inside = sum(len(words[k]) for k in covered(words, n))
            assert r[f"dup_chars_{n}"] == inside
            keep &= inside <= most * chars
        assert (r["base_failed"], r["kept"]) == (failed, keep)
        assert (i in kept) == keep and (not keep or kept[i] == t)


def test_each_limit_rejects_what_passes_the_base_rule(spark):
    rules, number = repetition.Rules(), iter(range(10**6, 10**7))

    def fresh(n):
        return [f"w{next(number)}" for _ in range(n)]

    def phrases(n, twice, once):
        """``twice`` phrases of ``n`` words that stand there two times, among ``once`` other words."""
        out = []
        for p in [fresh(n) for _ in range(twice)] * 2:
            out += [*p, *fresh(once // (2 * twice))]
        return " ".join(out)

    def lines(copies, words, others, length):
        line = " ".join(fresh(words))
        return "\n".join(x for _ in range(copies) for x in (line, *(" ".join(fresh(length)) for _ in range(others))))

    cases = {"dup_chars_5": phrases(6, 4, 72), "dup_chars_7": phrases(8, 4, 168), "dup_chars_10": phrases(11, 4, 304), "dup_line_chars": lines(6, 4, 2, 4), "dup_lines": lines(8, 1, 1, 9)}
    frame = spark.createDataFrame([*cases.items(), ("none", " ".join(fresh(200)))], "doc_id string, text string")
    got = {r["doc_id"]: r for r in repetition.judge_documents(frame).collect()}
    most = {"dup_line_chars": rules.lines, **{f"dup_chars_{n}": x for n, x in rules.ngrams}}
    for name in cases:
        r = got[name]
        over = [x for x, limit in most.items() if r[x] > limit * r["word_chars"]] + ["dup_lines"] * (r["dup_lines"] > rules.line_count * r["lines"])
        assert (over, r["base_failed"], r["kept"]) == ([name], False, False)
    assert got["none"]["kept"] and {r["doc_id"] for r in repetition.keep_good(frame).collect()} == {"none"}


def test_rules_without_rows(none):
    assert repetition.judge_documents(none).collect() == [] and repetition.keep_good(none).collect() == []


def brute_kneser_ney(texts, train, order):
    """Plain counts of every order: raw ones of the highest, different words before an n-gram of the others."""
    tokens = {i: [*WORD.findall(lower(t or "")), ""] for i, t in texts}
    padded = {i: [None] * (order - 1) + w for i, w in tokens.items()}
    grams = {order: Counter(tuple(padded[i][k - order + 1 : k + 1]) for i in train for k in range(order - 1, len(padded[i])))}
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    d = {n: kneser_ney.discounts(np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)])) for n, c in grams.items()}
    total, back = Counter(), Counter()
    for n, c in grams.items():
        for g, k in c.items():
            total[g[:-1]] += k
            back[g[:-1]] += d[n][min(k, 3)]
    counts = Counter(w for i in train for w in tokens[i])
    size, all_ = len(counts), sum(counts.values())
    out = {}
    for i, words in padded.items():
        score = base = 0.0
        for k in range(order - 1, len(words)):
            p = 1 / (size + 1)
            for n in range(1, order + 1):
                g = tuple(words[k - n + 1 : k + 1])
                if total.get(g[:-1]):
                    c = grams[n].get(g, 0)
                    p = max(c - d[n][min(c, 3)], 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * p
            score, base = score + math.log10(p), base + math.log10((counts[words[k]] + 0.1) / (all_ + 0.1 * (size + 1)))
        out[i] = (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), all_, base, score)
    return out


@pytest.mark.parametrize(("order", "hot"), [(2, 1_000_000), (3, 1_000_000), (3, 40)])
def test_language_model_against_plain_counts(docs, rows, monkeypatch, order, hot):
    """With a low ``share`` the trigrams of most frequent words are spread over several shards."""
    monkeypatch.setattr(kneser_ney, "FLUSH", 5000)
    monkeypatch.setattr(kneser_ney, "HELD", 3000)
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    model = kneser_ney.train(docs.filter(~kneser_ney.held_out("doc_id", 10)), order=order, share=hot)
    want = brute_kneser_ney(rows, train, order)
    got = {r["doc_id"]: r for r in kneser_ney.score_documents(docs, model).collect()}
    for i, (n, known, all_, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], model.tokens) == (n, known, all_)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_language_model_with_a_lost_shard(docs):
    model = kneser_ney.train(docs)
    lose("kneser-ney", "rest")
    with pytest.raises(Exception, match="is lost"):
        kneser_ney.score_documents(docs, model).collect()


def test_compact_arrays(tmp_path):
    from sievelog.llm.shared import Compact, shard_of

    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 2**64, 50_000, dtype=np.uint64))
    a, b = rnd.integers(1, 4, len(keys)), rnd.geometric(0.01, len(keys))
    store, shard = Compact(str(tmp_path), 8, 2), shard_of(kneser_ney.spread(keys), 8)
    for s in range(7):  # the last has none
        store.write(s, keys[shard == s], a[shard == s], b[shard == s])
        store.sizes[s] = (shard == s).sum()
    asked = np.concatenate([keys, rnd.integers(0, 2**64, 50_000, dtype=np.uint64)])
    got = store.find(kneser_ney.spread(asked), asked)
    there = np.concatenate([shard < 7, np.zeros(50_000, bool)])
    assert (got[0] == np.where(there, np.concatenate([a, a[:1].repeat(50_000)]), 0)).all() and (got[1][there] == b[shard < 7]).all()


def test_language_model_without_texts(none, docs):
    for order in (2, 3):
        model = kneser_ney.train(none, order=order)
        assert model.tokens == 0 and all(math.isfinite(r["score"]) for r in kneser_ney.score_documents(docs, model).collect())
        assert kneser_ney.score_documents(none, model).collect() == []


def test_trees_learn_and_flat_traversal_is_that_of_the_nodes():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    forest = quality_trees.fit(x[:3000], y[:3000])
    p = forest.score(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.93
    inner = forest.feature.shape[1]
    for k in range(50):
        margin = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(x[3000 + k, forest.feature[t, node]] > forest.threshold[t, node])
            margin += forest.leaf[t, node - inner]
        assert p[k] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_constant_without_two_labels():
    for y in ([], [1.0, 1.0], [0.0]):
        f = quality_trees.fit(np.zeros((len(y), 3)), np.array(y))
        assert len(set(f.score(np.zeros((2, 3))).tolist())) == 1


def test_quality_held_out(spark):
    import os

    from sievelog.llm import queries as q

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in q.op5_quality_trees(spark, d).collect()]
    out = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(out) > 40 and sum(a == b for a, b in out) / len(out) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
