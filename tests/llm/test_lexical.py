import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest

from agrolith.llm import lexical
from agrolith.llm.lexical import HEAD, Best, Postings, Settings, build, inverted, search, walk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = Settings(block=4, segment_docs=16, segment_words=300, queries=3)


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, words in asked.items():
        scores = []
        for d, c in own:
            m = 10 + 90 * c.total() * n_docs // total if total else 10
            v = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if v > 0:
                scores.append((-v, d is None, d or 0))
        out += [(i, k, None if none else d, -v) for k, (v, none, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def key(rows):
    return sorted(((r[0] is None, r[0] or 0), r[1], (r[2] is None, r[2] or 0), r[3]) for r in rows)


def found(spark, folder, docs, items, s):
    table = spark.createDataFrame([(d, t, "clash", 1.0) for d, t in docs], "doc_id long, text string, term string, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, rank int")
    return search(spark, build(table, f"{folder}/{uuid.uuid4().hex}", settings=s), asked, settings=s).collect()


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(60)] + ["The", "É", "日本", "a_b", "x\x00y", "don't", "½"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 80])))) for i in range(n)]
    docs += [(i % 5, docs[7][1]) for i in range(20)] + [(None, docs[9][1]), (3, None), (4, " \t"), (None, "the the"), (900, "The " * 4000)]
    items = [(i, " ".join(rng.choices(vocabulary + ["unseen"], k=rng.choice([1, 4, 25])))) for i in range(11)] + [(2, "the extra"), (None, "w1 w2"), (77, None), (78, "?!"), (79, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("s", [SMALL, Settings()])
def test_equal_to_brute_force(spark, tmp_path, seed, s):
    docs, items = made(seed)
    assert key(found(spark, tmp_path, docs, items, s)) == key(brute(docs, items))


def test_blocks_hold_what_was_put_in():
    rng = np.random.default_rng(4)
    terms_, docs, impacts = [], [], []
    for t, n in enumerate([1, 3, 8, 9, 127, 128, 129, 1000]):
        own = np.sort(rng.choice(5000, n, replace=False))
        terms_ += [t] * n
        docs += own.tolist()
        impacts += (rng.integers(0, 2**20, n) if t % 2 else np.full(n, 7)).tolist()
    terms_, docs, impacts = map(np.array, (terms_, docs, impacts))
    n, heads, blocks, bits = inverted(terms_, docs, impacts, 128)
    at = block = byte = 0
    for t in range(8):
        own = heads[block : block + blocks[t]]
        p = Postings(int(n[t]), own.tobytes(), bits[byte:].tobytes(), 128)
        got = [p.decoded(k) for k in range(blocks[t])]
        assert np.concatenate([g[0] for g in got]).tolist() == docs[at : at + n[t]].tolist()
        assert np.concatenate([g[1] for g in got]).tolist() == impacts[at : at + n[t]].tolist()
        assert [g[1].max() for g in got] == own["most"].tolist() and [g[0][-1] for g in got] == own["last"].tolist()
        last = min(128, n[t] - 128 * (blocks[t] - 1))
        byte += int(own["at"][-1]) + -(-last // 8) * int(own["gap_bits"][-1] + own["impact_bits"][-1])
        at, block = at + n[t], block + blocks[t]
    assert byte == len(bits) and HEAD.itemsize == 22


def test_blocks_below_the_threshold_stay_compressed():
    """A rare word of high impact and a frequent one: most of the frequent one's blocks are never read."""
    docs = np.arange(100_000)
    rare = np.array([50_000, 50_001])
    n, heads, blocks, bits = inverted(np.concatenate([np.zeros(len(docs), int), [1, 1]]), np.concatenate([docs, rare]), np.concatenate([np.where(docs % 999 == 5, 900, docs % 7), [800, 900]]), 128)
    frequent = Postings(len(docs), heads[: blocks[0]].tobytes(), bits.tobytes(), 128)
    at = int(heads["at"][blocks[0] - 1]) + -(-(len(docs) % 128) // 8) * int(heads["gap_bits"][blocks[0] - 1] + heads["impact_bits"][blocks[0] - 1])
    seldom = Postings(2, heads[blocks[0] :].tobytes(), bits[at:].tobytes(), 128)
    best = Best(10)
    walk([(frequent, 1), (seldom, 9)], 0, best)
    scores = np.where(docs % 999 == 5, 900, docs % 7)
    scores[rare] += 9 * np.array([800, 900])
    want = np.argsort(-scores, kind="stable")[:10]
    assert sorted(r[2] for r in best.rows)[:10] == sorted(want.tolist()) or sorted(-r[0] for r in best.rows)[:10] == sorted(-scores[want])
    assert len(frequent.read) < 0.2 * len(frequent.heads)


def test_long_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 50)
    text = "Ab-cé " * 300 + "x" * 500 + " end"
    assert [w.decode() for own in lexical.words(text) for w in own] == terms(text)
    assert len(list(lexical.words(text))) > 20


def test_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], [(1, "a")], SMALL) == []
    assert found(spark, tmp_path, [(1, "a")], [], SMALL) == []
    assert found(spark, tmp_path, [(1, None), (2, "")], [(1, "a")], SMALL) == []
