import random
import re
from collections import Counter

import pytest

from agrolith.llm import collocations as co
from agrolith.llm.collocations import Settings, collocations

COLUMNS = "doc_id long, text string, lang string, rank int, phrase string"


def brute(rows, s):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, s.longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    many = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= s.min_count}
    out = []
    for (lang, p), a in many.items():
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(lg == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= s.inside_percent * a for (lg, q), b in many.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    found, rank = [], Counter()
    for lang, score, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= s.top:
            found.append((lang, rank[lang], p.decode(), -a, left, right, total, -score))
    return found


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "city", "É", "the", "of", "日本", "a b", "x\x00y"]
    join = [" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "\x0b", "?"]
    texts = ["".join(w + rng.choice(join) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("en", ""), ("und", " \t . "), ("en", "New york city " * 50)]


def of(spark, rows):
    return spark.createDataFrame([(i % 3 if i % 5 else None, t, lg, 0, "clash") for i, (lg, t) in enumerate(rows)], COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("least", [2, 9])
def test_equal_to_brute_force(spark, seed, least):
    rows, s = made(seed), Settings(min_count=least, top=40)
    assert sorted(map(tuple, collocations(of(spark, rows), settings=s).collect())) == sorted(brute(rows, s))


def test_few_buckets_change_nothing(spark):
    """Buckets that hold many phrases rule out less; what is counted stays exact."""
    rows = made(3)
    s = Settings(min_count=4, most_bits=16)
    few = Settings(min_count=4, most_bits=16, buckets_a_word=1e-9)
    assert sorted(map(tuple, collocations(of(spark, rows), settings=s).collect())) == sorted(map(tuple, collocations(of(spark, rows), settings=few).collect())) == sorted(brute(rows, s))


def test_texts_longer_than_a_block(spark, monkeypatch):
    """Cuts fall beside words: a phrase across one counts once."""
    monkeypatch.setattr(co, "_BLOCK", 200)  # for what runs in this process
    text = " ".join(random.Random(5).choices(["to", "be", "or", "not", "be."], k=2000))
    blocks = list(co._blocks([text, "short", text]))
    assert b" ".join(b.strip() for b, on in blocks if b != b"short").count(b"to") == 2 * text.count("to") and sum(on for _, on in blocks) > 20
    monkeypatch.undo()
    long = " ".join(random.Random(6).choices(["to", "be", "or", "not", "be.", "w" * 30], k=250_000))
    rows, s = [("en", long), ("en", "w" * 2_000_000)], Settings(min_count=30, top=50)
    assert sorted(map(tuple, collocations(of(spark, rows), settings=s).collect())) == sorted(brute(rows, s))


def test_exact_beyond_64_bits(spark):
    """Products of counts near 2^62."""
    top = 1 << 62
    row = spark.range(1).selectExpr(f"cast({top} as bigint) a", f"cast({top} as bigint) l", f"cast({top + 1} as bigint) r")
    score = row.selectExpr("(2000000 * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) s").first()["s"]
    assert score == 2000000 * top // (2 * top + 1)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], COLUMNS)).collect() == []
