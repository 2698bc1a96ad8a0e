"""Language, audio, personal data, fingerprints, near-duplicates, mixing, sharding: against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from agrolith.llm import audio, fingerprint, lang_id, mixing, pii, probminhash, queries, sharding
from agrolith.llm.common import RangeBuckets

# ---- language --------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, sf):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both["lang"] == both["lang_pred"]).mean() > 0.97
    assert both["rejected"].mean() < 0.01 and both["score"].between(0, 1).all()
    assert 0.28 < got.agg(F.avg(F.col("held_out").cast("int"))).first()[0] < 0.39


def test_language_of_odd_rows(odd, no_docs, real):
    model = lang_id.fit(real, lang_id.Settings(per_lang=20, epochs=2))
    rows = lang_id.predict(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = r["text"] is not None and any(map(str.isalpha, r["text"]))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["rejected"] or letters
    assert lang_id.predict(no_docs, model).count() == 0
    nothing = lang_id.fit(no_docs)
    rows = lang_id.predict(odd, nothing).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0)}
    assert all(r["rejected"] == (r["text"] is None or not any(map(str.isalpha, r["text"]))) for r in rows)


def test_training_is_bounded_and_repeatable(real):
    s = lang_id.Settings(per_lang=15, epochs=2)
    a, b = lang_id.fit(real, s), lang_id.fit(real, s)
    assert np.array_equal(a.embeddings, b.embeddings) and a.langs == ["de", "en", "es", "fr"]


@pytest.fixture(scope="module")
def labelled(spark):
    """About as many rows of a language as the operator samples, and others in their order."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect() if r["text"] and r["lang"]]
    by = {lang: [r for r in rows if r["lang"] == lang][:900] for lang in ("de", "en", "es", "fr")}
    return sorted((r for own in by.values() for r in own), key=lambda r: r["doc_id"])


def _rejects(model, texts):
    z = np.array([lang_id._mean(t, model.embeddings) for t in texts]) @ model.weights + model.bias
    return np.array([s < model.threshold(len(t)) for s, t in zip(model.scores(z).max(axis=1), texts, strict=True)])


def test_rejection_tells_languages_from_the_rest(labelled):
    rng = np.random.default_rng(1)
    seen, unseen = [r for i, r in enumerate(labelled) if i % 3], [r["text"] for i, r in enumerate(labelled) if not i % 3]
    model = lang_id.train([r["text"] for r in seen], [r["lang"] for r in seen])
    assert _rejects(model, unseen).mean() < 0.01
    foreign = ["Это предложение написано на русском языке", "これは日本語の文章です。受け入れられるべきではありません", "qzxv wkjh pqzt bvxk lqwz mmjq zxkv qpwh jjkx"]
    assert _rejects(model, foreign).all()
    for n in (16, 64, 256):
        cuts = [lang_id._cut(t, n, rng) for t in unseen]
        assert _rejects(model, cuts).mean() < 0.03, n
        assert _rejects(model, [lang_id.made_up(t, rng) for t in cuts]).mean() > (0.8 if n == 16 else 0.95), n


@pytest.mark.parametrize("out", ["de", "es"])
def test_a_language_that_was_not_learned_is_rejected(labelled, out):
    rows = [r for r in labelled if r["lang"] != out]
    model = lang_id.train([r["text"] for r in rows], [r["lang"] for r in rows])
    assert _rejects(model, [r["text"] for r in labelled if r["lang"] == out]).mean() > 0.8
    assert _rejects(model, [r["text"] for r in rows]).mean() < 0.02


def test_scores_equal_plain_python(labelled):
    import math

    rows = labelled[:60]
    model = lang_id.train([r["text"] for r in rows], [r["lang"] for r in rows], lang_id.Settings(epochs=1))
    for text in ("Der Ü x.", *(r["text"][:200] for r in rows[:5])):
        data = b" " + b" ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode()).split()) + b" "
        total, n = [0.0] * 16, 0
        for size in (2, 3, 4):
            for i in range(len(data) - size + 1):
                h = size
                for b, f in zip(data[i : i + size], (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)):
                    h = ((h ^ b) * f) % 2**32
                row = model.embeddings[(h ^ h >> 15) % len(model.embeddings)]
                total, n = [t + float(x) for t, x in zip(total, row)], n + 1
        z = [sum(t / n * float(w) for t, w in zip(total, model.weights[:, k])) + float(model.bias[k]) for k in range(len(model.langs) + 1)]
        e = [math.exp((v - max(z)) / model.temperature) for v in z]
        got = model.scores((lang_id._mean(text, model.embeddings) @ model.weights + model.bias)[None])[0]
        assert got == pytest.approx([v / sum(e) for v in e[:-1]], rel=1e-3)


def test_long_texts_enter_the_sample_in_part(docs_of, spark):
    df = docs_of([(i, "word another " * 30_000) for i in range(4)]).withColumn("lang", F.lit("en"))
    model = lang_id.fit(df, lang_id.Settings(epochs=1, max_chars=100))
    assert model.langs == ["en"] and lang_id.predict(df, model).where("lang_pred = 'en'").count() == 4


# ---- audio -----------------------------------------------------------------------------------------------------------


def _melody(seed, notes=64):
    return np.random.default_rng(seed).normal(0, 0.3, notes)


def _recording(v, rate=4000, note=500):
    hz = 220.0 * 2 ** (np.floor(18 * np.tanh(4 * v)) / 12)
    return 0.5 * np.sin(np.cumsum(np.repeat(2 * np.pi * hz / rate, note)))


def test_shifted_noisy_recordings_align(spark):
    rng = np.random.default_rng(0)
    base = _recording(_melody(20))
    rows = [(20, audio.wav(base, 4000)), (21, audio.wav(base[256 * 10 :] + 0.02 * rng.normal(size=len(base) - 2560), 4000)), (22, audio.wav(base, 4000))]
    rows += [(100 + i, audio.wav(_recording(_melody(100 + i)), 4000)) for i in range(15)]
    rows += [(200, None), (201, b"noise"), (202, audio.wav(np.zeros(9000), 4000)), (40, None)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    out = {r["id"]: r for r in audio.search(prints, "id", F.col("id") % 20 == 0).collect()}
    assert out[22]["class_id"] == out[20]["class_id"] == 20
    assert [m["match"] for m in out[20]["matches"]] == [21] and out[20]["matches"][0]["offset"] == -10
    assert out[20]["matches"][0]["bit_error"] < 0.1
    assert out[21]["matches"] is None and all(not out[i]["matches"] for i in range(100, 115))
    assert out[200]["n_items"] == out[201]["n_items"] == out[202]["n_items"] == 0 and out[40]["matches"] == []
    assert out[200]["class_id"] == out[40]["class_id"]


@pytest.mark.parametrize("noise", [(0.02, 0.2), (0.2, 0.4), (0.4, 0.6)])
def test_keys_find_what_brute_force_aligns(spark, noise):
    rng, s, rows = np.random.default_rng(9), audio.Settings(), []
    for i in range(40):
        x = _recording(np.random.default_rng(i).normal(0, 0.15, 64))
        cut = int(rng.integers(0, 8000))
        rows += [(20 * i, audio.wav(x, 4000)), (20 * i + 1, audio.wav(x[cut:] + rng.uniform(*noise) * rng.normal(size=len(x) - cut), 4000))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    items = {r["id"]: np.frombuffer(r["items"], "<u4") for r in prints.collect()}
    want = set()
    for q in range(0, 800, 20):
        for c, b in items.items():
            a = items[q]
            for o in range(-len(a), len(b)):
                first, last = max(0, -o), min(len(a), len(b) - o)
                if c != q and last - first >= s.min_overlap * min(len(a), len(b)) and np.bitwise_count(a[first:last] ^ b[first + o : last + o]).mean() / 32 <= s.max_error:
                    want.add((q, c))
                    break
    got = {(r["id"], m["match"]) for r in audio.search(prints, "id", F.col("id") % 20 == 0).collect() for m in r["matches"] or []}
    print(noise, len(got), "of", len(want))
    assert got <= want and len(want) > 20 and len(got) >= 0.9 * len(want)


def test_short_recordings_and_odd_ids_are_found(spark):
    x = _recording(_melody(3), note=500)
    y = x[: 4000 * 2]  # about a dozen integers
    other = _recording(_melody(8))
    rows = [(20, x), (21, y), (40, y[256 * 4 :]), (None, other), (60, other[256 * 12 :]), (None, other[256 * 30 :]), (80, _recording(_melody(77))), (80, _recording(_melody(77))[256 * 20 :])]
    prints = audio.fingerprints(spark.createDataFrame([(i, audio.wav(v, 4000)) for i, v in rows], "id long, audio binary"), "id", "audio")
    out = audio.search(prints, "id", F.col("id") % 20 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r["id"], []).append(sorted((m["match"] is None, m["match"], m["offset"]) for m in r["matches"] or []))
    assert [m[:2] for m in found[20][0]] == [(False, 21), (False, 40)]
    assert {m[1] for m in found[40][0]} == {20, 21}
    assert [m[0] for m in found[60][0]] == [True, True]
    assert [[m[1:] for m in own] for own in sorted(found[80])] == [[(80, -20)], [(80, 20)]] or [[m[1:] for m in own] for own in sorted(found[80])] == [[(80, 20)], [(80, -20)]]
    assert len(out) == len(rows)


def test_a_quarter_of_bits_may_differ(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 32, 120, np.uint32)
    flips = lambda share: np.concatenate([np.zeros(60, np.uint32), (rng.random((60, 32)) < share) @ (1 << np.arange(32))]).astype(np.uint32)
    rows = [(0, a), (1, a ^ flips(0.3)), (2, a ^ flips(0.4)), (3, a ^ flips(0.6))]
    prints = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in rows], "id long, items binary")
    found = next(r["matches"] for r in audio.search(prints, "id", F.col("id") == 0).collect() if r["id"] == 0)
    assert [(m["match"], m["offset"]) for m in found] == [(1, 0), (2, 0)]
    assert 0.1 < found[0]["bit_error"] < found[1]["bit_error"] < 0.25


def test_integral_image_equals_direct_sums():
    s, rng = audio.Settings(), np.random.default_rng(2)
    energy = np.abs(rng.normal(size=(40, 12)))
    got = audio.items(energy, s)
    for t in (0, 7, 24):
        packed = 0
        for kind, c, h, w in audio.filters(s.window):
            x = energy[t : t + w, c : c + h]
            total, hh, hw = x.sum(), h // 2, w // 2
            value = {
                0: total / (energy[t : t + w].sum() + 1e-9) - h / 12,
                1: (x[:, hh:].sum() - x[:, :hh].sum()) / (total + 1e-9),
                2: (x[hw:].sum() - x[:hw].sum()) / (total + 1e-9),
                3: (x[:hw, :hh].sum() + x[hw:, hh:].sum() - x[:hw, hh:].sum() - x[hw:, :hh].sum()) / (total + 1e-9),
            }[kind]
            level = int(np.digitize(value, (-0.15, 0.0, 0.15)))
            packed = packed << 2 | (level ^ level >> 1)
        assert packed == got[t]


def _aligned(a, b, s):
    """Whether brute force over all offsets aligns two recordings."""
    for o in range(-len(a), len(b)):
        first, last = max(0, -o), min(len(a), len(b) - o)
        if last > first and last - first >= s.min_overlap * min(len(a), len(b)) and np.bitwise_count(a[first:last] ^ b[first + o : last + o]).mean() / 32 <= s.max_error:
            return True
    return False


def test_audio_query_finds_its_copies(spark, sf):
    out = queries.op2_chroma_fingerprints(spark, sf).collect()
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    ids = {r["vec_id"] for r in vectors.select("vec_id").collect()}
    copies = {-(i + 1) for i in ids if i % 4 == 0}
    assert {r["vec_id"] for r in out} == ids | copies and len(out) == len(ids) + len(copies)
    asked = {r["vec_id"]: r["matches"] for r in out if r["vec_id"] % 20 == 0}
    assert all(m is not None for m in asked.values()) and all(r["matches"] is None for r in out if r["vec_id"] % 20)
    got = {(q, m["match"]) for q, own in asked.items() for m in own}
    prints = audio.fingerprints(audio.tones(audio.with_copies(vectors, "vec_id", "embedding"), "vec_id", "embedding", "noise"), "vec_id", "audio").collect()
    items, s = {r["vec_id"]: np.frombuffer(r["items"], "<u4") for r in prints}, audio.Settings()
    want = {(q, c) for q in asked for c in items if c != q and _aligned(items[q], items[c], s)}
    planted = {(q, -(q + 1)) for q in asked}
    print("brute force", len(want), "found", len(got & want), "planted", len(planted & got), "of", len(planted))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 20
    assert len(planted & got) >= 0.9 * len(planted & want) > 0


def test_frequent_keys_are_dealt_in_parts(spark):
    """A jingle in every recording: as many parts as its postings take, and the same matches."""
    rng, rows = np.random.default_rng(1), []
    jingle = rng.integers(0, 1 << 32, 60, np.uint32)
    for i in range(60):
        own = rng.integers(0, 1 << 32, 40, np.uint32)
        rows.append((i, np.concatenate([own[: i % 17], jingle, own[i % 17 :]]).astype("<u4").tobytes()))
    prints = spark.createDataFrame(rows, "id long, items binary")
    out = [sorted(tuple(m) for r in audio.search(prints, "id", F.col("id") % 20 == 0, audio.Settings(dealt=d)).collect() for m in r["matches"] or []) for d in (256, 7)]
    assert out[0] == out[1] and len(out[0]) == 3 * 59
    post = spark.range(1000).selectExpr("id as node", "id % 2 * 5 as item", "cast(id as int) as at")
    met = audio._met(spark.range(3).selectExpr("id as q", "id as item", "0 as q_at"), post, 50)
    assert met.count() == 500 and met.groupBy("item", "part").count().agg(F.max("count")).first()[0] < 100


# ---- personal data ---------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _brute(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


TRICKY = [
    "a@b.c_d@e.f x..y@h.i.j..k m@.b q@a- a.b@c.d-.", "1.2.3.4.5 999.1.1.1 001.02.3.255 1.1.1.256", "4111 1111 1111 1111 5 4111-1111-1111-1111 4111--1111", "+1 (415) 555-0100+1 2 +44.20.7946.0958 +123", "é日本 a@b.co 😀 1.2.3.4",
    "a@b.c.d x@y.z", "a@b.c.", "@", "+", "", "4242424242424242 4242 4242 4242 4242", "x" * 5000 + "@a.b", "1" * 30_000, "1 " * 30_000, "a@" + "b." * 30_000 + "c", "+1" * 20_000, "1." * 20_000,
]


def test_base_spans_equal_brute_force(docs_of, real):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(1000 + r["doc_id"], r["text"]) for r in real.collect()]
    for r in pii.find(docs_of(rows)).select("text", F.filter("spans", lambda s: s["kind_no"] < 4).alias("s")).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["s"]] == _brute(r["text"]), r["text"][:80]


LONG = ["x" * 1_000_000 + " @", "x" * 1_000_000 + "@a.b" + " c@" + "d" * 1_000_000, "1" * 1_000_000 + " 1.2", "1.2 " * 250_000 + "1.2.3.4", "1.2.3.4 a@b.co " * 20_000, "+1" + "(" * 1_000_000, "aB3" * 300_000 + " @ + 1.2 AB12" + "3" * 1_000_000, "4111 1111 1111 1111 x " * 10_000, "a.b" * 300_000 + "@c"]


@pytest.mark.parametrize("i", range(len(LONG)))
def test_time_grows_with_the_length(docs_of, i):
    import time

    found = pii.find(docs_of([(0, LONG[i])]))
    t = time.time()
    got = pii.redact(found, "clean").select(F.filter("spans", lambda s: s["kind_no"] < 4).alias("s"), F.length("clean").alias("n")).first()
    assert time.time() - t < 20
    if i not in (0, 1, 2, 6, 8):  # there Python's own search takes the square of the length
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got["s"]] == _brute(LONG[i])
    else:
        assert [(s["kind"], s["end"]) for s in got["s"]] == ([("email", 1_000_004)] if i == 1 else [])


def test_scores_decide(docs_of):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'x token = "{key}"'), (2, f"x {key}"), (3, "version 1.2.3.4"), (4, "at 1.2.3.4"), (5, "license, version 3.\n1.2.3.4"), (6, f"{key}0 " * 3 + "token " + "f" * 65)]
    out = {r["doc_id"]: r for r in pii.redact(pii.find(docs_of(rows)), "clean").collect()}
    assert [s["kind"] for s in out[1]["spans"]] == ["secret"] and out[1]["clean"] == 'x token = "<secret>"'
    assert out[2]["spans"] == [] and out[6]["spans"] == []
    assert [s["kind"] for s in out[3]["spans"]] == ["ip"] and out[3]["clean"] == "version 1.2.3.4"
    assert out[4]["clean"] == "at <ip>" and out[5]["clean"].endswith("\n<ip>")


def test_accounts_context_and_redaction(docs_of):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32, or GB82WEST12345698765432 but GB82WEST12345698765433"), (2, "my card 4111111111111111"), (3, "zz 4111111111111111"), (4, "mail a@b.co +1.2.3.4.5.6.7.8.9")]
    out = {r["doc_id"]: r for r in pii.redact(pii.find(docs_of(rows)), "clean").collect()}
    assert [s["kind"] for s in out[1]["spans"]] == ["iban", "iban"] and out[1]["clean"] == "IBAN <iban>, or <iban> but GB82WEST12345698765433"
    assert out[2]["spans"][0]["score"] > out[3]["spans"][0]["score"]
    assert out[3]["clean"] == "zz <card>"
    assert out[4]["clean"].startswith("mail <email> <phone>") and "1.2" not in out[4]["clean"]


def test_pii_of_odd_rows(odd, no_docs):
    out = pii.find(odd.withColumn("spans", F.lit(1)))
    assert out.count() == odd.count() and out.columns.count("spans") == 1
    assert out.where("text IS NULL AND size(spans) > 0").count() == 0
    assert pii.redact(out.where("text IS NULL"), "c").where("c IS NOT NULL").count() == 0
    assert pii.find(no_docs).count() == 0


def test_pii_query(spark, sf, real):
    import hashlib

    got = {r["doc_id"]: r for r in queries.op4_pii(spark, sf).collect()}
    for r in real.collect():
        want = _brute(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def test_likeness_estimates_jaccard(spark, sf, real):
    got = {r["doc_id"]: r for r in queries.op5_document_fingerprints(spark, sf).collect()}
    rows = real.orderBy(F.desc("doc_id")).collect()
    errors = []
    for i, r in enumerate(rows):
        text, following = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        own = got[r["doc_id"]]
        import hashlib

        assert own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and own["n_chars"] == len(text)
        errors += [own["near_edited"] - _jaccard(_shingles(text), _shingles(edited)), own["near_next"] - _jaccard(_shingles(text), _shingles(following))]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def _plain_fingerprint(text, s=fingerprint.Settings()):
    """Binning and densification in plain Python: signed 64-bit hashes as Spark makes them."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower().strip(" \t\n\x0b\f\r"))]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chained(own):
        seed = 42
        for x in own:
            seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        return signed(seed)

    shingles = [chained(h)] if len(h) < s.words else [chained(h[i : i + s.words]) for i in range(len(h) - s.words + 1)]
    low, bins = (1 << 64 - s.bin_bits) - 1, [None] * s.bins
    for x in shingles:
        at = (x >> 64 - s.bin_bits) + s.bins // 2
        if x & low != low and (bins[at] is None or x < bins[at]):
            bins[at] = x
    rng = random.Random(s.bins)
    drawn = lambda most: [rng.randrange(1, most) for _ in range(s.bins)]
    factor, offset = drawn(65_537), drawn(65_537)
    tries, filled, out = [drawn(s.bins) for _ in range(8)], [i for i, x in enumerate(bins) if x is not None], ""
    for i, x in enumerate(bins):
        lenders = [bins[(i + t[i]) % s.bins] for t in tries] + [bins[min(filled, key=lambda c: ((c + 1) * factor[i] + offset[i]) % 65_537 * s.bins + c)] if filled else 0]
        own = x if x is not None else next(y for y in lenders if y is not None)
        out += f"{own & (1 << s.kept_bits) - 1:0{s.kept_bits // 4}x}"
    return out


def test_bins_equal_plain_python(docs_of, real):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "\tgamma", "é日", "x\n"], k=rng.choice([0, 1, 4, 5, 6, 30, 400])))) for i in range(40)] + [(99, None), (98, "  ")]
    df = docs_of(rows).unionByName(real.limit(20))
    for r in fingerprint.with_fingerprint(df.select("text"), F.col("text"), "f").collect():
        assert r["f"] == _plain_fingerprint(r["text"]), (r["text"] or "")[:60]


def test_equal_texts_have_equal_fingerprints(odd, no_docs):
    f = fingerprint.with_fingerprint(odd, F.col("text"), "fp").collect()
    by = {}
    for r in f:
        assert re.fullmatch("[0-9a-f]{256}", r["fp"])
        by.setdefault(" ".join((r["text"] or "").lower().split()), set()).add(r["fp"])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    assert fingerprint.with_fingerprint(no_docs, F.col("text"), "fp").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_row(spark, parts):
    ids = [i * i % 97 for i in range(40)] + [-5]
    ids = sorted(set(ids))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "k long, t string").repartition(5)
    got = {r["k"]: r["next_t"] for r in fingerprint.with_next(df, "k", ["t"], parts).collect()}
    down = ids[::-1]
    assert got == {k: f"t{down[(i + 1) % len(down)]}" for i, k in enumerate(down)}


def test_next_row_of_odd_keys(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "d")], "k long, t string")
    assert sorted((r["t"], r["next_t"]) for r in fingerprint.with_next(df, "k", ["t"], 3).collect()) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    alone = fingerprint.with_next(df.limit(1), "k", ["t"]).collect()
    assert [(r["t"], r["next_t"]) for r in alone] == [("a", "a")]
    assert fingerprint.with_next(df.limit(0), "k", ["t"]).count() == 0


def test_names_of_passage_do_not_clash(docs_of):
    df = docs_of([(1, "a b c d e f"), (2, "b c")]).select("doc_id", "text", *[F.lit(1).alias(c) for c in ("_hashes", "_SORTED", "_first", "_bucket", "_guest", "_home")])
    f = fingerprint.with_fingerprint(df, F.col("text"), "fp")
    assert f.columns == [*df.columns, "fp"]
    assert fingerprint.with_next(f, "doc_id", ["fp"]).columns == [*f.columns, "next_fp"] and fingerprint.with_next(f, "doc_id", ["fp"]).count() == 2


def test_range_buckets(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 100 == 99, None).otherwise(F.col("id") * F.col("id")).alias("k"))
    for n in (1, 2, 7, 16, 50):
        b = RangeBuckets(df, "k", n)
        rows = df.select("k", b.expr(F.col("k")).alias("b")).collect()
        for r in rows:
            assert r["b"] == (0 if r["k"] is None else sum(c < r["k"] for c in b.cuts)) and r["b"] < b.count


# ---- near-duplicates -------------------------------------------------------------------------------------------------


def _direct(a, b):
    """Probability Jaccard by its definition."""
    w, v = (dict(zip(h.tolist(), probminhash.weights(c).tolist(), strict=True)) for h, c in (a, b))
    keys = set(w) | set(v)
    total = 0.0
    for i in set(w) & set(v):
        total += 1 / sum(max(w.get(j, 0) / w[i], v.get(j, 0) / v[i]) for j in keys)
    return total


def _some_sets(n=12, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    base = list(rng.choice(words, 150))
    texts = []
    for i in range(n):
        t = list(base)
        for at in rng.integers(0, 150, 3 * i):
            t[at] = rng.choice(words)
        texts.append(" ".join(t + t[:40]))
    return [probminhash.shingles(probminhash.word_list(t), 5) for t in texts]


def test_similarity_equals_definition():
    sets = _some_sets()
    for a in sets[:4]:
        for b in sets:
            assert probminhash.similarity(a, b) == pytest.approx(_direct(a, b))
    assert probminhash.similarity(sets[0], sets[0]) == pytest.approx(1)


def test_registers_estimate_probability_jaccard():
    sets = _some_sets()
    sig = probminhash.signatures([h for h, _ in sets], [c for _, c in sets], 2048)
    for i, s in enumerate(sets):
        assert (sig[0] == sig[i]).mean() == pytest.approx(_direct(sets[0], s), abs=0.06)


def _brute_classes(texts, threshold=0.8):
    ids = sorted(texts)
    sets = {i: probminhash.shingles(probminhash.word_list(texts[i]), 5) for i in ids}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (texts[a] or "").lower().split() == (texts[b] or "").lower().split() or b < a and probminhash.similarity(sets[a], sets[b]) >= threshold:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_classes_equal_brute_force(docs_of):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, passage = {}, [word() for _ in range(60)]
    for g in range(25):
        base = [word() for _ in range(rng.integers(30, 200))] + (passage if g % 2 else [])
        for _ in range(rng.integers(1, 8)):
            t = list(base)
            for at in rng.integers(0, len(t), rng.integers(0, 4)):
                t[at] = word()
            texts[len(texts)] = " ".join(t)
    texts |= {500: None, 501: "", 502: " \n", 503: "short", 504: "Short", 505: "other"}
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs_of(list(texts.items()))).collect()}
    assert got == _brute_classes(texts)


def test_rounds_and_rest_find_the_same(docs_of):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 300))
    rows = []
    for i in range(60):
        t = list(base)
        for at in rng.integers(0, 300, 12):
            t[at] = rng.choice(words)
        rows.append((i, " ".join(t)))
    texts = dict(rows)
    for rounds, block in ((0, 256), (0, 7), (1, 256), (2, 7)):
        got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs_of(rows), probminhash.Settings(rounds=rounds, block=block)).collect()}
        assert got == _brute_classes(texts), (rounds, block)


def test_repeated_text_is_near_its_original(docs_of):
    texts = {i: " ".join(f"t{i}w{j}" for j in range(200)) for i in range(2)}
    rows = [(10 * i + n, " ".join([t] * n)) for i, t in texts.items() for n in (1, 2, 3)]
    for rounds in (0, 2):
        got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs_of(rows), probminhash.Settings(rounds=rounds)).collect()}
        assert got == _brute_classes(dict(rows)) == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}


def test_texts_not_ids_are_linked(docs_of):
    a, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "acd")
    near = lambda t: t + " and one more"
    rows = [(5, a), (None, near(a)), (None, c), (None, c), (None, near(c)), (1, d), (2, near(d)), (2, c + " x"), (3, "alone"), (3, "apart")]
    out = [(r["doc_id"], r["class_id"], r["leads"], r["t"]) for r in probminhash.classes(docs_of(rows).withColumn("t", F.col("text")), keep=("t",)).collect()]
    of = {}
    for doc, class_id, _, t in out:
        of.setdefault((doc, t), set()).add(class_id)
    assert of == {(5, a): {5}, (None, near(a)): {5}, (None, c): {2}, (None, near(c)): {2}, (1, d): {1}, (2, near(d)): {1}, (2, c + " x"): {2}, (3, "alone"): {3}, (3, "apart"): {3}}
    assert sorted(t for _, _, leads, t in out if leads) == sorted([a, d, c + " x", "alone", "apart"])


def test_classes_without_ids(docs_of):
    rows = [(None, "one two three"), (None, "one two three"), (None, "four five six")]
    out = probminhash.classes(docs_of(rows), keep=("text",)).collect()
    assert {r["class_id"] for r in out} == {None} and sorted(r["text"] for r in out if r["leads"]) == ["four five six", "one two three"]


def test_counts_are_not_capped(docs_of):
    many = "a " * 70_004 + "b " * 70_004
    h, c = probminhash.shingles(probminhash.word_list(many), 5)
    assert c.max() == 70_000
    assert probminhash._unpacked(h.astype("<u4").tobytes(), c.astype("<u4").tobytes())[1].tolist() == c.tolist()
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(docs_of([(1, many), (2, many + "c"), (3, "a " * 70_004)])).collect()}
    assert got == _brute_classes({1: many, 2: many + "c", 3: "a " * 70_004})


def test_recall_on_documents(spark, sf, real):
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    want = _brute_classes(texts)
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_near_duplicates(spark, sf).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 5 and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    assert all(want[got[i]] == want[i] for i in want)


def test_classes_of_odd_rows(odd, no_docs):
    rows = probminhash.classes(odd.withColumn("bucket", F.lit(1))).collect()
    assert len(rows) == odd.count()
    by = Counter((r["doc_id"], r["class_id"]) for r in rows)
    assert by[(5, 5)] == 3 and {c for (d, c) in by if d in (2, 7, 8, 9)} == {2}
    assert by[(None, None)] == 1 and Counter(r["leads"] for r in rows)[True] == 8  # 5 and "x" with id 5, the null id, blank, 10, 11, 3, 1
    assert probminhash.classes(no_docs).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(30)] + [(100, 50), (50, 75), (75, 60)]
    got = {r["node"]: r["label"] for r in probminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 50 for i in (50, 60, 75, 100)}


# ---- mixing ----------------------------------------------------------------------------------------------------------


def _water_fill(sizes, weights, budget, most):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def test_targets_equal_repeated_resharing(spark, docs_of):
    rng = np.random.default_rng(7)
    for _ in range(4):
        sizes = {(f"s{i}" if i else None): int(n) for i, n in enumerate(rng.integers(1, 1000, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _water_fill(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_mix_query(spark, sf, real):
    a, b = (queries.op7_mix_sources(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.equals(b)
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in real.collect()}
    assert a.set_index("doc_id")["size"].to_dict() == words and (a["taken"] <= 2 * a["size"]).all()
    source = {r["doc_id"]: r["source"] for r in real.collect()}
    by = a.assign(source=a["doc_id"].map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    assert (abs(by["taken"] - by["target"]) <= by["most"] / 2 + 1).all()
    want = _water_fill(by["size"].to_dict(), (3.0, 1.0, 2.0), 1.5, 2.0)
    assert by["target"].to_dict() == {k: pytest.approx(v) for k, v in want.items()}


def test_epochs_come_first_and_heavier_documents_are_likelier(docs_of):
    prose, junk = "words of prose here " * 3, "x y z w " * 3
    rows = [(i, prose if i % 2 else junk, "a") for i in range(2000)] + [(5000, "w " * 100_000, "b")]
    out = mixing.mix(docs_of(rows), mixing.Settings(weights=(1.0, 40.0), budget=1.2)).where("source = 'a'").toPandas()
    assert out["copies"].isin([0, 1, 2]).all()
    taken = out.groupby(out["doc_id"] % 2)["copies"].mean()
    assert taken[1] > taken[0]


def test_mixed_rows_equal_the_plan(odd, real, no_docs):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(real).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed(real).collect())
    assert got == Counter({k: v for k, v in plan.items() if v})
    out = mixing.mix(odd)
    assert out.count() == odd.count() and out.where("size = 0 AND taken > 0").count() == 0
    assert mixing.mixed(odd.withColumn("key", F.lit(1))).columns == [*odd.columns, "key"]
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_repeated_rows_are_taken_up_to_the_target(docs_of):
    rows = [(7, "one two three four five six", "a")] * 1000 + [(i, "w " * 50, "b") for i in range(100, 200)] + [(None, None, "c")] * 5 + [(None, "x y", None)] * 9
    docs = docs_of(rows).repartition(6)
    settings = mixing.Settings(weights=(3.0, 2.0), budget=0.75)
    out = mixing.mix(docs, settings).toPandas()
    assert len(out) == len(rows)
    by = out.fillna({"source": "-"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by["taken"] - by["target"]) <= by["most"] / 2 + 1e-6).all() and 0 < by.loc["a", "taken"] < 6000
    assert set(out.loc[out["source"] == "a", "copies"]) == {0, 1}
    got = mixing.mixed(docs, settings).groupBy("source").count().collect()
    plan = out.fillna({"source": "-"}).groupby("source")["copies"].sum().to_dict()
    assert {r["source"] or "-": r["count"] for r in got} == {k: v for k, v in plan.items() if v}


# ---- sharding --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 64, 101, 997, 1000])
def test_network_is_a_permutation(n):
    assert sorted(sharding.permuted(i, n, 3) for i in range(n)) == list(range(n))
    a, b = sharding.domain(n)
    assert a * b >= n


def test_expression_equals_python(spark):
    for n in (11, 500, 977):
        got = spark.range(n).select(sharding.permuted_expr(F.col("id"), n, 9)).collect()
        assert [r[0] for r in got] == [sharding.permuted(i, n, 9) for i in range(n)]


def test_walks_outside_the_domain(spark, monkeypatch):
    monkeypatch.setattr(sharding, "domain", lambda n: (n, 3))
    got = sorted(r[0] for r in spark.range(50).select(sharding.permuted_expr(F.col("id"), 50, 4)).collect())
    assert got == list(range(50))


def test_shard_query(spark, sf, real):
    import zlib

    got = queries.op8_shards(spark, sf).toPandas()
    assert sorted(got["doc_id"]) == sorted(r["doc_id"] for r in real.collect())
    sizes = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()
    by = got.set_index("doc_id")
    for r in real.collect():
        raw = (r["text"] or "").encode()
        assert by.loc[r["doc_id"], "size"] == len(raw) + 1 and by.loc[r["doc_id"], "text_crc32"] == zlib.crc32(raw)


def test_shards_of_odd_rows(odd, no_docs):
    out = sharding.shard(odd.withColumn("shard", F.lit(9)), 5).toPandas()
    assert sorted(out["row_number"]) == list(range(len(out))) and len(out) == odd.count()
    assert out.loc[out["row_number"] == 0, "doc_id"].isna().all()
    assert sharding.shard(no_docs, 5).count() == 0
