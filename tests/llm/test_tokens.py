"""Encoding, token files, packing, chat formatting: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agrolith.llm import chat, packing, queries, token_files
from agrolith.llm.encode import Encoder

ODD = ["", " ", "a  b", "\n\nx ", "it's 'say ''s x", "İstanbul ΣΑΣ", "a\x1cb", "x́ é", "<|endoftext|> b", "a <|endoftext|> b", "a<|endoftext|><|startoftext|>b <|ENDOFTEXT|>", "1 22 333", "　wide", "naïve x", "ß ſ K", "tab\tx \n y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(path, name, real):
    e = Encoder(path(name), max_words=50)
    texts = [r["text"] or "" for r in real.collect()] + ODD
    untouched = Tokenizer.from_file(path(name))
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in untouched.encode_batch(texts, add_special_tokens=False)]
    assert e.encode([None]) == [b""]
    untouched.encode_special_tokens = True
    assert Encoder(path(name), special_as_text=True).encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in untouched.encode_batch(texts, add_special_tokens=False)]


def test_end_of_text_inside_a_text(docs_of, path):
    """The ids that the tokenizer gives: the token's own in the midst of a text."""
    assert np.frombuffer(Encoder(path("word_bpe_49k.json")).encode(["a <|endoftext|> b"])[0], "<u4").tolist() == [320, 49407, 321]
    text = "a <|endoftext|> b"
    pieces = packing.pack_documents(docs_of([(1, text)]), path("byte_bpe_50k.json"), 1).collect()
    want = _ids(path, "byte_bpe_50k.json", [text])[0]
    assert b"".join(p["ids"] for p in sorted(pieces, key=lambda p: p["start"])) == want.tobytes() and 50256 in want


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def an_encoder(request, path):
    return Encoder(path(request.param))


@given(st.text(st.one_of(st.sampled_from(" \n\t.'!aAsS1é²ªßİ"), st.characters(blacklist_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoder_on_any_text(an_encoder, text):
    want = an_encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(an_encoder.encode([text])[0], "<u4").tolist() == want


def _ids(path, name, texts, end=1):
    t = Tokenizer.from_file(path(name))
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, real, path):
    data = token_files.write_tokens(real, token_files.new_folder(spark), path("word_bpe_49k.json"), 1, shards=5)
    assert data.dtype == "<u2" and token_files.open_tokens(data.path) == data
    got = token_files.read_tokens(spark, data).toPandas().sort_values("start")
    rows = real.orderBy("doc_id").collect()
    want, start = _ids(path, "word_bpe_49k.json", [r["text"] for r in rows]), 0
    assert got["doc_id"].tolist() == [r["doc_id"] for r in rows]
    for own, s, n, ids in zip(got["ids"], got["start"], got["n_tokens"], want, strict=True):
        assert own == ids.tobytes() and s == start and n == len(ids)
        start += len(ids)


def test_token_files_of_odd_rows(spark, odd, no_docs, path):
    data = token_files.write_tokens(odd, token_files.new_folder(spark), path("word_bpe_49k.json"), 1)
    got = token_files.read_tokens(spark, data).orderBy("start").collect()
    assert len(got) == odd.count() and got[0]["doc_id"] is None
    assert [r["n_tokens"] for r in got if r["doc_id"] in (7, 8, 9)] == [1, 1, 1]
    assert [r["doc_id"] for r in got][1:] == sorted(r["doc_id"] for r in got[1:])
    same = token_files.write_tokens(odd.select(F.lit(4).alias("doc_id"), "text"), token_files.new_folder(spark), path("word_bpe_49k.json"), 1, shards=3)
    assert len(same.shards) > 1 and token_files.read_tokens(spark, same).count() == odd.count()
    empty = token_files.write_tokens(no_docs, token_files.new_folder(spark), path("word_bpe_49k.json"), 1)
    assert token_files.read_tokens(spark, empty).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        token_files.local_path("hdfs://x/y")


def test_token_query(spark, sf, path, real):
    got = {r["doc_id"]: r for r in queries.op3_token_files(spark, sf).collect()}
    rows = real.orderBy("doc_id").limit(20).collect()
    for r, ids in zip(rows, _ids(path, "word_bpe_49k.json", [r["text"] for r in rows]), strict=True):
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(ids.tobytes())


def _check_packing(pieces, docs, path):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and len(own) <= 256
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    ids = _ids(path, "byte_bpe_50k.json", [t for _, t in docs])
    for (doc, _), want in zip(docs, ids, strict=True):
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == want.tobytes() and all(p["doc_tokens"] == len(want) for p in own)
    return padding / sum(map(len, ids))


def test_packing_covers_every_id_once(real, path):
    pieces = packing.pack_documents(real, path("byte_bpe_50k.json"), 1, window=32).collect()
    assert _check_packing(pieces, [(r["doc_id"], r["text"]) for r in real.collect()], path) < 0.02


def test_packing_odd_rows(odd, no_docs, path):
    pieces = packing.pack_documents(odd.where("doc_id <> 5"), path("byte_bpe_50k.json"), 1).collect()
    rows = odd.where("doc_id <> 5").collect()
    _check_packing(pieces, [(r["doc_id"], r["text"]) for r in rows], path)
    twice = packing.pack_documents(odd, path("byte_bpe_50k.json"), 1)
    assert twice.where("doc_id = 5 AND start = 0").count() == 3 and twice.where("doc_id IS NULL").count() >= 1
    assert packing.pack_documents(no_docs, path("byte_bpe_50k.json"), 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, path("byte_bpe_50k.json"), 1, packing.Limits(loss=10))


def test_packer_honours_every_limit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(t), int(t * s)) for i, (t, s) in enumerate(zip(rng.integers(1, 900, 400), rng.uniform(0, 1, 400)))]
    df = spark.createDataFrame([*rows, (1000, None, None)], "id long, n long, loss long").coalesce(1)
    limits = packing.Limits(1000, 4, 500)
    out = packing.pack_examples(df.where("loss IS NULL OR loss <= 500"), limits, "id", "n", "loss", window=64).collect()
    size = {i: (t, x) for i, t, x in rows}
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append(r["id"])
    assert sorted(i for own in seqs.values() for i in own) == sorted(i for i, _, x in rows if x <= 500)
    for own in seqs.values():
        assert sum(size[i][0] for i in own) <= 1000 and len(own) <= 4 and sum(size[i][1] for i in own) <= 500
    with pytest.raises(Exception, match="does not fit"):
        packing.pack_examples(df.withColumn("n", F.lit(2000)), limits, "id", "n", "loss").count()


def test_cut_pieces_keep_loss_limits():
    p = packing.Packer(packing.Limits(100, 10, 30), cut=True)
    for i in range(20):
        p.add(i, 70, 40)
    total = {}
    for own in p.fill(final=True):
        assert sum(s for _, _, s in own) <= 100
        for tag, _, size in own:
            total[tag] = total.get(tag, 0) + size
    assert total == {i: 70 for i in range(20)}


def test_powers_of_two():
    out = packing.powers_of_two([("a", 0, 700), ("b", 5, 600)], 2048)
    assert [sum(s for _, _, s in own) for own in out] == [1024, 256, 16, 4]
    assert packing.powers_of_two([("a", 0, 2048)], 2048) == [[("a", 0, 2048)]]


def _conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark, path):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", " \n x<!|é日本\n\n "), (1, 0, "system", None), (1, None, None, "first"), (2, 0, "assistant", ""), (None, 0, "assistant", "no id"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 1, "assistant", "<<|")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} ".rstrip() + "!" * (i % 5)) for i in range(700)]
    df = _conversations(spark, rows).withColumn("loss", F.lit(1))
    template = chat.Template(path("byte_bpe_50k.json"), segment_turns=64)
    segments = chat.format_conversations(df, template)
    assert segments.where("conv_id = 4").count() > 5
    got = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0), template)).count() == 0
    small = chat.format_conversations(df, chat.Template(path("byte_bpe_50k.json"), segment_chars=40))
    assert small.count() > segments.count() and {r["conv_id"]: r for r in chat.digests(small).collect()} == got


@given(st.text(st.sampled_from("<|!a>")))
def test_escape_is_reversible(text):
    assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text


def test_segments_encode_as_a_whole(path):
    turns = [("user", "hi  there\n"), ("assistant", " ok <|x|>"), ("user", ""), ("assistant", "é")]
    tok = chat._tokenizer(path("byte_bpe_50k.json"))
    whole, _ = chat.render(turns, ("assistant",))
    parts = [i for t in turns for i in tok.encode(chat.render([t], ("assistant",))[0], add_special_tokens=False).ids]
    assert tok.encode(whole, add_special_tokens=False).ids == parts


def test_conversations_under_three_limits(spark, sf, path):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    long = spark.createDataFrame([(9000 + k, i, "user" if i % 2 else "assistant", "many words " * (400 if k else 3)) for k in range(2) for i in range(60)] + [(None, 0, "assistant", None), (None, 1, None, "x")], "conv_id long, turn int, role string, text string")
    rows = rows.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(long)
    template, limits = chat.Template(path("byte_bpe_50k.json")), packing.Limits(8192, 36, 6144)
    out = packing.pack_conversations(rows, template, limits, window=64).collect()
    segments = {}
    for r in chat.format_conversations(rows, template).collect():
        own = segments.setdefault(r["conv_id"], [0, 0, 0])
        own[0] += len(r["ids"]) // 4
        own[1] += len(chat.parse(r["formatted"]))
        own[2] += sum(r["loss"])
    assert {r["conv_id"]: [r["tokens"], r["turns"], r["loss"]] for r in out} == segments and len(out) == len(segments)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    bound = [0, 0, 0]
    for own in by.values():
        sums = [sum(r[c] for r in own) for c in ("tokens", "turns", "loss")]
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["tokens"]
        if own[0]["fits"]:
            assert sums[0] <= 8192 and sums[1] <= 36 and sums[2] <= 6144
            bound = [b + (s >= 0.85 * m) for b, s, m in zip(bound, sums, (8192, 36, 6144))]
        else:
            assert len(own) == 1 and own[0]["conv_id"] in (9000, 9001)
    assert min(bound) > 0, bound
    need = max(sum(v[i] for k, v in segments.items() if k not in (9000, 9001)) / m for i, m in enumerate((8192, 36, 6144)))
    assert len(by) - 2 <= 1.6 * need + 2
