"""The registered queries: each applies one operator to its whole table and derives what is asked of it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm import audio, best_fit, chat, collocations, fingerprint, lang_id, lexical, mixing, packing, pii, probminhash, sharding, token_files
from agrolith.llm.common import Scratch, checkpoint, small_batches, table

#: Id that ends a document.
END_ID = 1


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ``embeddings`` stand for recordings, as no table holds media: each is played as a melody, and of every fourth there is
    a copy that starts later, ends earlier and is noisy (``audio.with_copies``). Copies have negative ids.
    """
    rows = audio.with_copies(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    recordings = audio.tones(rows, "vec_id", "embedding", "noise")
    return audio.search(audio.fingerprints(recordings, "vec_id", "audio"), "vec_id", F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = token_files.write_tokens(docs, token_files.new_folder(spark), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read_tokens(spark, data).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind_no"] < pii.BASE_KINDS)
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS[: pii.BASE_KINDS]]
    least = F.array_min(F.transform("spans", lambda s: s["score"]))
    return found.select("doc_id", *counts, F.sha2(pii.described(base), 256).alias("base_sha256"), pii.described(F.col("spans")).alias("spans"), least.alias("least_score"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprint.with_next(fingerprint.with_fingerprint(docs, F.col("text"), "fingerprint"), "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    docs = fingerprint.with_fingerprint(docs, F.col("edited"), "edited_fingerprint")
    near = fingerprint.likeness
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        near(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), near(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents")).drop("leads")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken", "copies", "quality")


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_conversations(rows.unionByName(control), chat.Template(public_tokenizers.path("byte_bpe_50k.json"))))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing rule on instruction data: conversations of ``conversations`` with their tokens, turns and loss tokens, all limits at work."""
    template = chat.Template(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), template, packing.Limits(8192, 36, 6144))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        folder = lexical.build(table(spark, sf_dir, "documents"), scratch.path)
        return checkpoint(lexical.search(spark, folder, table(spark, sf_dir, "benchmark")))


def op12_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = (op1_language_id, op2_chroma_fingerprints, op3_token_files, op4_pii, op5_document_fingerprints, op6_near_duplicates, op7_mix_sources, op8_shards, op9_chat_format, op10_pack, pack_conversations, op11_ranked_search, op12_best_fit_pack, op13_collocations)
    return {f.__name__: _prepared(f) for f in found}


def _escaped(column: str) -> str:
    return f"regexp_replace({column}, '<(!*)\\|', '<!\\1|', 'g')"


OP9_SQL = f"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', text FROM said UNION ALL SELECT -1, 1, 'assistant', text FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM t WHERE len(ws) > 0),
d AS (SELECT row_id, doc_id, ws, 100 - 90 + ((90 * len(ws) * big_n) // big_l) AS m FROM t, s WHERE len(ws) > 0),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, tf.row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d ON d.row_id = tf.row_id GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10"""

OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
m AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS c FROM m),
scored AS (SELECT m.lang, m.phrase, m.a, m.c, x.f AS l, y.f AS r, CAST((2000000 * m.a::HUGEINT) // (x.f::HUGEINT + y.f::HUGEINT) AS BIGINT) AS score
  FROM cuts m JOIN f x ON x.lang = m.lang AND x.phrase = array_to_string(m.ws[1:m.c], ' ') JOIN f y ON y.lang = m.lang AND y.phrase = array_to_string(m.ws[m.c + 1:m.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
spans AS (SELECT lang, k, a, ws, unnest(range(2, k)) AS size FROM m WHERE k > 2),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM spans) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * b.a::HUGEINT)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals ON totals.lang = kept.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query: not hashes by xxhash64, tokenizers, trained models or signatures."""
    return {"op9_chat_format": OP9_SQL, "op11_ranked_search": OP11_SQL, "op13_collocations": OP13_SQL}
