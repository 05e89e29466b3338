"""The queries of the training-data operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import alignment, bpe, chat, langid, merkle, mixing, packing, pii, quality, simhash, spelling, suffix_dedup, topk
from confluo.llm.common import stored, table


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    return found.select(
        "doc_id", *[F.size(pii.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(pii.of_kind(F.col("spans"), *pii.BASE)), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


def op2_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    found = langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT conv_id, turn, role, :said AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)", {"said": said})
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
        + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14) AS n
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM g
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(table(spark, sf_dir, "documents"))


def _tree_sql(text: str, name: str) -> str:
    """The leaves, paragraph and section digests of a text, as columns."""
    pieces = "list_transform(regexp_extract_all(p, '[^.!?]{1,16}[.!?]*|[.!?]+'), lambda x: left(sha256(x), 32))"
    leaves = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {pieces}))"
    joined = "sha256(coalesce(array_to_string(x, ''), ''))"
    return f"{leaves} AS {name}, list_transform({name}, lambda s: list_transform(s, lambda x: {joined})) AS {name}_p, list_transform({name}_p, lambda x: {joined}) AS {name}_s"


def _compare_sql(a: str, b: str, name: str) -> str:
    """What is open between two trees: sections, then paragraphs; leaves of what is shared; sets of open pieces."""
    every = f"range(1, greatest(len({a}_s), len({b}_s)) + 1)"
    inner = f"range(1, greatest(coalesce(len({a}_p[i]), 0), coalesce(len({b}_p[i]), 0)) + 1)"
    pairs = f"flatten(list_transform(list_filter({every}, lambda i: {a}_s[i] IS DISTINCT FROM {b}_s[i]), lambda i: list_transform({inner}, lambda j: struct_pack(i := i, j := j))))"
    pieces = lambda t: f"list_distinct(flatten(list_transform({name}_open, lambda z: coalesce({t}[z.i][z.j], CAST([] AS VARCHAR[])))))"
    return f"""coalesce(list_sum(list_transform(list_filter({every}, lambda i: {a}_s[i] = {b}_s[i]), lambda i: list_sum(list_transform({a}[i], lambda p: len(p))))), 0)
      + coalesce(list_sum(list_transform(list_filter({pairs}, lambda z: {a}_p[z.i][z.j] = {b}_p[z.i][z.j]), lambda z: len({a}[z.i][z.j]))), 0) AS {name}_shared,
    list_filter({pairs}, lambda z: {a}_p[z.i][z.j] IS DISTINCT FROM {b}_p[z.i][z.j]) AS {name}_open, {pieces(a)} AS {name}_own, {pieces(b)} AS {name}_other"""


def _dice_sql(name: str) -> str:
    total = f"(2 * {name}_shared + len({name}_own) + len({name}_other))"
    return f"CASE WHEN {total} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ({name}_shared + len(list_intersect({name}_own, {name}_other))) / {total} END"


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id),
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nx
  FROM documents
), e AS (
  SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM d
), f AS (
  SELECT doc_id, t, ed, {_tree_sql('t', 'a')}, {_tree_sql('ed', 'b')}, {_tree_sql('nx', 'c')} FROM e
), g AS (
  SELECT *, {_compare_sql('a', 'b', 'e')}, {_compare_sql('a', 'c', 'n')} FROM f
)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256,
  sha256(array_to_string(a_s, '')) AS fingerprint, sha256(array_to_string(b_s, '')) AS edited_fingerprint,
  {_dice_sql('e')} AS near_edited, {_dice_sql('n')} AS near_next, len(e_open) AS n_differing, coalesce(e_open[1].j - 1, -1) AS first_paragraph
FROM g
"""


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.score(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model)
    return found.select("doc_id", "held_out", "score", "predicted")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")), "mix-words")  # texts are read once
    return mixing.mix(words, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


# the CRC from its polynomial; near words share the word with a place masked, or one is the other with a place cut out
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents) GROUP BY 1, 2
), b AS (
  SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bs FROM r
), h AS (
  SELECT run, k, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bs), lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)])), 4294967295) AS h FROM b, crc
), c AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM h GROUP BY 1
), w AS (
  SELECT word, n FROM c WHERE length(word) >= 6 AND n >= 5
), i AS (
  SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM w
), m AS (
  SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS mask, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM i
), near AS (
  SELECT a.word, o.word AS other, o.n AS other_n FROM m a JOIN m o ON a.mask = o.mask AND a.word <> o.word
  UNION SELECT w.word, m.word, m.n FROM w JOIN m ON m.cut = w.word UNION SELECT m.word, w.word, w.n FROM w JOIN m ON m.cut = w.word
), best AS (
  SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth, count(*) OVER (PARTITION BY word) AS n_near FROM near
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND nth = 1
), up AS (
  SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, up.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f AS z ON z.word = up.root AND z.form IS NULL
"""


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", *alignment.ADDED, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_spans, op2_ball_tree_top_k, op3_language_id, op4_suffix_dedup, op5_cost_balanced_packing, op6_chat_format, op7_simhash_near_dedup, op8_merkle_fingerprints, op9_line_crf_quality, op10_source_mix, op11_spelling_variants, op12_bpe_codec, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ball_tree_top_k": OP2_SQL, "op6_chat_format": OP6_SQL, "op8_merkle_fingerprints": OP8_SQL, "op11_spelling_variants": OP11_SQL}
