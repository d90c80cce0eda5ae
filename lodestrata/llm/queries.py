"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import alignment, decontaminate, exact_search, importance, langid, language_model, mixing, near_dedup, pieces, secret_scan, sharding, token_counts, toxicity
from lodestrata.llm.common import documents, id_bucket

SHARDS = [f"shard-{k:03d}" for k in range(64)]
SLOTS = 8_191
TOKEN_LIMIT = 1_024
TOXIC_FROM = 0.7


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS, SLOTS)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(langid.training_rows(docs, id_bucket("doc_id", 5)))
    return langid.identify(docs, model).select("doc_id", F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    base = F.array_join(F.filter(spans, lambda s: ~s.startswith("random:")), ",")
    of = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, vocabulary = language_model.count(language_model.training_rows(docs))
    encoded = language_model.encode(docs, vocabulary)
    network = language_model.train(encoded.where(id_bucket("doc_id", 10) != 0), vocabulary.freq)
    scored = language_model.score_encoded(encoded, counts, vocabulary, network)
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id_bucket("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s["starts"].cast("string"), s["ends"].cast("string")))
    return scored.select("doc_id", F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("starts").alias("n_spans"), F.array_join(spans, ",").alias("spans"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_near_dedup, op3_decontamination, op4_sentencepiece, op5_language_id, op6_exact_top_k, op7_token_counts, op8_secret_scans, op9_language_model, op10_toxicity, op11_mixing, op12_alignment, op13_importance_resampling)
    return {f.__name__: f for f in own}


def placement_table() -> list[int]:
    """The lookup table by plain turn-taking over written-out permutations, for the SQL twin of the placement."""
    orders = []
    for name in SHARDS:
        digest = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(digest[:16], 16) % SLOTS, int(digest[16:], 16) % (SLOTS - 1) + 1
        orders.append(iter([(offset + j * skip) % SLOTS for j in range(SLOTS)]))
    owner: dict[int, int] = {}
    while len(owner) < SLOTS:
        for k, order in enumerate(orders):
            if len(owner) < SLOTS:
                owner[next(s for s in order if s not in owner)] = k
    return [owner[s] for s in range(SLOTS)]


def oracle_sql() -> dict[str, str]:
    """SQL twins. Searching integer vectors is quadratic but small; the others that SQL can express are too slow on whole texts and are tested against brute force."""
    table = ",".join(map(str, placement_table()))
    return {
        "op1_sharding": f"""
            WITH keyed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 12)) AS BIGINT) % {SLOTS} AS slot FROM documents),
            tab AS (SELECT unnest(string_split('{table}', ',')) AS shard, unnest(range({SLOTS})) AS slot)
            SELECT CAST(k.slot AS INTEGER) AS slot, k.doc_id, CAST(t.shard AS INTEGER) AS shard FROM keyed k JOIN tab t USING (slot)""",
        "op6_exact_top_k": """
            WITH v AS (
                SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            q AS (SELECT row_number() OVER () AS query, vec_id, e FROM (SELECT DISTINCT vec_id, embedding, e FROM v WHERE vec_id % 50 = 0)),
            scored AS (
                SELECT q.query, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM scored)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
        "op11_mixing": """
            WITH m AS (
                SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS part FROM m GROUP BY source),
            w AS (SELECT *, CASE part % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
            f AS (
                SELECT *, CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over,
                    sum(weight) OVER (ORDER BY source_size / weight, part ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS heavy FROM w),
            c AS (SELECT *, 2 * source_size * heavy <= weight * left_over AS capped FROM f),
            level AS (SELECT left_over, heavy FROM c WHERE NOT capped ORDER BY source_size / weight, part LIMIT 1),
            t AS (SELECT source, part, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT left_over FROM level) / (SELECT heavy FROM level) END AS target FROM c),
            r AS (SELECT *, CAST(ceil(source_size / 1024) AS BIGINT) AS blocks, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
            l AS (SELECT *, CAST(floor(target) AS BIGINT) - rounds * source_size AS last FROM r),
            n AS (SELECT *, CAST(rounds * blocks + ceil(last / 1024) AS BIGINT) AS slots FROM l),
            g AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cell, greatest(1, len(bin(CAST(sum(slots) OVER () AS BIGINT) - 1)))::INTEGER AS bits FROM n),
            cells AS (SELECT part, blocks, rounds, last, source_size, bits, cell + unnest(range(slots)) AS cell FROM g WHERE slots > 0),
            timed AS (SELECT *, CAST('0b' || reverse(lpad(bin(cell), bits, '0')) AS BIGINT) AS moment FROM cells),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY moment) - 1 AS rank FROM timed),
            slots AS (SELECT part, rank % blocks AS block, least(1024, CASE WHEN rank // blocks < rounds THEN source_size ELSE last END - rank % blocks * 1024) AS words FROM ranked),
            placed AS (
                SELECT m.doc_id, m.size, t.part, t.source_size, t.target, row_number() OVER () AS id,
                    CAST(coalesce(sum(m.size) OVER (PARTITION BY t.part ORDER BY m.place, m.doc_id NULLS FIRST, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
            used AS (
                SELECT id, sum(least(start + size, block * 1024 + words) - greatest(start, block * 1024)) AS taken FROM placed JOIN slots USING (part)
                WHERE block >= start // 1024 AND block <= (start + size - 1) // 1024 AND least(start + size, block * 1024 + words) > greatest(start, block * 1024) GROUP BY id)
            SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN used USING (id)""",
        "op13_importance_resampling": """
            WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
            texts AS (SELECT row_number() OVER () AS row, doc_id, 0 AS target, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, 1, text FROM benchmark),
            cut AS (SELECT row, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
            grams AS (
                SELECT row, target, unnest(words) AS gram FROM cut
                UNION ALL SELECT row, target, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM cut WHERE len(words) > 1),
            counted AS (SELECT row, target, gram, count(*) AS n FROM grams GROUP BY ALL),
            known AS (SELECT DISTINCT gram, '0000' || hex(encode(gram)) AS h FROM counted),
            hashed AS (
                SELECT gram, xor(list_reduce(list_concat([4294967295], list_transform(range(2, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM known, crc_table),
            f AS (SELECT row, target, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (gram) GROUP BY ALL),
            sums AS (SELECT bucket, sum(CASE WHEN target = 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN target = 1 THEN n ELSE 0 END)::DOUBLE AS t FROM f GROUP BY bucket),
            gain AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM sums) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
            means AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN gain USING (bucket) WHERE target = 0 GROUP BY row),
            weights AS (
                SELECT c.row, c.doc_id, len(c.words) AS n_words, coalesce(m.n_features, 0) AS n_features, CASE WHEN m.n_features > 0 THEN (m.total - ((m.total % m.n_features) + m.n_features) % m.n_features) // m.n_features ELSE 0 END AS weight
                FROM cut c LEFT JOIN means m USING (row) WHERE c.target = 0),
            scored AS (
                SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weights),
            drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS rank FROM scored WHERE n_words >= 20)
            SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
                CAST(CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM drawn) THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN drawn USING (row)""",
    }
