"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, cover_tree, hard_negatives, html_text, near_dup, packing, quality, repeats, spelling, token_files, toxicity, vector_packing, zip_warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    held_out = ~F.coalesce(toxicity.may_train(F.col("doc_id")), F.lit(True))
    return toxicity.tag(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = zip_warc.read(zip_warc.write(_table(spark, sf_dir, "pages")), with_payload=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter(cover_tree.usable(F.col("embedding")))
    vectors = rows.select("vec_id", cover_tree.quantised(F.col("embedding")).alias("embedding"))
    return cover_tree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(_table(spark, sf_dir, "documents"))


def _sha256(column: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())


def _round_trip(model: bpe.WordBpe, ids, offsets) -> dict[str, pa.Array]:
    data = ids.astype("<u4").tobytes()
    cuts = (offsets * 4).tolist()
    return {
        "n_tokens": pa.array(offsets[1:] - offsets[:-1]),
        "ids_sha256": pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string()),
        "decoded_sha256": _sha256(model.decode(ids, offsets)),
    }


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ddl = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.encode(_table(spark, sf_dir, "documents"), path, finish=_round_trip, finish_ddl=ddl)


def _crc32(pieces: list) -> dict[str, pa.Array]:
    return {"ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64())}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path, summary=_crc32, summary_ddl="ids_crc32 long")


def _words_sha256(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.sha256(" ".join(repeats.WORD.findall(t or "")).encode()).hexdigest())


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove(_table(spark, sf_dir, "documents"))
    digest = F.pandas_udf(_words_sha256, "string")
    return kept.select("doc_id", "n_words", "n_removed", digest("text").alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    index = token_files.write_files(_table(spark, sf_dir, "documents"), path)
    counts = token_files.count(index)
    return index.join(counts, ["file", "number"]).select(F.col("id").alias("doc_id"), "n_tokens")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 5 code points and 3 occurrences of all documents, with their forms and roots."""
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), spoil=97))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens; documents and cost are bounded by the tokens alone."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return vector_packing.pack(_table(spark, sf_dir, "documents"), path, vector_packing.Room(1024), summary=_crc32, summary_ddl="ids_crc32 long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows divisible by 50, among all rows; a seventh of the labels is moved on by one."""
    rows = _table(spark, sf_dir, "embeddings").filter(cover_tree.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives.mine(rows.select("vec_id", label, cover_tree.quantised(F.col("embedding")).alias("embedding")), F.col("vec_id") % 50 == 0)


#: Exact inner products of the quantised vectors, and the payloads' digests, are plain SQL.
SQL = {
    "op2_zip_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM f""",
    "op3_top_k_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
             n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
                   FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op11_spelling_variants": """
        WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
             runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')) AS run FROM documents),
             own AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
             bytes AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM own),
             sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
             spoilt AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums),
             v AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
             gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
             inserted AS (SELECT DISTINCT gone.word AS long, gone.n AS long_n, v.word AS short, v.n AS short_n FROM gone JOIN v ON gone.rest = v.word),
             near AS (SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                      UNION ALL SELECT long, short, short_n FROM inserted UNION ALL SELECT short, long, long_n FROM inserted),
             best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
             forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
                       FROM v LEFT JOIN best ON v.word = best.word),
             chain AS (SELECT word, coalesce(form, word) AS root, 0 AS step FROM forms
                       UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL),
             ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON forms.word = ends.word""",
}


def queries() -> dict[str, Query]:
    numbered = (op1_toxicity, op2_zip_warc, op3_top_k_search, op4_near_dup, op5_bpe_round_trip, op6_packing, op7_substring_dedup, op8_token_counts, op9_html_text, op10_quality_rules, op11_spelling_variants, op12_vector_packing, op13_hard_negatives)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
