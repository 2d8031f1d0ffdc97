"""The numbered queries, each over its whole table with production parameters.

``TOKENIZER`` names a public vocabulary file; its place is asked of the package
that holds it, and it is never copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoscope.llm import byte_bpe, conversation_repair, exact_dedup, jaccard_join, language_id, mixing, packing, sharding, suffix_dedup, token_alignment, tokens, topk_search, toxicity
from lingoscope.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit_languages(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=200, texts=False)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), temperature=0.7)
    return out.select("doc_id", "source", "mix_position", "mix_slot", "mix_block", "mix_release", "mix_deadline", "in_mix")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), shards=8)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.aligned(table(spark, sf_dir, "documents"), str(public_tokenizers.path(BYTES)), str(public_tokenizers.path(PIECES)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trips(table(spark, sf_dir, "documents"), byte_bpe.read_ranks(str(public_tokenizers.path(RANKS))), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_packing, op3_toxicity, op4_suffix_dedup, op5_ngram_jaccard, op6_exact_dedup, op7_topk_search, op8_token_counts, op9_mixing, op10_sharding, op11_token_alignment, op12_conversation_repair, op13_byte_bpe)}


def _on(held: str, cost: str, letter: str) -> str:
    """SQL: what is held (twelve digits of cost, then letters) with one edit more."""
    return f"lpad(CAST(CAST(left({held}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({held}, 13) || '{letter}'"


def _repair_sql() -> str:
    """Least cost, then least letters, of each state of the pattern, row after row; then the letters are applied."""
    from_u, kept = "least(s0, s1, s3)", "CASE WHEN NOT gone_for AND initial = '{}' THEN {} END"
    deleted = {q: _on(f"s{q}", "2", "D") for q in range(4)}
    rerole = lambda source: f"CASE WHEN NOT gone_for THEN {_on(source, '1 + more', 'R')} END"
    return f"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named, dense_rank() OVER (ORDER BY conv_id) AS g
            FROM conversations
        ), dealt AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(named) + 1), lambda i: CAST(ascii(named[i]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS d
            FROM given
        ), rows AS (
            SELECT g, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM dealt WHERE d <> 0
        ), placed AS (
            SELECT g, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial,
                row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
                row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS again
            FROM rows
        ), faults AS (
            SELECT g, turn, role, text, k, initial, trimmed = '' AS blank, trimmed <> '' AND again > 1 AS dup, trimmed <> '' AND again = 1 AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut,
                lag(initial) OVER (PARTITION BY g ORDER BY k) AS before
            FROM placed
        ), edits AS (
            SELECT g, k, initial, blank OR dup AS gone_for, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM faults
        ), layers(g, k, s0, s1, s2, s3) AS (
            SELECT g, CAST(0 AS BIGINT), '000000000000', CAST(NULL AS VARCHAR), '000000000005I', '000000000010II' FROM (SELECT DISTINCT g FROM given)
            UNION ALL
            SELECT g, k, n0, n1, m2, least(n3, {_on('m2', '5', 'I')}) FROM (
                SELECT *, least(n2, {_on('least(n0, n1, n3)', '5', 'I')}) AS m2 FROM (
                    SELECT g, e.k, {deleted[0]} AS n0, least({deleted[1]}, {kept.format('s', _on('s0', 'more', 'K'))}) AS n1,
                        least({deleted[2]}, {kept.format('u', _on(from_u, 'more', 'K'))}, {rerole(from_u)}) AS n2,
                        least({deleted[3]}, {kept.format('a', _on('s2', 'more', 'K'))}, {rerole('s2')}) AS n3
                    FROM layers JOIN edits e USING (g) WHERE e.k = layers.k + 1
                )
            )
        ), found AS (
            SELECT g, arg_max(least(s0, s3), k) AS held FROM layers GROUP BY g
        ), letters AS (
            SELECT g, i, substr(held, 12 + i, 1) AS letter, len(replace(substr(held, 13, i), 'I', '')) AS k FROM (SELECT g, held, unnest(range(1, len(held) - 11)) AS i FROM found)
        ), living AS (
            SELECT l.g, l.i, letter, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY l.g ORDER BY l.i) AS p,
                first_value(letter = 'K' AND initial = 's') OVER (PARTITION BY l.g ORDER BY l.i) AS system
            FROM letters l LEFT JOIN faults f ON f.g = l.g AND f.k = l.k AND letter <> 'I' WHERE letter <> 'D'
        ), repaired AS (
            SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - CAST(coalesce(system, false) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole
            FROM living GROUP BY g
        ), counted AS (
            SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
                count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY g
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(left(held, 12) AS BIGINT) AS cost, substr(held, 13) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT g, conv_id FROM given) c JOIN found USING (g) LEFT JOIN repaired USING (g) LEFT JOIN counted USING (g)
    """


ORACLES = {
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), edges AS (
            SELECT x AS u, y AS v FROM links UNION SELECT y, x FROM links
        ), reach(u, v) AS (
            SELECT doc_id, doc_id FROM words UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u
        )
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
        FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) r ON r.u = w.doc_id
    """,
    "op6_exact_dedup": """
        WITH rows AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), groups AS (
            SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM rows JOIN groups USING (norm)
    """,
    "op7_topk_search": """
        WITH ints AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_conversation_repair": _repair_sql(),
}
