"""Registered queries of this package, one ``opN_<name>`` for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bitsliced, conversation_trie, hmm, iblt, jaccard_join, langid, license_rules, mixing, packing, quality_rules, token_files, toxicity, warc
from lamina.llm.common import remainder, table
from lamina.llm.tokenizing import public_path


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    docs = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), langid.predicted(net, F.col("text")).alias("p"))
    return docs.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    docs = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(scorer, F.col("text")).alias("score"))
    return docs.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, public_path("byte_bpe_50k.json"), 50_257)


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hmm.score(docs.select("doc_id", (remainder(F.col("doc_id"), 7) == 2).alias("held"), "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_path("word_bpe_49k.json")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.rule_columns(docs).select("doc_id", *quality_rules.COUNTS)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = conversation_trie.rebuilt(conversation_trie.turn_lists(table(spark, sf_dir, "conversations")))
    return conversation_trie.nodes(rebuilt).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *license_rules.COLUMNS)


QUERIES = {
    "op4_hmm": op4_hmm,
    "op2_toxicity": op2_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op1_language": op1_language,
    "op5_fingerprints": op5_fingerprints,
    "op3_token_files": op3_token_files,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < best THEN best END AS refers_to
        FROM m
    """,
    "op11_conversation_trie": """
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS h, CAST(length(coalesce(text, '')) AS BIGINT) AS n
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'h': h, 'n': n} ORDER BY turn NULLS FIRST, h) AS x FROM t GROUP BY conv_id),
        crc AS (
            SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM own
            UNION ALL
            SELECT conv_id, s, i + 1,
                   list_reduce(list_concat([xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(s[i // 8 + 1]) AS BIGINT) ELSE 0 END)], [CAST(0 AS BIGINT)]),
                               lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
            FROM crc WHERE i < 8 * length(s)),
        hs AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)),
        r AS (
            SELECT own.conv_id, list_concat(coalesce(b.x[1:hs.h], []), own.x[hs.h + 1:]) AS x
            FROM own JOIN hs USING (conv_id) LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 100),
        m AS (SELECT conv_id, len(x) AS n_turns, d, list_transform(x[1:d], lambda e: e.h) AS path, CASE WHEN d > 0 THEN x[d].n ELSE 0 END AS n
              FROM (SELECT conv_id, x, unnest(range(0, len(x) + 1)) AS d FROM r)),
        node AS (SELECT path, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
                        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n_turns = d), '') AS ends FROM m GROUP BY path),
        kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
        below AS (SELECT path[1:e] AS path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(saved) AS saved
                  FROM (SELECT node.*, n_children, unnest(range(0, depth + 1)) AS e FROM node LEFT JOIN kids USING (path)) GROUP BY 1)
        SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
        FROM node JOIN below ON below.path = node.path LEFT JOIN kids ON kids.path = node.path
        LEFT JOIN node p ON p.path = node.path[1:node.depth - 1] AND node.depth > 0
    """,
    "op12_lexical_search": r"""
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        qc AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY ALL),
        tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
        len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
        g AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM len),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
              FROM qc JOIN tf USING (t) JOIN w USING (t) JOIN len USING (doc_id), g GROUP BY ALL),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
}
