"""One registered query per operator, over its whole table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from contactmine.llm import (
    bpe, collocations, decontamination, exact, language, licenses, merkle, quality, records, secrets, simhash, suffixes, warc,
)
from contactmine.llm.common import LOWER, UPPER, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN).drop("ids")


def op7_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_records(spark: SparkSession, folder: str) -> DataFrame:
    return records.token_records(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(table(spark, folder, "documents"))


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_language, op3_warc, op4_licenses, op5_decontamination, op6_bpe, op7_simhash_dedup, op8_records,
        op9_suffix_dedup, op10_secrets, op11_collocations, op12_merkle, op13_quality,
    )
}

# CRC-32 of a decimal number, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, byte:
    list_reduce([xor(x, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, step: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _folded() -> str:
    return "sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)"


ORACLES = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op11_collocations": f"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM piece),
        f1 AS (SELECT lang, w1, count(*) AS f FROM (SELECT lang, unnest(w) AS w1 FROM w) GROUP BY ALL),
        f2 AS (
            SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS f
            FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS x FROM w) GROUP BY ALL HAVING count(*) >= 10
        ),
        f3 AS (
            SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS f
            FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS x FROM w)
            GROUP BY ALL HAVING count(*) >= 10
        ),
        longer AS (
            SELECT lang, w1, w2, max(f) AS most
            FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
        ),
        two AS (
            SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, (1000000::HUGEINT * p.f * p.f // (l.f::HUGEINT * r.f), 1, l.f, r.f) AS cut
            FROM f2 p JOIN f1 l ON l.lang = p.lang AND l.w1 = p.w1 JOIN f1 r ON r.lang = p.lang AND r.w1 = p.w2
            LEFT JOIN longer m ON m.lang = p.lang AND m.w1 = p.w1 AND m.w2 = p.w2
            WHERE m.most IS NULL OR 100 * m.most < 50 * p.f
        ),
        three AS (
            SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3 AS phrase, p.f AS a, least(
                (1000000::HUGEINT * p.f * p.f // (l1.f::HUGEINT * r1.f), 1, l1.f, r1.f),
                (1000000::HUGEINT * p.f * p.f // (l2.f::HUGEINT * r2.f), 2, l2.f, r2.f)) AS cut
            FROM f3 p
            JOIN f1 l1 ON l1.lang = p.lang AND l1.w1 = p.w1 JOIN f2 r1 ON r1.lang = p.lang AND r1.w1 = p.w2 AND r1.w2 = p.w3
            JOIN f2 l2 ON l2.lang = p.lang AND l2.w1 = p.w1 AND l2.w2 = p.w2 JOIN f1 r2 ON r2.lang = p.lang AND r2.w1 = p.w3
        ),
        every AS (
            SELECT lang, phrase, a, cut[3] AS l, cut[4] AS r, cut[1]::BIGINT AS score,
                row_number() OVER (PARTITION BY lang ORDER BY cut[1] DESC, a DESC, phrase) AS rank
            FROM (SELECT * FROM two UNION ALL SELECT * FROM three)
        ),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang)
        SELECT lang, rank, phrase, a, l, r, n, score FROM every JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op12_merkle": f"""
        WITH RECURSIVE field AS (
            SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree,
                {_field("doc_id")} || {_field("source")} || {_field("lang")} AS head, n_chars, {_field("text")} AS tail
            FROM documents
        ),
        hashed AS (
            SELECT doc_id, tree, sha256(head || {_field("n_chars")} || tail) AS leaf,
                sha256(head || {_field("(n_chars + CASE WHEN " + CRC32.format("doc_id") + " % 7 = 0 THEN 1 ELSE 0 END)")} || tail) AS given
            FROM field
        ),
        leaf AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
                row_number() OVER () AS row_id
            FROM hashed
        ),
        node AS (
            SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaf
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM node
            WHERE n > 1 GROUP BY tree, level, pos // 2, n
        ),
        subroot AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
        top AS (
            SELECT 0 AS level, pos, subroot AS h, n FROM subroot
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n
        ),
        fold AS (
            SELECT row_id, tree, 0 AS level, pos, n, given AS h, '' AS proof FROM leaf
            UNION ALL
            SELECT f.row_id, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2, {_folded()}, f.proof || coalesce(s.h, '')
            FROM fold f LEFT JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
        ),
        whole AS (
            SELECT f.row_id, 0 AS level, s.pos, s.n, f.h, f.proof FROM fold f JOIN subroot s USING (tree) WHERE f.n = 1
            UNION ALL
            SELECT f.row_id, f.level + 1, f.pos // 2, (f.n + 1) // 2, {_folded()}, f.proof || coalesce(s.h, '')
            FROM whole f LEFT JOIN top s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
        )
        SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
        FROM leaf l JOIN subroot s USING (tree) JOIN whole o ON o.row_id = l.row_id AND o.n = 1 JOIN top t ON t.n = 1
    """,
}
