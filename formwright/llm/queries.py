"""The queries of this subpackage, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.llm.common import read
from formwright.session import shipped

#: Where the public vocabulary files are; a parameter of the operators.
TOKENIZERS = "/opt/tokenizers"


def tokenizer(name: str) -> str:
    import importlib.util

    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{TOKENIZERS}/{name}"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(shipped(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op1_simhash_golay")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.simhash import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Windows as strings, the smallest document of each, and the words that windows of smaller documents cover.
_OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS v FROM s),
m AS (SELECT v, min(doc_id) AS least FROM x GROUP BY v),
g AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 50)) AS p FROM x JOIN m ON x.v = m.v WHERE m.least < x.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
         FROM words LEFT JOIN g ON g.doc_id = words.doc_id AND g.p = words.p WHERE g.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@query("op2_substring_debruijn", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.substring import word_spans

    return word_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: 50-byte windows of the hexadecimal text, cut from stretches of a thousand so that no cut has far to go; told apart by MD5.
_OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
c AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 2098) AS part FROM (SELECT doc_id, h, n, unnest(range(0, greatest(n - 49, 0), 1000)) AS p FROM d)),
w AS (SELECT doc_id, p + k AS i, md5_number(substr(part, 2 * k + 1, 100)) AS v FROM (SELECT doc_id, p, part, unnest(range(0, least(1000, n - 49 - p))) AS k FROM c)),
m AS (SELECT v, min(doc_id) AS least FROM w GROUP BY v),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.v = m.v WHERE m.least < w.doc_id),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM s),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM runs),
per AS (SELECT cut.doc_id, sum(b - a)::BIGINT AS gone, count(*)::BIGINT AS spans, string_agg(substr(d.h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS kept
        FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY cut.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(kept, d.h))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""


@query("op5_substring_bytes", _OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.suffix import byte_spans

    return byte_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_quality_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.common import crc_mod
    from formwright.llm.quality_model import scored, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    return scored(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


_OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
v AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v FROM v),
c AS (SELECT doc_id, v FROM x GROUP BY doc_id, v HAVING count(*) >= 2),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT x.doc_id, unnest(range(x.i, x.i + 5)) AS p FROM x JOIN c ON x.doc_id = c.doc_id AND x.v = c.v) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: list_contains([{stop}], x))) AS n_stop
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 1 AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.15
       AND (n_words < 30 OR n_stop / n_words >= 0.05) AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""


def _stop_list() -> str:
    from formwright.llm.quality_rules import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("op4_quality_rules", _OP4.replace("{stop}", _stop_list()))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.quality_rules import judged

    return judged(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_sharding_ring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.sharding import shard

    return shard(read(spark, sf_dir, "documents"))


@query("op7_packing_sum_of_squares")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.packing import packed, pieces

    return packed(pieces(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


@query("op9_langid_unigram")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.common import crc_mod
    from formwright.llm.langid import predicted, train

    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 5) != 0), vocabulary_path=tokenizer("piece_bpe_32k.model"))
    return predicted(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op8_ann_srs")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.ann import nearest

    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formwright.llm.pieces import digest

    return digest(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
