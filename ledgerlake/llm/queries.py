"""One registered query per operator: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import table
from ledgerlake.llm.oracles import CONVERSATION_REPAIR, NS_BOUNDS
from ledgerlake.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_token_files(spark, sf_dir):
    from ledgerlake.llm.token_files import encode_documents, read_documents

    return read_documents(*encode_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op3_robust_outliers(spark, sf_dir):
    from ledgerlake.llm.outliers import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@query
def op5_pivotal_mix(spark, sf_dir):
    from ledgerlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_decontaminate(spark, sf_dir):
    from ledgerlake.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_jaccard_join(spark, sf_dir):
    from ledgerlake.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op7_substring_dedup(spark, sf_dir):
    from ledgerlake.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query
def op2_toxicity(spark, sf_dir):
    from ledgerlake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_license_scan(spark, sf_dir):
    from ledgerlake.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("covers")


@query
def op4_url_templates(spark, sf_dir):
    from ledgerlake.llm.url_templates import judge

    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


@query
def op8_html_extract(spark, sf_dir):
    from ledgerlake.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_conversation_repair(spark, sf_dir):
    from ledgerlake.llm.conversations import repair_digests

    return repair_digests(table(spark, sf_dir, "conversations"))


@query
def op12_simhash_balls(spark, sf_dir):
    from ledgerlake.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_ns_bounds(spark, sf_dir):
    from ledgerlake.llm.kmeans import clustered

    return clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ALNUM} AS w FROM benchmark),
span AS (SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
gram AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM span)),
place AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (
    SELECT d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM gram) s)),
hit AS (SELECT p.doc_id, g.item_id, p.i, p.n FROM place p JOIN gram g ON g.n = p.n AND g.g = p.g),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, w.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN word w ON w.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""

ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM place) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.k) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k
    GROUP BY word.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE["op11_conversation_repair"] = CONVERSATION_REPAIR
ORACLE["op13_ns_bounds"] = NS_BOUNDS
