"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontam, minhash, mixing, ngram, passages, phrases, quality, runs, sharding, tokenfile, topk, urlrules, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.archive_pages(_table(spark, sf_dir, "pages")), payloads=False)
    # a gap in archives just written is an error, not a shorter result
    sound = F.when(F.col("kind") == "gap", F.raise_error(F.concat_ws(" ", "archive", "start", "reason")).cast("boolean")).otherwise(F.lit(True))
    return read.filter(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


HOST_RULES = (
    urlrules.host_rule("allow", "com/"),
    urlrules.host_rule("block", "example.com/en/"),
    urlrules.host_rule("allow", "www.example.com/en/"),
    urlrules.host_rule("block", "net/es/"),
    urlrules.host_rule("block", "net/fr/"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.filter_urls(_table(spark, sf_dir, "pages"), HOST_RULES + urlrules.DEFAULT_PATTERNS)
    rule = F.when(F.col("rule_kind") == "host", F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


def op6_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.MinHash(words=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.language_model_scores(_table(spark, sf_dir, "documents"))


def op10_bm25_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a tail that repeats in every document whose crc32 of the id ends in 0.

    There the words from number a on are the p words from a over and over; a null id's document stays as it is.
    """
    mark = F.expr("crc32(cast(doc_id as string))")
    words = F.expr(r"filter(split(text, '[ \\t-\\r]+'), x -> x <> '')")
    marked = docs.select("doc_id", "text", mark.alias("h"), F.when((mark % 10 == 0), words).alias("w"))
    marked = marked.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    marked = marked.withColumn("a", F.expr("if(n > 0, g % n, null)"))
    marked = marked.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return marked.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(repeat_tails(_table(spark, sf_dir, "documents")))
    # runs come by start and period, so the first of equals is the wanted one
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = tokenfile.token_index(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mix_sources, op2_quality_bradley_terry, op3_pivot_top_k, op4_warc_salvage, op5_url_filter, op6_chained_passages, op7_shard_bytes, op8_minhash_near_dedup, op9_kneser_ney, op10_bm25_decontaminate, op11_tandem_runs, op12_phrase_collocations, op13_token_bits)}


_URL = "coalesce(url, '')"
_HOST = f"translate(regexp_extract({_URL}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = f"regexp_extract({_URL}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_BLOCKED = " OR ".join(
    "regexp_matches(lower(coalesce(url, '')), '{}')".format(r.pattern.replace("'", "''")) for r in urlrules.DEFAULT_PATTERNS
)


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_PARTS = "string_split(phrase, ' ')"


def _score(l: str, r: str) -> str:
    return f"(1000000::HUGEINT * a * a // ({l}::HUGEINT * {r}))::BIGINT"


SQL: dict[str, str] = {
    "op12_phrase_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) t(k)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, {_PARTS} AS w FROM f WHERE k > 1 AND f >= 10),
        x AS (SELECT c.*, cut, array_to_string(w[:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM c, range(1, 3) t(cut) WHERE cut < k),
        s AS (SELECT x.lang, x.k, x.phrase, a, fl.f AS l, fr.f AS r, cut, {_score('fl.f', 'fr.f')} AS score
              FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = lp JOIN f fr ON fr.lang = x.lang AND fr.phrase = rp),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, inner_phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM c WHERE k = 3) GROUP BY ALL),
        o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
              FROM b LEFT JOIN i ON i.lang = b.lang AND i.inner_phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
    "op3_pivot_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
              FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_warc_salvage": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON f.d = p.d""",
    "op8_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS r FROM documents UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op5_url_filter": f"""
        WITH p AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
        r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r.name)} THEN '{r.name}'" for r in sorted(HOST_RULES, key=lambda r: -len(r.name)))} END AS rule FROM p)
        SELECT page_id, host, path, rule,
               CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)}
                    WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
