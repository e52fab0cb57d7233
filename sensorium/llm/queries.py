"""The registered corpus queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorium.llm import fmindex, licences, minmax, partitions, phrases, pieces, rendezvous, scoring, sentences, tagpaths, urls, warc, whitening
from sensorium.llm.base import table
from sensorium.session import shared_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op1_min_max_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents that share 0.8 of their 4-word shingles."""
    return minmax.near_groups(table(spark, folder, "documents"), words=4, share=80)


@query("op3_rendezvous_shards")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    """40 equal shards, and the choice with one more."""
    even = dict.fromkeys(range(40), 1.0)
    return rendezvous.shard(table(spark, folder, "documents"), even, even | {40: 1.0})


@query("op6_warc_boundary_chains")
def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), path)
    records = warc.read_archives(spark, path, payloads=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


URL_RULES = (
    urls.prefix_rule("allow", "org", "/"),
    urls.prefix_rule("block", "example.org", "/es/"),
    urls.prefix_rule("block", "example.org", "/en/1"),
    urls.prefix_rule("allow", "com", "/fr/"),
    urls.prefix_rule("block", "com", "/de/"),
)

_URL_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, arg_max(struct_pack(name := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS b
  FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
)
SELECT h.page_id, h.host, h.path, b.name AS rule,
  CASE WHEN b IS NOT NULL THEN b.verdict
    WHEN regexp_matches(host, '(^|[^0-9a-z])(casino|poker|pills|viagra|spam|free[^0-9a-z]bets|porn|xxx|ads|adserver)($|[^0-9a-z])') THEN 'block'
    ELSE 'allow' END AS verdict
FROM h LEFT JOIN best USING (page_id)
"""


@query("op8_url_rules", _URL_SQL)
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The contract's rules, then the default rules, on every page."""
    return urls.judge(table(spark, folder, "pages"), URL_RULES + urls.DEFAULT_RULES)


@query("op9_fm_index_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words found in all documents."""
    docs = fmindex.with_contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    found = F.col("found")
    return docs.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        fmindex.contaminated(found).alias("contaminated"),
    )


@query("op10_sentence_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Documents scored by a model of the labels outside the held-out fifth."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = sentences.train(docs, labels.filter(fold("doc_id") != 0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return sentences.with_score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), score.alias("score"), (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op2_tag_path_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return tagpaths.with_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Where the public model lies; a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op4_sentencepiece_codec")
def codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, their text again, and whether it is the document's."""
    docs = pieces.with_pieces(table(spark, folder, "documents").select("doc_id", "text"), PIECE_MODEL)
    text = pieces.decoded(docs, PIECE_MODEL)
    return docs.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", F.coalesce(F.translate("text", pieces.MARK, " ") == text, F.lit(True)).alias("round_trip"))


@query("op7_learned_partitions")
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return partitions.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


_LICENCE_SQL = """
WITH templates(licence, header) AS (VALUES %s),
files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder,
    list_distinct(list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x : regexp_matches(x, 'licen[sc]e|copyright|spdx'))) AS headers,
    length(coalesce(text, '')) <= 400 AS short
  FROM documents
), paths AS (
  SELECT *, folder || '/' || CASE WHEN short AND len(headers) > 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path FROM files
), held AS (SELECT doc_id, path, folder, unnest(headers) AS header FROM paths),
every AS (
  SELECT DISTINCT header, NULL AS licence FROM held
  UNION ALL SELECT translate(header, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), licence FROM templates
), terms AS (
  SELECT header, licence, token, count(*) AS tf FROM (SELECT header, licence, unnest(regexp_extract_all(header, '[a-z0-9]+')) AS token FROM every) GROUP BY ALL
), idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM every)) / (1.0 + count(*))) + 1.0 AS idf FROM terms GROUP BY token),
weighed AS (SELECT header, licence, token, tf * idf AS w FROM terms JOIN idf USING (token)),
ours AS (SELECT header, sqrt(sum(w * w)) AS n FROM weighed WHERE licence IS NULL GROUP BY header),
theirs AS (SELECT licence, sqrt(sum(w * w)) AS n FROM weighed WHERE licence IS NOT NULL GROUP BY licence),
dots AS (
  SELECT a.header, b.licence, sum(a.w * b.w) AS dot FROM weighed a JOIN weighed b ON a.token = b.token AND a.licence IS NULL AND b.licence IS NOT NULL GROUP BY ALL
), near AS (
  SELECT header, licence, round(dot / (ours.n * theirs.n), 9) AS score FROM dots JOIN ours USING (header) JOIN theirs USING (licence)
), best AS (
  SELECT header, licence, score FROM near WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY header ORDER BY score DESC, licence) = 1
), own AS (
  SELECT doc_id, path, folder, licence, score FROM held JOIN best USING (header)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1
), given AS (
  SELECT folder, licence, score FROM own WHERE path LIKE '%%/LICENSE-%%' QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, path) = 1
)
SELECT p.doc_id, p.path, coalesce(o.licence, g.licence) AS licence, round(coalesce(o.score, g.score), 6) AS score,
  CASE WHEN o.licence IS NOT NULL THEN 'header' WHEN g.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM paths p LEFT JOIN own o USING (doc_id) LEFT JOIN given g ON p.folder = g.folder
""" % ", ".join(f"('{k}', '{v}')" for k, v in sorted(licences.TEMPLATES.items()))


@query("op5_licence_scan", _LICENCE_SQL)
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of the folders source/lang; short texts with a header are their folder's licence files."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    short = (F.length(F.coalesce("text", F.lit(""))) <= 400) & (F.size(licences.headers_of(F.col("text"))) > 0)
    name = F.when(short, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    found = licences.scan(docs.withColumn("path", path), id_column="doc_id")
    return found.select(F.col("id").alias("doc_id"), "path", "licence", F.round("score", 6).alias("score"), "origin")


@query("op11_attention_scores")
def language_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log10 probability, learnt from the documents outside one fifth."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scoring.score(table(spark, folder, "documents"), PIECE_MODEL, held)


@query("op12_qd_whitening")
def whitening_directions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the eight leading components, scaled to unit variance."""
    return whitening.whiten(table(spark, folder, "embeddings"))


_PHRASE_SQL = """
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), lists AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i : array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size
), f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, k, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, unnest(list_transform(range(1, size - part + 2), lambda i : array_to_string(w[i:i + part - 1], ' '))) AS phrase, a AS longer
  FROM cand, (VALUES (2), (3)) p(part) WHERE part < size
), dropped AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE 100 * i.longer >= 80 * b.a),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b ANTI JOIN dropped d ON d.lang = b.lang AND d.phrase = b.phrase
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_filters", _PHRASE_SQL)
def phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return phrases.mine(table(spark, folder, "documents"))
