"""Queries of the training-data operators, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, fingerprint, htmltext, linededup, lmscore, neardup, packing, pii, quality, urlfilter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host labels of the groups in `pages` that block lists usually have.
GROUPS = "adult|casino|free-bets|cheap-pills|ads-track|spam"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, marked if their canonical URL is listed. The list: the URLs on hosts that are named after one of GROUPS."""
    pages = _t(spark, sf_dir, "pages")
    listed = pages.where(F.lower("url").rlike(f"^[a-z]+://([^/]*[.])?({GROUPS})[^/]*")).select("url")
    return urlfilter.filter_urls(pages.select("page_id", "url"), listed)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = _t(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _t(spark, sf_dir, "labels")))
    return scored.where(scored["score"] >= quality.KEEP).select("doc_id", "score")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's signatures and root."""
    return fingerprint.fingerprints(_t(spark, sf_dir, "documents"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that nearly equals one of a lesser id, with the document of its group that stays."""
    return neardup.near_duplicates(_t(spark, sf_dir, "documents"))


#: The vocabulary file of the packing queries; a session may name another in the setting `inkwell.vocabulary`.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def vocabulary(spark: SparkSession) -> str:
    return spark.conf.get("inkwell.vocabulary", VOCABULARY)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows, with the boundaries of the documents in them."""
    return packing.pack_documents(_t(spark, sf_dir, "documents"), vocabulary=vocabulary(spark))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    return htmltext.extract_pages(_t(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the model of all documents."""
    return lmscore.score_documents(_t(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data or secrets."""
    return pii.find_pii(_t(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The removal spans of all documents."""
    return decontaminate.find_spans(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that are left, without repeated lines."""
    return linededup.dedup_lines(_t(spark, sf_dir, "documents"), count_as="n_removed").select("doc_id", "text", "n_removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_quality_classifier, op3_fingerprints, op4_minhash_neardup, op5_packing, op6_html_extraction, op7_lm_scoring, op8_pii, op9_decontamination, op10_line_dedup)}


WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"
GAP = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"


def _canonical(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '^(www\\.|m\\.)+', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    args = f"list_sort([p for p in string_split(regexp_extract({bare}, '^[^?]*\\?(.*)$', 1), '&') if p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)')])"
    return f"CASE WHEN length(trim({url})) > 0 THEN {host} || {path} || CASE WHEN len({args}) > 0 THEN '?' || array_to_string({args}, '&') ELSE '' END END"


def _lm_sql() -> str:
    """Counts, interpolated probabilities and backoff over hexadecimal bytes."""
    n, d = lmscore.ORDER, lmscore.DISCOUNT
    parts = [
        f"x AS (SELECT doc_id, repeat('FF', {n - 1}) || hex(encode(coalesce(text, ''))) || 'FE' AS h FROM documents)",
        f"g AS (SELECT doc_id, substring(h, 2 * i + 1, {2 * n}) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {n - 1})) AS i FROM x))",
        "per AS (SELECT doc_id, k, count(*) AS m FROM g GROUP BY doc_id, k)",
        "c AS (SELECT k, sum(m)::BIGINT AS c FROM per GROUP BY k)",
    ]
    for k in range(1, n + 1):
        cut = lmscore.CUTOFFS[k - 1]
        parts += [
            f"c{k} AS (SELECT right(k, {2 * k}) AS k, sum(c)::BIGINT AS c FROM c GROUP BY 1)",
            f"h{k} AS (SELECT left(k, {2 * k - 2}) AS ctx, sum(c)::BIGINT AS ch, 1.0::DOUBLE - coalesce(sum((c - {d})::DOUBLE) FILTER (c >= {cut}), 0) / sum(c) AS g FROM c{k} GROUP BY 1 HAVING max(c) >= {cut})",
            f"p{k} AS (SELECT a.k, (c - {d})::DOUBLE / ch + g " + (f"* q.p AS p FROM c{k} a JOIN h{k} ON left(a.k, {2 * k - 2}) = ctx JOIN p{k - 1} q ON q.k = right(a.k, {2 * k - 2})" if k > 1 else f"/ 256.0::DOUBLE AS p FROM c{k} a JOIN h{k} ON ctx = ''") + f" WHERE c >= {cut})",
        ]
    score = "-ln(256.0::DOUBLE) + coalesce(ln(h1.g), 0)"
    for k in range(1, n + 1):
        lower = f"coalesce(ln(h{k}.g), 0) + {score}" if k > 1 else score
        score = f"CASE WHEN p{k}.p IS NOT NULL THEN ln(p{k}.p) ELSE {lower} END"
    joins = " ".join(f"LEFT JOIN p{k} ON p{k}.k = right(c.k, {2 * k}) LEFT JOIN h{k} ON h{k}.ctx = left(right(c.k, {2 * k}), {2 * k - 2})" for k in range(1, n + 1))
    return f"""WITH {", ".join(parts)}, s AS (SELECT c.k, {score} AS lp FROM c {joins}),
t AS (SELECT doc_id, sum(m)::BIGINT AS n_symbols, sum(m * lp) AS logprob FROM per JOIN s USING (k) GROUP BY doc_id)
SELECT doc_id, n_symbols, round(logprob, 4)::DOUBLE AS logprob, round(-logprob / ln(2.0::DOUBLE) / n_symbols, 6)::DOUBLE AS bits_per_symbol FROM t"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": f"""
WITH c AS (SELECT page_id, url, {_canonical("url")} AS canonical FROM pages),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(lower(url), '^[a-z]+://([^/]*[.])?({GROUPS})[^/]*'))
SELECT page_id, url, canonical, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l) AS listed FROM c""",
        "op7_lm_scoring": _lm_sql(),
        "op4_minhash_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {neardup.WIDTH - 1}], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {neardup.WIDTH - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= {neardup.THRESHOLD}),
e AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT id AS doc_id, min(root) AS kept_doc_id FROM r GROUP BY id HAVING min(root) <> id""",
        "op9_decontamination": f"""
WITH bw AS (SELECT regexp_extract_all(lower(text), '{WORD}') AS ws FROM benchmark),
ph AS (SELECT DISTINCT least(len(ws), {decontaminate.N_WORDS}) AS m, array_to_string(ws[i:i + {decontaminate.N_WORDS - 1}], ' ') AS p
       FROM (SELECT ws, unnest(range(1, greatest(len(ws) - {decontaminate.N_WORDS - 1}, 1) + 1)) AS i FROM bw WHERE len(ws) > 0)),
tok AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k
        FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}|{GAP}') AS toks FROM documents)),
tk AS (SELECT doc_id, k, tok, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY k) AS ce FROM tok),
words AS (SELECT doc_id, lower(tok) AS word, ce - length(tok) AS cs, ce, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM tk WHERE regexp_matches(tok, '^{WORD}$')),
dw AS (SELECT doc_id, list(word ORDER BY i) AS ws, list(cs ORDER BY i) AS cs, list(ce ORDER BY i) AS ce FROM words GROUP BY doc_id),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS p, cs[i] AS cs, ce[i + m - 1] AS ce
      FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM ph) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, i - 1 AS s, i - 1 + m AS e, cs, ce FROM g JOIN ph USING (m, p)),
isl AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new FROM hit),
grp AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS j FROM isl)
SELECT doc_id, min(s)::BIGINT AS start_word, max(e)::BIGINT AS end_word, min(cs)::BIGINT AS char_start, max(ce)::BIGINT AS char_end, count(*)::BIGINT AS n_phrases
FROM grp GROUP BY doc_id, j""",
        "op10_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
r AS (SELECT *, length(trim(line)) >= {linededup.MIN_CHARS} AND row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, no) > 1 AS gone FROM l),
d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS text, count(*) FILTER (gone)::BIGINT AS n_removed FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN n_removed = 0 THEN documents.text ELSE d.text END AS text, n_removed
FROM documents JOIN d USING (doc_id) WHERE n_removed = 0 OR regexp_matches(d.text, '{WORD}')""",
    }
