"""Queries of the scalar functions over texts, addresses and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import numbers as N
from quern.functions import text as T
from quern.functions import urls as U
from quern.operators import citations
from quern.plans.base import Registry
from quern.session import spread_table, table

query = Registry()

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " "


def sql_fold(x: str) -> str:
    return f"translate({x}, '{_WIDE}', '{_NARROW}')"


def sql_bigrams(w: str) -> str:
    return f"CASE WHEN length({w}) < 2 THEN [{w}] ELSE list_transform(range(1, length({w})), lambda i: {w}[i:i+1]) END"


def sql_tokens(x: str) -> str:
    words = f"regexp_extract_all(lower({sql_fold(f'coalesce({x}, chr(32))')}), '\\p{{Han}}+|[a-z]+(?:[.-][a-z]+)*|[0-9]+(?:[.,][0-9]+)*%?')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^\\p{{Han}}') THEN {sql_bigrams('w')} ELSE [w] END))"


def sql_norm(x: str, digits: bool = False) -> str:
    kept = f"lower(regexp_replace({x}, '[^㐀-鿿A-Za-z0-9]', '', 'g'))"
    return f"regexp_replace({kept}, '[0-9]+', '0', 'g')" if digits else kept


def sql_shingles(x: str) -> str:
    cs = f"[string_split({sql_norm(x, True)}, '')]"
    return f"list_transform({cs}, lambda cs: list_distinct(list_transform(range(1, len(cs) - 3, 2), lambda i: cs[i] || cs[i + 1] || cs[i + 2] || cs[i + 3] || cs[i + 4])))[1]"


def sql_near(a: str, b: str) -> str:
    """Whether two rows with n (normal form) and s (its shingles) are near-duplicates."""
    low, high = f"least(length({a}.n), length({b}.n))", f"greatest(length({a}.n), length({b}.n))"
    common = f"len(list_intersect({a}.s, {b}.s))"
    return (
        f"({a}.n <> '' AND {b}.n <> '' AND ({a}.n = {b}.n OR ({low} >= 100 AND 10 * {low} >= 6 * {high} AND (contains({a}.n, {b}.n) OR contains({b}.n, {a}.n)))"
        f" OR ({low} >= 120 AND 10 * {low} >= 7 * {high} AND len({a}.s) > 0 AND len({b}.s) > 0 AND 100 * {common} >= 88 * (len({a}.s) + len({b}.s) - {common}))))"
    )


def sql_char_bigrams(x: str) -> str:
    return f"list_transform([string_split({sql_norm(x)}, '')], lambda cs: list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1]))[1]"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT doc_id, length({sql_norm('text')})::BIGINT AS n_kept, md5({sql_norm('text')}) AS digest, md5({sql_norm('text', True)}) AS digest_numbers FROM documents")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.normal_form(t)).cast("long").alias("n_kept"), F.md5(T.normal_form(t)).alias("digest"), F.md5(T.normal_form(t, True)).alias("digest_numbers"))


@query("""
    WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_split_to_array(text, '本院认为|本庭认为|判决如下|裁定如下')[1], '^[ \\t\\n\\x0b\\f\\r]+', ''), '[ \\t\\n\\x0b\\f\\r]+$', '') AS t FROM documents)
    SELECT doc_id, length(f)::BIGINT AS n_chars_kept, md5(f) AS digest FROM (SELECT doc_id, CASE WHEN length(t) > 7500 THEN left(t, 2500) || right(t, 5000) ELSE t END AS f FROM b)
""")
def feature_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").select("doc_id", T.features(F.col("text")).alias("f"))
    return f.select("doc_id", F.length("f").cast("long").alias("n_chars_kept"), F.md5("f").alias("digest"))


@query(f"SELECT doc_id, len(s)::BIGINT AS n_shingles, md5(array_to_string(list_sort(s), ' ')) AS digest FROM (SELECT doc_id, {sql_shingles('text')} AS s FROM documents WHERE text IS NOT NULL)")
def shingle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), " ")).alias("digest"))


@query(f"""
    SELECT b AS bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(t)), lambda i: t[i:i+1])) AS b FROM (SELECT {sql_norm('text')} AS t FROM eval_items)) GROUP BY b
""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select(F.explode(T.char_bigrams(F.col("text"))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH q AS (SELECT item_id, lower(text) AS q FROM eval_items),
         r AS (SELECT item_id, regexp_extract_all(q, '[a-z][a-z0-9.%-]*|[0-9]+(?:\\.[0-9]+)?%?') AS latin, regexp_extract_all(q, '[㐀-鿿]+') AS runs FROM q),
         t AS (SELECT item_id, unnest(latin || flatten(list_transform(runs, lambda w: {sql_bigrams('w')})) || list_filter(runs, lambda w: length(w) <= 4)) AS t FROM r)
    SELECT item_id, count(DISTINCT t) AS n_terms, md5(string_agg(DISTINCT t, ' ' ORDER BY t)) AS digest FROM t
    WHERE length(t) > 1 AND t NOT IN {T.QUESTION_STOPS} GROUP BY item_id
""")
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "eval_items").select("item_id", T.query_terms(F.col("text")).alias("t"))
    return t.where("size(t) > 0").select("item_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("""
    SELECT DISTINCT page_id, md5(regexp_replace(regexp_replace(coalesce(company, '') || ' ' || coalesce(report_year::VARCHAR, '') || '年 ' || coalesce(section, '') || chr(10) || coalesce(text, ''), '^[ \\n]+', ''), '[ \\n]+$', '')) AS digest FROM report_pages
""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.embedding_text(F.col("company"), F.col("report_year"), F.col("section"), F.col("text"))
    return table(spark, sf_dir, "report_pages").select("page_id", F.md5(text).alias("digest")).distinct()


@query("""
    SELECT doc_id, count(*) AS n_amounts, sum((replace(m[1], ',', '')::DECIMAL(24,4) * CASE m[2] WHEN '千元' THEN 1000 WHEN '万元' THEN 10000 WHEN '亿元' THEN 100000000 ELSE 1 END)::DECIMAL(38,4))::DOUBLE AS total_yuan
    FROM (SELECT doc_id, list_zip(regexp_extract_all(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*([亿万千]?元)', 1), regexp_extract_all(text, '([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*([亿万千]?元)', 2)) AS l FROM documents), unnest(l) AS u(m)
    GROUP BY doc_id
""")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pairs = d.select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(N.AMOUNT), F.lit(1)).alias("figure"), F.regexp_extract_all("text", F.lit(N.AMOUNT), F.lit(2)).alias("unit"))).alias("m"))
    return pairs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_amounts"), F.sum(N.amount_yuan(F.col("m.figure"), F.col("m.unit"))).cast("double").alias("total_yuan"))


@query("""
    SELECT title || '第' || article || '条' AS law, count(*) AS n_citations, count(DISTINCT doc_id) AS n_docs
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '《([^《》\\n]+)》第([零〇一二两三四五六七八九十百千万]+)条', 1)) AS title, unnest(regexp_extract_all(text, '《([^《》\\n]+)》第([零〇一二两三四五六七八九十百千万]+)条', 2)) AS article FROM documents)
    GROUP BY ALL
""")
def law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir).groupBy(F.concat("title", F.lit("第"), "article", F.lit("条")).alias("law")).agg(F.count(F.lit(1)).alias("n_citations"), F.countDistinct("doc_id").alias("n_docs"))


#: Fixed value: a title with one article behind it.
CITATION = r"《([^《》\n]+)》第([零〇一二两三四五六七八九十百千万]+)条"


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit(CITATION)
    found = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("title"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("article"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.title", "m.article")


@query()
def cited_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles cited by lists behind titles, which may hold titles themselves; balanced marks are beyond regular SQL."""
    return citations.cited_articles(spread_table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def law_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article numbers of cited laws as figures; a fold over the numeral, tested against a table of numerals."""
    return _citations(spark, sf_dir).groupBy("title", N.chinese_number(F.col("article")).alias("article_no")).agg(F.count(F.lit(1)).alias("n_citations"))





@query("SELECT l_returnflag, l_linestatus, rtrim(rtrim(format('{:,.2f}', sum(l_quantity)), '0'), '.') AS quantity_text FROM lineitem GROUP BY ALL")
def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(N.format_amount(F.sum("l_quantity")).alias("quantity_text"))


def _sql_url(kind: str) -> str:
    bare = "regexp_replace(url, '^\\s+|\\s+$', '', 'g')"
    pattern = "'(?is)^(https)://([^/?#\\s]+)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$'"
    host, path, rest = (f"regexp_extract({bare}, {pattern}, {i})" for i in (2, 3, 4))
    valid = f"regexp_matches({bare}, {pattern}) AND NOT contains({host}, '@')"
    drops = {"feed": U.FEED_DROPS, "key": U.KEY_DROPS, "ledger": U.LEDGER_DROPS}[kind]
    kept = f"list_filter(string_split({rest}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|{'|'.join(drops)})(=.*)?$'))"
    q = f"array_to_string({kept if kind == 'feed' else f'list_sort({kept})'}, '&')"
    host = f"lower({host})"
    if kind == "feed":
        path = f"CASE WHEN {path} = '' THEN '/' ELSE {path} END"
    else:
        host, path = f"regexp_replace({host}, ':443$', '')", f"regexp_replace({path}, '/+$', '')"
    if kind == "ledger":
        host = f"regexp_replace({host}, '^www\\.', '')"
        valid += f" AND NOT contains({host}, ':')"
    return f"CASE WHEN {valid} THEN 'https://' || {host} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


@query(f"SELECT entry_id, {_sql_url('feed')} AS feed_url, {_sql_url('key')} AS key_url, {_sql_url('ledger')} AS ledger_url FROM feed_entries")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "feed_entries").select("entry_id", U.feed_url(u).alias("feed_url"), U.key_url(u).alias("key_url"), U.ledger_url(u).alias("ledger_url"))


_SQL_TITLE = f"regexp_replace(lower({sql_fold('title')}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query()
def item_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = F.concat(F.lit("["), F.array_join(F.array_sort(U.fingerprints(F.col("url"), F.col("title"))), ", "), F.lit("]"))
    return table(spark, sf_dir, "feed_entries").select("entry_id", prints.alias("prints"))


query.sql["item_fingerprints"] = f"SELECT entry_id, '[' || array_to_string(list_sort(list_distinct(list_filter([sha256('url:' || ({_sql_url('ledger')})), sha256('title:' || {_SQL_TITLE})], lambda x: x IS NOT NULL))), ', ') || ']' AS prints FROM feed_entries"


@query("""
    SELECT DISTINCT page_id, CASE WHEN regexp_matches(regexp_replace(trim(source_url), '#.*$', ''), '(?i)^https?://[^/?#\\s@]+([/?]\\S*)?$') THEN CASE WHEN pdf_page > 0 THEN regexp_replace(trim(source_url), '#.*$', '') || '#page=' || pdf_page::VARCHAR ELSE trim(source_url) END END AS href FROM report_pages
""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_pages").select("page_id", U.citation_href(F.col("source_url"), F.col("pdf_page")).alias("href")).distinct()


@query("""
    SELECT count(*) AS n_cells, count(DISTINCT c) AS n_raw, count(DISTINCT trim(regexp_replace(c, '[ \\t]+', ' ', 'g'))) AS n_clean, count(DISTINCT regexp_replace(c, '\\s+', '', 'g')) AS n_compact
    FROM (SELECT unnest(flatten(table_rows)) AS c FROM report_tables) WHERE c IS NOT NULL
""")
def cell_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "report_tables").select(F.explode(F.flatten("table_rows")).alias("c")).where("c is not null")
    return c.agg(F.count("c").alias("n_cells"), F.countDistinct("c").alias("n_raw"), F.countDistinct(T.clean_cell(F.col("c"))).alias("n_clean"), F.countDistinct(T.compact(F.col("c"))).alias("n_compact"))


@query("""
    SELECT code, report_year, title, NOT regexp_matches(t, '(?i)摘要|英文|业绩快报|业绩预告|提示性|审计报告|股东|董事|可持续|ESG|English|summary') AND regexp_matches(t, '(^|[^0-9])' || report_year::VARCHAR || '年?年度报告(全文)?([（(][^（）()]*[）)])?$') AS full_report
    FROM (SELECT *, regexp_replace(title, '\\s+', '', 'g') AS t FROM report_manifest)
""")
def full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "report_manifest")
    return m.select("code", "report_year", "title", T.is_full_report(T.clean_title(F.col("title")), F.col("report_year")).alias("full_report"))


@query(f"""
    SELECT source, count(*) AS n_docs, count(*) FILTER (regexp_matches(lower(text), '{T.PRIVATE}')) AS n_private FROM documents WHERE text IS NOT NULL GROUP BY source
""")
def private_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(T.is_private(F.col("text"))).alias("n_private"))


@query(f"""
    SELECT entry_id, CASE WHEN regexp_matches(lower(t), '{T.PRIVATE}') THEN '[redacted]' ELSE t END AS summary FROM (SELECT entry_id, left(regexp_replace(summary, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), 2000) AS t FROM feed_entries)
""")
def redacted_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_entries").select("entry_id", T.redacted(F.col("summary")).alias("summary"))


def _sql_count(term: str) -> str:
    if term.isascii():
        return f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-z0-9]', '  ', 'g') || ' ', ' {term} '))"
    return f"((length(lower(text)) - length(replace(lower(text), '{term}', ''))) / {len(term)})"


@query("SELECT doc_id, (" + " + ".join(f"least(3, {_sql_count(t)}) * {w}" for t, w in T.TOPICS.items()) + ")::BIGINT AS score FROM documents WHERE text IS NOT NULL")
def topic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.topic_score(F.col("text")).cast("long").alias("score"))


@query("SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(summary, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM feed_entries")
def summary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_entries").select("entry_id", T.html_text_simple(F.col("summary")).alias("plain"))


@query()
def summary_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full HTML reader with its limit of 600 characters, by Arrow batches."""
    return table(spark, sf_dir, "feed_entries").select("entry_id", T.html_text()(F.col("summary")).alias("plain"))


@query("""
    SELECT DISTINCT page_id, array_to_string(list_transform(l[greatest(len(l) - 1, 1):len(l)], lambda x: trim(x)), '；') AS unit_context
    FROM (SELECT page_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(单位|人民币|币种).{0,20}(千元|百万元|亿元|元|%)')) AS l FROM report_pages WHERE text IS NOT NULL)
""")
def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("(单位|人民币|币种).{0,20}(千元|百万元|亿元|元|%)"))
    p = table(spark, sf_dir, "report_pages").where("text is not null").select("page_id", lines.alias("l"))
    last = F.slice("l", F.greatest(F.size("l") - 1, F.lit(1)), F.lit(2))
    return p.select("page_id", F.array_join(F.transform(last, F.trim), "；").alias("unit_context")).distinct()


@query("SELECT code, report_year, count(DISTINCT page_id) AS n_low, string_agg(DISTINCT pdf_page::VARCHAR, ',' ORDER BY pdf_page::VARCHAR) AS pages FROM report_pages WHERE length(text) < 20 GROUP BY ALL")
def low_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = table(spark, sf_dir, "report_pages").where(F.length("text") < 20)
    pages = F.array_join(F.array_sort(F.collect_set(F.col("pdf_page").cast("string"))), ",")
    return low.groupBy("code", "report_year").agg(F.countDistinct("page_id").alias("n_low"), pages.alias("pages"))


@query("SELECT item_id, regexp_matches(text, '" + T.PANORAMIC + "') AS panoramic FROM eval_items")
def panoramic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").select("item_id", T.is_panoramic(F.col("text")).alias("panoramic"))


QUERIES, SQL = query.queries, query.sql
