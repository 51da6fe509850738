"""The catalogue: each capability applied to the driver's tables, with the same query as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify, compare
from factloom.functions import jsonrepair
from factloom.functions import text as T
from factloom.operators import agreement as A
from factloom.operators import outcomes as O
from factloom.operators import reconcile as R

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _string(c):
    return F.array_join(c, ",")


_EFFECT = r"(-?[\d,]+\.?\d*)\*{0,3}\s*\((-?[\d,]+\.?\d*|--)\)"
_PARSED = f"""SELECT doc_id, lang, text,
  CASE WHEN regexp_matches(text, '{_EFFECT}') THEN TRY_CAST(replace(regexp_extract(text, '{_EFFECT}', 1), ',', '') AS DOUBLE) END AS effect_size,
  CASE WHEN regexp_matches(text, '{_EFFECT}') THEN TRY_CAST(replace(regexp_extract(text, '{_EFFECT}', 2), ',', '') AS DOUBLE) END AS standard_error,
  CASE WHEN regexp_matches(text, '[Nn]\\s*[=:]\\s*(\\d+)') THEN TRY_CAST(regexp_extract(text, '[Nn]\\s*[=:]\\s*(\\d+)', 1) AS BIGINT) END AS n_observations
FROM documents"""


def _parsed(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", "lang", "text", T.parsed_effect(x).alias("effect_size"), T.parsed_se(x).alias("standard_error"), T.parsed_observations(x).alias("n_observations"))


@query(f"SELECT lang, count(*) AS documents, count(effect_size) AS with_effect, count(standard_error) AS with_se, count(n_observations) AS with_n, round(avg(effect_size), 6) AS mean_effect FROM ({_PARSED}) GROUP BY lang")
def evidence_by_group(spark, sf):
    """Flagship: parse estimates out of all texts and count what is complete in each group."""
    return _parsed(spark, sf).groupBy("lang").agg(F.count("*").alias("documents"), F.count("effect_size").alias("with_effect"), F.count("standard_error").alias("with_se"), F.count("n_observations").alias("with_n"), F.round(F.avg("effect_size"), 6).alias("mean_effect"))


@query(f"SELECT doc_id, effect_size, standard_error, n_observations FROM ({_PARSED})")
def parse_effect_se(spark, sf):
    return _parsed(spark, sf).drop("lang", "text")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN TRY_CAST(l_quantity AS DOUBLE) ELSE l_discount END AS effect_size,
  CASE WHEN l_tax = 0 THEN l_extendedprice ELSE l_tax END AS standard_error, l_discount = 0 AS parsed_effect, l_tax = 0 AS parsed_se, (l_discount = 0 OR l_tax = 0) AS eligible FROM lineitem""")
def fill_missing_values(spark, sf):
    li = table(spark, sf, "lineitem")
    literal = F.concat(F.col("l_quantity").cast("string"), F.lit("** ("), F.format_string("%.2f", "l_extendedprice"), F.lit(")"))
    stats = li.select("l_orderkey", "l_linenumber", literal.alias("literal_text"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("effect_size"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("standard_error"), F.lit(None).cast("bigint").alias("n_observations"))
    return O.repair(stats).select("l_orderkey", "l_linenumber", "effect_size", "standard_error", F.col("_parsed_effect").alias("parsed_effect"), F.col("_parsed_se").alias("parsed_se"), F.col("_eligible").alias("eligible"))


_NAMES = ["red", "small", "widget", "ring", "blue"]


@query("""SELECT p_partkey, CASE WHEN contains(lower(c), 'promo') THEN -999.0 WHEN contains(lower(c), 'economy') THEN 0.1 WHEN n >= 2 THEN 0.9 WHEN n = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS score
FROM (SELECT p_partkey, c, (contains(lower(c), 'red')::INT + contains(lower(c), 'small')::INT + contains(lower(c), 'widget')::INT + contains(lower(c), 'ring')::INT + contains(lower(c), 'blue')::INT) AS n
      FROM (SELECT p_partkey, p_type || ' ' || p_name AS c FROM part))""")
def caption_score(spark, sf):
    caption = F.concat("p_type", F.lit(" "), "p_name")
    return table(spark, sf, "part").select("p_partkey", classify.caption_score(caption, _NAMES, ["economy"], ["promo"], compat=True).alias("score"))


@query("""SELECT page_id, CASE WHEN s >= 3 OR n >= 3 THEN 0.9 WHEN s >= 1 OR n >= 1 THEN 0.7 ELSE 0.3 END::DOUBLE AS score
FROM (SELECT page_id, contains(lower(html), '<h1')::INT + contains(lower(html), '<table')::INT + contains(lower(html), 'standard')::INT AS s, len(regexp_extract_all(lower(html), '\\(\\d+\\)')) AS n FROM pages)""")
def header_score(spark, sf):
    return table(spark, sf, "pages").select("page_id", classify.header_score(F.lower("html"), None, ["<h1", "<table", "standard"], compat=True).alias("score"))


@query("""WITH p AS (SELECT doc_id, string_split(lower(text), ' with ') AS a FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(a))) AS i, a FROM p WHERE len(a) > 1),
c AS (SELECT doc_id, right(array_to_string(a[1:i], ' with '), 100) || ' with ' || left(array_to_string(a[i + 1:], ' with '), 100) AS x FROM w),
s AS (SELECT doc_id, avg((contains(x, 'the') OR contains(x, 'thing'))::INT) AS share FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(d.text) = 0 OR d.text IS NULL THEN 0.5 WHEN share IS NULL THEN 0.5 WHEN share >= 0.5 THEN 0.8 WHEN share > 0 THEN 0.6 ELSE 0.4 END::DOUBLE AS score FROM documents d LEFT JOIN s USING (doc_id)""")
def context_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", classify.contexts(F.lower("text"), " with ", 100).alias("c"))
    hit = F.filter("c", lambda c: c.contains("the") | c.contains("thing"))
    share = F.size(hit) / F.nullif(F.size("c"), F.lit(0))
    return docs.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0.5).when(share.isNull(), 0.5).when(share >= 0.5, 0.8).when(share > 0, 0.6).otherwise(0.4).alias("score"))


@query("""SELECT p_partkey, (caption * 0.5 + header * 0.5)::DOUBLE AS score, caption * 0.5 + header * 0.5 >= 0.55 AS is_result FROM
(SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 0.7 ELSE 0.5 END AS caption, CASE WHEN contains(p_type, 'E') THEN 0.7 ELSE 0.3 END AS header FROM part)""")
def combined_score(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", classify.caption_score(F.col("p_name"), ["ring"], [], [], compat=True).alias("c"), classify.header_score(F.col("p_type"), None, ["E"], compat=True).alias("h"))
    return parts.select("p_partkey", classify.combined_score(F.col("c"), F.col("h")).alias("score")).withColumn("is_result", classify.is_result(F.col("score")))


@query("""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, length(regexp_extract(html, '<article>.*</article>', 0, 's')) AS article_chars FROM pages""")
def html_text(spark, sf):
    x = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract(x, "<title>([^<]*)</title>", 1)).alias("title"), F.length(F.regexp_extract(x, "(?s)<article>.*</article>", 0)).cast("long").alias("article_chars"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(props AS JSON) IS NOT NULL AS valid FROM events""")
def json_props(spark, sf):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    clean = jsonrepair.recovered(wrapped)
    return table(spark, sf, "events").select("event_id", F.get_json_object(clean, "$.k").try_cast("bigint").alias("k"), clean.isNotNull().alias("valid"))


@query("""SELECT user_id, event_type AS outcome_name, arg_min(CAST(value AS VARCHAR), event_id) AS outcome_description, count(*) AS num_variations,
  array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS tables, array_to_string(list_sort(list(DISTINCT CAST(hour(ts) % 4 AS VARCHAR))), ',') AS treatment_arms FROM events GROUP BY user_id, event_type""")
def outcome_groups(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.hour("ts") % 4).cast("string").alias("arm"), F.lit("").alias("sub"))
    g = O.group_outcomes(e, ["user_id"], "event_type", "value", "event_id", "day", "arm", "sub")
    return g.select("user_id", "outcome_name", "outcome_description", "num_variations", _string("tables").alias("tables"), _string("treatment_arms").alias("treatment_arms"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS total_statistics, count(*) AS unique_outcomes, count(*) FILTER (WHERE n > 1) AS multi_arm, (SELECT count(DISTINCT strftime(ts, '%Y-%m-%d')) FROM events) AS n_tables
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def mapping_summary(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("").alias("arm"))
    return O.mapping_summary(O.group_outcomes(e, ["user_id"], "event_type", "value", "event_id", "day", "arm", "arm"))


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def _label_checks():
    return {"effect_size": O.present(F.col("quality"), False), "se": O.present(F.col("toxic"), False), "literal": O.present(F.col("text"), True)}


@query("""SELECT lang, count(*) AS total, count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL AND coalesce(text, '') <> '') AS complete, count(*) FILTER (WHERE quality IS NULL) AS missing_effect_size,
  count(*) FILTER (WHERE toxic IS NULL) AS missing_se, count(*) FILTER (WHERE coalesce(text, '') = '') AS missing_literal,
  count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL AND coalesce(text, '') <> '') / count(*) AS completeness_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def validate_completeness(spark, sf):
    return O.validation(_labelled(spark, sf), _label_checks(), ["effect_size", "se", "literal"], ["lang"])


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'missing_effect_size' END, CASE WHEN toxic IS NULL THEN 'missing_se' END, CASE WHEN coalesce(text, '') = '' THEN 'missing_literal' END], lambda x: x IS NOT NULL), ',') AS issues
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic IS NULL OR coalesce(text, '') = ''""")
def issue_list(spark, sf):
    return _labelled(spark, sf).select("doc_id", O.issue_codes(_label_checks()).alias("i")).where(F.size("i") > 0).select("doc_id", _string("i").alias("issues"))


@query("""SELECT count(*) AS records, count(*) FILTER (WHERE l_extendedprice > 90000) AS n_effect, count(*) FILTER (WHERE l_quantity > 45) AS n_p, count(*) FILTER (WHERE l_tax = 0) AS n_no_se,
  count(*) FILTER (WHERE NOT (l_extendedprice > 90000) AND NOT (l_quantity > 45)) AS clean_rows,
  count(*) FILTER (WHERE l_extendedprice > 90000) + count(*) FILTER (WHERE l_quantity > 45) + (count(*) FILTER (WHERE l_tax = 0) > 0)::BIGINT AS issues,
  1 - (count(*) FILTER (WHERE l_extendedprice > 90000) + count(*) FILTER (WHERE l_quantity > 45) + (count(*) FILTER (WHERE l_tax = 0) > 0)::BIGINT) / count(*) AS quality_score,
  count(*) FILTER (WHERE NOT (l_extendedprice > 90000) AND NOT (l_quantity > 45)) / count(*) AS clean_row_rate FROM lineitem""")
def quality_issues(spark, sf):
    return O.quality(table(spark, sf, "lineitem"), {"no_se": F.col("l_tax") == 0}, {"effect": F.col("l_extendedprice") > 90000, "p": F.col("l_quantity") > 45})


@query("SELECT conv_id, turn, role, text FROM conversations")
def flatten_records(spark, sf):
    papers = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("outcomes"))
    return O.explode_outcomes(papers, ["conv_id"])


def _order_pairs(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("items"))
    return table(spark, sf, "orders").join(items, "o_orderkey")


@query("""SELECT o_orderkey, abs(o_totalprice - items) / abs(items) <= 0.01 AS is_match, CASE WHEN abs(o_totalprice - items) / abs(items) <= 0.01 THEN 'numeric_match' ELSE 'numeric_diff' END AS kind
FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def numeric_agreement(spark, sf):
    r = compare.numeric(F.col("o_totalprice"), F.col("items"))
    return _order_pairs(spark, sf).select("o_orderkey", r.is_match.alias("is_match"), F.regexp_replace(r.reason, r"(numeric_diff).*", "$1").alias("kind"))


@query("""SELECT c.c_custkey, lower(trim(c.c_mktsegment)) = lower(trim(o.p)) OR contains(lower(c.c_mktsegment), lower(o.p)) OR contains(lower(o.p), lower(c.c_mktsegment)) AS is_match
FROM customer c JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def categorical_agreement(spark, sf):
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    return table(spark, sf, "customer").join(first, "c_custkey").select("c_custkey", compare.categorical(F.col("c_mktsegment"), F.col("p")).is_match.alias("is_match"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x NOT IN ('', 'the','a','an','and','or','but','in','on','at','to','for','of','with','by','from','as','is','was','are','were','be'))) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id AND list_has_any(a.w, b.w)""")
def text_jaccard(spark, sf):
    t = table(spark, sf, "benchmark")
    words = t.select("item_id", compare.words_of(F.col("text")).alias("w"))
    pairs = R.token_overlap_join(words.withColumnRenamed("item_id", "a"), "a", words.withColumnRenamed("item_id", "b"), "b", "w", 1).where("a < b")
    pairs = pairs.join(t.select(F.col("item_id").alias("a"), F.col("text").alias("x")), "a").join(t.select(F.col("item_id").alias("b"), F.col("text").alias("y")), "b")
    return pairs.select("a", "b", F.round(compare.word_overlap(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("""SELECT doc_id, quality = toxic AS is_match, CASE WHEN quality = toxic THEN 'content_match' ELSE 'component_diff_' || CASE quality WHEN 1 THEN 'yes' ELSE 'no' END || '_vs_' || CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END END AS reason FROM labels""")
def component_agreement(spark, sf):
    r = compare.component(F.col("quality"), F.col("toxic"))
    return table(spark, sf, "labels").select("doc_id", r.is_match.alias("is_match"), r.reason.alias("reason"))


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, items, o_orderstatus, s FROM orders JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items, min(l_linestatus) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
c AS (SELECT 'price' AS field, abs(o_totalprice - items) / abs(items) <= 0.01 AS m FROM p UNION ALL SELECT 'status', lower(o_orderstatus) = lower(s) FROM p)
SELECT field, CAST(sum(m::INT) AS BIGINT) AS agreements, count(m) AS comparisons, 0::BIGINT AS both_null, sum(m::INT) / count(m) AS rate FROM c GROUP BY field""")
def agreement_metrics(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("items"), F.min("l_linestatus").alias("s"))
    pairs = table(spark, sf, "orders").join(items, "o_orderkey")
    return A.agreement(A.compare_records(pairs, "o_orderkey", {"price": ("numeric", "o_totalprice", "items"), "status": ("categorical", "o_orderstatus", "s")}))


def _status(spark, sf):
    o = table(spark, sf, "orders")
    return A.study_status(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


_STATUS = """SELECT h.o_custkey, h.n AS human_count, coalesce(m.n, 0) AS llm_count, coalesce(m.n, 0) / h.n AS recall, least(coalesce(m.n, 0) / h.n, 1.0) AS recall_capped,
  CASE WHEN m.n IS NULL THEN 'llm_missing' WHEN m.n = h.n THEN 'exact_match' WHEN m.n > h.n THEN 'llm_over_extracted' ELSE 'llm_under_extracted' END AS status
FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) h LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) m USING (o_custkey)"""


@query(_STATUS)
def om_compare(spark, sf):
    return _status(spark, sf)


@query(f"SELECT count(*) AS studies, CAST(sum(human_count) AS BIGINT) AS human_total, CAST(sum(llm_count) AS BIGINT) AS llm_total, round(avg(recall), 9) AS macro_recall, sum(llm_count) / sum(human_count) AS micro_recall FROM ({_STATUS})")
def om_metrics(spark, sf):
    return A.recall_totals(_status(spark, sf)).withColumn("macro_recall", F.round("macro_recall", 9))


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def om_status_distribution(spark, sf):
    return R.value_counts(_status(spark, sf), "status")


def _sides(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 45")
    return li.where("l_returnflag = 'R'").select("l_partkey"), li.where("l_returnflag = 'A'").select("l_partkey")


_SIDES = """SELECT coalesce(a.k, b.k) AS l_partkey, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b, CASE WHEN b.k IS NULL THEN 'a_only' WHEN a.k IS NULL THEN 'b_only' ELSE 'both' END AS side
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R') a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'A') b ON a.k = b.k"""


@query(_SIDES)
def table_coverage(spark, sf):
    return R.coverage(*_sides(spark, sf), ["l_partkey"])


@query(f"SELECT count(*) FILTER (WHERE side = 'both') AS both, count(*) FILTER (WHERE side = 'a_only') AS a_only, count(*) FILTER (WHERE side = 'b_only') AS b_only, count(*) FILTER (WHERE side = 'both') / count(*) FILTER (WHERE side <> 'b_only') AS recall FROM ({_SIDES})")
def coverage_recall(spark, sf):
    return R.coverage_counts(R.coverage(*_sides(spark, sf), ["l_partkey"]))


@query("""SELECT l_orderkey, after, before, array_to_string(range(after + 1, before), ',') AS missing FROM
(SELECT l_orderkey, n AS after, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS before FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)) WHERE before - after > 1""")
def gap_detection(spark, sf):
    return R.gaps(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").withColumn("missing", _string("missing"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AS is_duplicate, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS is_first FROM documents")
def duplicate_detection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    first = R.dedup(docs, ["h"], [F.col("doc_id")]).select(F.col("doc_id").alias("f"))
    return R.mark_duplicates(docs, ["h"]).join(first, F.col("doc_id") == F.col("f"), "left").select("doc_id", "is_duplicate", F.col("f").isNotNull().alias("is_first"))


@query("SELECT text_hash, n FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_groups(spark, sf):
    return R.duplicates(table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_hash")), ["text_hash"])


@query("""SELECT p_brand, row_number() OVER (ORDER BY TRY_CAST(s AS DOUBLE) IS NOT NULL, TRY_CAST(s AS DOUBLE), s) AS place FROM (SELECT DISTINCT p_brand, CASE WHEN p_brand LIKE '%1%' THEN p_brand ELSE replace(p_brand, 'Brand#', '') END AS s FROM part)""")
def natural_sort(spark, sf):
    from pyspark.sql import Window

    s = F.when(F.col("p_brand").contains("1"), F.col("p_brand")).otherwise(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")))
    brands = table(spark, sf, "part").select("p_brand", s.alias("s")).distinct()
    return brands.select("p_brand", F.row_number().over(Window.orderBy(*R.natural_order(F.col("s")))).cast("long").alias("place"))


@query("""WITH m AS (SELECT p_brand, avg(p_retailprice) AS rate FROM part GROUP BY 1)
SELECT 'top' AS which, p_brand FROM (SELECT p_brand FROM m ORDER BY rate DESC, p_brand LIMIT 5) UNION ALL SELECT 'bottom', p_brand FROM (SELECT p_brand FROM m ORDER BY rate, p_brand LIMIT 5)""")
def top_bottom(spark, sf):
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("rate")).withColumnRenamed("p_brand", "field")
    top, bottom = A.ranked(m, 5)
    return top.select(F.lit("top").alias("which"), F.col("field").alias("p_brand")).unionByName(bottom.select(F.lit("bottom").alias("which"), F.col("field").alias("p_brand")))


@query("""SELECT i AS in_orders, j AS in_lineitem, k AS in_documents, count(*) AS ids FROM (SELECT id, max(a) AS i, max(b) AS j, max(c) AS k FROM
(SELECT o_orderkey AS id, 1 AS a, 0 AS b, 0 AS c FROM orders UNION ALL SELECT l_orderkey, 0, 1, 0 FROM lineitem UNION ALL SELECT doc_id, 0, 0, 1 FROM documents) GROUP BY id) GROUP BY ALL""")
def reconcile_ids(spark, sf):
    sets = {"in_orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "in_lineitem": table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "in_documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"))}
    return R.reconcile(sets, "id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_keys(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.missing(table(spark, sf, "orders"), items, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_keys(spark, sf):
    return R.known(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_key' WHEN b.item_id IS NULL THEN 'key_without_file' ELSE 'ok' END AS state
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = l.doc_id % 50""")
def key_lookup_states(spark, sf):
    dim = table(spark, sf, "labels").select("doc_id", (F.col("doc_id") % 50).alias("item_id"))
    return R.classify_files(table(spark, sf, "documents").select("doc_id"), dim, table(spark, sf, "benchmark").select("item_id"), "doc_id", "item_id").select("doc_id", "state")


@query("""WITH h AS (SELECT b.item_id, d.doc_id, 'text' AS match_type FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)
SELECT * FROM h UNION ALL SELECT item_id, NULL, 'NOT FOUND' FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM h)""")
def contains_join(spark, sf):
    return R.contains_join(table(spark, sf, "documents"), "doc_id", ["text"], table(spark, sf, "benchmark"), "item_id", "text")


@query("""WITH t AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS w FROM benchmark), u AS (SELECT * FROM t WHERE length(w) >= 4)
SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM u a JOIN u b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def token_overlap_join(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.filter(F.split(T.squeeze(F.col("text")), " "), lambda w: F.length(w) >= 4).alias("w"))
    return R.token_overlap_join(t.withColumnRenamed("item_id", "a"), "a", t.withColumnRenamed("item_id", "b"), "b", "w").where("a < b")


@query("""SELECT 'quality' AS field, count(quality) AS non_null, count(*) AS total, count(quality) * 100.0 / count(*) AS pct FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(*), count(toxic) * 100.0 / count(*) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(lang), count(*), count(lang) * 100.0 / count(*) FROM documents""")
def field_completeness(spark, sf):
    return O.completeness(_labelled(spark, sf), ["quality", "toxic", "lang"])


@query("""SELECT 'o_orderstatus' AS "column", count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> '') AS non_empty, count(DISTINCT o_orderstatus) AS distinct_values, count(*) FILTER (WHERE o_orderstatus IN ('P')) AS blanks FROM orders
UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (WHERE o_orderpriority <> ''), count(DISTINCT o_orderpriority), count(*) FILTER (WHERE o_orderpriority IN ('P')) FROM orders""")
def column_profile(spark, sf):
    return R.profile(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["P"])


_TYPES = ["click", "error", "purchase", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def status_pivot(spark, sf):
    return R.status_pivot(table(spark, sf, "events"), ["user_id"], "event_type", _TYPES)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_annotation(spark, sf):
    return R.latest(table(spark, sf, "conversations"), "conv_id", [F.col("turn")]).select("conv_id", "turn", "role")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'Non sig.' ELSE CAST(l_tax AS VARCHAR) END AS p_value FROM lineitem")
def p_display(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.p_display(F.when(F.col("l_tax") != 0, F.col("l_tax"))).alias("p_value"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, length(o_orderpriority) // 4 AS tokens FROM orders")
def split_ids(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", T.id_base(F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit("_"))).alias("rank"), T.token_estimate(F.col("o_orderpriority")).alias("tokens"))


@query("SELECT doc_id, length(text) // 4 AS tokens, (length(text) // 4) / 200000 * 100 AS window_pct, left(text, 100) AS head, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' WHEN coalesce(length(text), 0) = 0 THEN 'N/A' ELSE text END AS shown FROM documents")
def token_estimate(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(x).alias("tokens"), T.window_share(x).alias("window_pct"), T.truncated(x, 100).alias("head"), T.ellipsis(x, 80).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1) // 5 AS batch FROM lineitem""")
def table_batches(spark, sf):
    from factloom.plans.phases import batches

    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")]
    return batches(table(spark, sf, "lineitem"), 5, "l_orderkey", order).select("l_orderkey", "l_linenumber", F.col("batch").cast("long").alias("batch"))


@query("""SELECT o_orderkey, c.c_name AS name, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment ELSE o.o_orderpriority END AS label FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""")
def metadata_override(spark, sf):
    dim = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"))
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("name"), F.col("o_orderpriority").alias("label"))
    return R.override(base, dim, "o_custkey", ["name", "label"]).select("o_orderkey", "name", "label")


@query("""SELECT r.o_orderkey, coalesce(n, 0) AS outcomes_found, n IS NOT NULL AS extraction_success FROM (SELECT DISTINCT o_orderkey FROM orders) r LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) e ON l_orderkey = o_orderkey""")
def extraction_results(spark, sf):
    got = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return O.table_results(table(spark, sf, "orders"), got, ["o_orderkey"])


@query("""SELECT count(*) AS papers, CAST(sum(n) AS BIGINT) AS first_rows, CAST(coalesce(sum(m), 0) AS BIGINT) AS second_rows, coalesce(sum(m), 0) / sum(n) AS ratio
FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) a LEFT JOIN (SELECT conv_id, count(*) AS m FROM conversations WHERE role <> 'user' GROUP BY 1) b USING (conv_id)""")
def stage_conversion(spark, sf):
    c = table(spark, sf, "conversations")
    return O.conversion(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id")


@query("""SELECT 'content' AS category, count(*) FILTER (WHERE trim(text) <> '') + count(*) FILTER (WHERE trim(lang) <> '') AS filled, 2 * count(*) AS cells, (count(*) FILTER (WHERE trim(text) <> '') + count(*) FILTER (WHERE trim(lang) <> '')) * 100.0 / (2 * count(*)) AS pct FROM documents
UNION ALL SELECT 'labels', count(quality) + count(toxic), 2 * count(*), (count(quality) + count(toxic)) * 100.0 / (2 * count(*)) FROM documents LEFT JOIN labels USING (doc_id)""")
def category_completeness(spark, sf):
    return O.category_completeness(_labelled(spark, sf), {"content": ["text", "lang"], "labels": ["quality", "toxic"]})


@query("SELECT source, count(*) AS outcomes, count(DISTINCT coalesce(CAST(quality AS VARCHAR), lang)) AS n_tables FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def source_counts(spark, sf):
    return O.source_counts(_labelled(spark, sf).withColumn("table", F.col("quality").cast("string")), "source", "table", "lang")


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE s >= 0.7) AS high_rows, round(avg(s), 9) AS mean_share
FROM (SELECT ((text IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) / 4 AS s FROM documents LEFT JOIN labels USING (doc_id))""")
def completeness_scores(spark, sf):
    return O.completeness_scores(_labelled(spark, sf), ["text", "lang", "quality", "toxic"])


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1998-01-01')")
def version_diff(spark, sf):
    """Ids that a later version of a table has and an earlier one hasn't."""
    o = table(spark, sf, "orders")
    return R.missing(o.where("o_orderdate >= DATE '1998-01-01'"), o.where("o_orderdate < DATE '1998-01-01'"), ["o_custkey"]).select("o_custkey").distinct()


@query("""SELECT doc_id, quality = toxic AS label_match, CAST(quality AS VARCHAR) AS label_llm, CAST(toxic AS VARCHAR) AS label_human, abs(n_chars - length(text)) / abs(length(text)) <= 0.01 AS size_match, CAST(n_chars AS VARCHAR) AS size_llm, CAST(length(text) AS VARCHAR) AS size_human
FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0""")
def wide_comparison(spark, sf):
    pairs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("n", F.length("text")).where("n > 0")
    long = A.compare_records(pairs, "doc_id", {"label": ("component", "quality", "toxic"), "size": ("numeric", "n_chars", "n")})
    return A.wide(long, "doc_id").drop("label_reason", "size_reason")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'Unknown' END AS status, CASE WHEN length(o_orderpriority) > 4 THEN left(o_orderpriority, 4) || '...' ELSE o_orderpriority END AS shown, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders""")
def display_labels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.label(F.col("o_orderstatus"), {"F": "SUCCESS", "O": "FAILED"}, "Unknown").alias("status"), T.ellipsis(F.col("o_orderpriority"), 4).alias("shown"), T.stamp(F.col("o_orderdate")).alias("stamp"))


@query("""SELECT l_orderkey, string_agg(n || '. ' || l_returnflag || ' (' || l_linestatus || ') at unknown location', chr(10) ORDER BY n) AS guidance
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS n FROM lineitem) GROUP BY l_orderkey""")
def stage_guidance(spark, sf):
    """Outcomes of the first stage, nested for each paper and written as a numbered list for the second."""
    outcome = F.struct("l_linenumber", F.col("l_returnflag").alias("outcome_category"), F.col("l_linestatus").alias("outcome_group"), F.lit(None).cast("string").alias("location"))
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(outcome)).alias("outcomes"))
    return nested.select("l_orderkey", T.guidance(F.col("outcomes")).alias("guidance"))


@query("""SELECT conv_id, unnest(regexp_extract_all(t, 'Table\\s+(\\d+)[.:]?\\s*([^\\n]*)', 1)) AS number, unnest(regexp_extract_all(t, 'Table\\s+(\\d+)[.:]?\\s*([^\\n]*)', 2)) AS title
FROM (SELECT conv_id, string_agg('Table ' || turn || ': ' || role, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)""")
def table_titles(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat(F.lit("Table "), x["turn"].cast("string"), F.lit(": "), x["role"])), "\n")
    return turns.select("conv_id", F.explode(T.table_titles(text)).alias("t")).select("conv_id", F.col("t.number").alias("number"), F.col("t.title").alias("title"))


@query("""SELECT o_orderkey, 'a' || o_orderkey AS outcome, false AS _supplemented, CAST(NULL AS VARCHAR) AS confidence_interval FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'b' || o_orderkey, true, '[' || o_custkey || ', ' || o_orderkey || ']' FROM orders WHERE o_orderstatus = 'O'""")
def merge_sources(spark, sf):
    o = table(spark, sf, "orders")
    named = lambda p: F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("outcome")
    pdf = o.where("o_orderstatus = 'O'").select("o_orderkey", named("b"), F.col("o_custkey").cast("string").alias("ci_lower"), F.col("o_orderkey").cast("string").alias("ci_upper"))
    return O.merge_sources(o.where("o_orderstatus = 'F'").select("o_orderkey", named("a")), pdf)


@query("""SELECT DISTINCT l_orderkey AS key, CAST(l_linenumber AS VARCHAR) AS table_number FROM lineitem EXCEPT SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'""")
def fallback_tables(spark, sf):
    from factloom.plans.phases import wanted_fallback

    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("string").alias("table_number"), "l_returnflag")
    return wanted_fallback(li, li.where("l_returnflag = 'R'"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN p END) AS component_click, max(CASE WHEN event_type = 'view' THEN p END) AS component_view
FROM (SELECT user_id, event_type, arg_max(props, event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id""")
def component_columns(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("p"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("components"))
    return O.component_columns(maps, "components", ["click", "view"])


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def dictionary_lookup(spark, sf):
    """A lookup whose right side keeps the last row of each key, as a dictionary built row by row does."""
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return R.lookup(table(spark, sf, "customer").select("c_custkey"), right, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, l.o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F') l ON o_custkey = c_custkey AND c_acctbal > 0""")
def outcomes_outer(spark, sf):
    """Nested outcomes of each paper unnested again; papers without any give one row of nulls."""
    nested = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey")).alias("outcomes"))
    papers = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(nested, "c_custkey", "left")
    return O.explode_outcomes(papers.withColumn("outcomes", F.when(F.col("c_acctbal") > 0, F.col("outcomes"))), ["c_custkey"], outer=True)


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN 0.01 WHEN 2 THEN 0.05 WHEN 1 THEN 0.1 END::DOUBLE AS p_value FROM lineitem""")
def stars_to_p(spark, sf):
    """p-values that stars after an estimate stand for."""
    literal = F.concat(F.col("l_quantity").cast("string"), F.expr("repeat('*', l_linenumber % 4)"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.p_from_stars(literal).alias("p_value"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn::INT END AS label, CASE WHEN turn % 2 = 1 THEN turn::INT END AS strict, turn::INT AS loose FROM
(SELECT conv_id, turn FROM conversations WHERE role IS NOT NULL)""")
def table_numbers(spark, sf):
    """The three ways of naming a table number in a text."""
    c = table(spark, sf, "conversations").where("role IS NOT NULL")
    n = F.col("turn").cast("string")
    x = F.concat(F.col("role"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(": table "), n, F.lit(" or table: "), n)).otherwise(F.concat(F.lit(", see Table  "), n, F.lit("B"))))
    return c.select("conv_id", "turn", *(T.table_number(x, form).alias(form) for form in ("label", "strict", "loose")))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1), ''), NULL) AS stem, 'K' || page_id AS key, 121000000 + page_id AS eppi_id FROM pages""")
def file_keys(spark, sf):
    """Keys of paths, and the long id inside a free text."""
    path = F.concat(F.lit("data/tei/K"), F.col("page_id").cast("string"), F.lit(".tei.xml"))
    note = F.concat(F.lit("EPPI: "), (F.col("page_id") + 121000000).cast("string"), F.lit(" (p. 12)"))
    return table(spark, sf, "pages").select("page_id", T.file_key(F.col("url")).alias("stem"), T.file_key(path).alias("key"), T.eppi_id(note).alias("eppi_id"))


@query("""SELECT o_orderkey, left(strftime(o_orderdate, '%Y-%m-%d'), 4) AS year, left(o_orderpriority, 100) AS title, 'A' || o_custkey || ', B' || o_custkey AS authors FROM orders""")
def citations(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey").cast("string")
    names = F.array(*(F.concat(F.lit(p), k) for p in "ABC"))
    return o.select("o_orderkey", T.citation(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority"), names).alias("c")).select("o_orderkey", "c.*")


@query("""SELECT c_custkey, 'Study ' || c_name || ' of ' || c_mktsegment || ', tables ["' || c_nationkey || '"], 100% {kept}' AS prompt FROM customer""")
def prompts(spark, sf):
    """A template with its placeholders filled, lists as JSON; unknown placeholders stay."""
    tables = F.to_json(F.array(F.col("c_nationkey").cast("string")))
    return table(spark, sf, "customer").select("c_custkey", T.prompt("Study {name} of {segment}, tables {tables}, 100% {kept}", name=F.col("c_name"), segment=F.col("c_mktsegment"), tables=tables).alias("prompt"))


_TEXT_PAIR = """SELECT o_orderkey, lower(trim(o_orderpriority)) AS x, lower(trim(c_mktsegment || ' ' || o_orderpriority)) AS y, o_custkey % 3 AS m FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(f"""SELECT o_orderkey, CASE m WHEN 0 THEN 'substring_match' WHEN 1 THEN 'exact_match' ELSE 'llm_missing' END AS reason, m <> 2 AS is_match FROM ({_TEXT_PAIR})""")
def text_agreement(spark, sf):
    """Texts that are equal, contained in one another, or missing on one side."""
    pairs = table(spark, sf, "orders").join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    m, both = F.col("o_custkey") % 3, F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("o_orderpriority"))
    r = compare.text(F.when(m == 0, F.col("o_orderpriority")).when(m == 1, F.upper(both)), both)
    return pairs.select("o_orderkey", r.reason.alias("reason"), r.is_match.alias("is_match"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x NOT IN ('', 'the','a','an','and','or','but','in','on','at','to','for','of','with','by','from','as','is','was','are','were','be'))) AS w FROM benchmark),
p AS (SELECT a.item_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM t a JOIN t b ON b.item_id = a.item_id + 1)
SELECT item_id, j > 0.5 AS is_match, CASE WHEN j > 0.5 THEN printf('word_overlap_%.2f', j) ELSE 'text_content_mismatch' END AS reason FROM p""")
def text_mismatch(spark, sf):
    """Texts of neighbouring items by the words they share."""
    t = table(spark, sf, "benchmark")
    pairs = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("y")), "item_id")
    return pairs.select("item_id", compare.text(F.col("text"), F.col("y")).alias("r")).select("item_id", "r.is_match", "r.reason")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(props AS JSON) IS NULL AS is_empty FROM events""")
def dict_literals(spark, sf):
    """Maps written as JSON on even rows and as Python literals on odd ones."""
    odd = F.regexp_replace(F.replace("props", F.lit('"'), F.lit("'")), r"\bnull\b", "None")
    m = jsonrepair.as_map(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(odd))
    return table(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), (F.size(m) == 0).alias("is_empty"))


@query("""WITH t AS (SELECT l_orderkey AS key, l_linenumber AS n, l_discount * 10 AS confidence FROM lineitem),
low AS (SELECT key, count(*) || ' low-confidence tables' AS w FROM t WHERE confidence < 0.5 GROUP BY key),
twice AS (SELECT key, 'duplicate table numbers: ' || string_agg(CAST(n AS VARCHAR), ', ' ORDER BY CAST(n AS VARCHAR)) AS w FROM (SELECT key, n FROM t GROUP BY key, n HAVING count(*) > 1) GROUP BY key),
nexts AS (SELECT key, n, lead(n) OVER (PARTITION BY key ORDER BY n) AS m FROM (SELECT DISTINCT key, n FROM t)),
holes AS (SELECT key, 'missing table numbers: ' || string_agg(CAST(h AS VARCHAR), ', ' ORDER BY h) AS w FROM (SELECT key, unnest(range(n + 1, m)) AS h FROM nexts WHERE m > n + 1) GROUP BY key)
SELECT key, string_agg(w, '; ' ORDER BY w) AS warnings FROM (SELECT * FROM low UNION ALL SELECT * FROM twice UNION ALL SELECT * FROM holes) GROUP BY key""")
def discovery_warnings(spark, sf):
    """Low confidence, repeated numbers and gaps in the numbering of each paper's tables."""
    from factloom.plans import phases

    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("string").alias("table_number"), (F.col("l_discount") * 10).alias("confidence"))
    return phases.discovery_warnings(t).select("key", F.array_join("warnings", "; ").alias("warnings"))


_CLASSES = """SELECT l_orderkey AS key, l_linenumber AS table_number, CASE l_returnflag WHEN 'R' THEN 'RESULTS' WHEN 'A' THEN 'DESCRIPTIVE' ELSE 'OTHER' END AS classification, CASE WHEN l_tax > 0 THEN l_tax * 10 END AS confidence FROM lineitem"""


def _classes(spark, sf):
    flag = T.label(F.col("l_returnflag"), {"R": "RESULTS", "A": "DESCRIPTIVE"}, "OTHER")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("table_number"), flag.alias("classification"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10).alias("confidence"))


@query(f"""SELECT key, table_number, classification, confidence FROM ({_CLASSES}) WHERE classification = 'DESCRIPTIVE' OR classification = 'RESULTS' AND coalesce(confidence, 1.0) >= 0.55""")
def split_classes(spark, sf):
    """RESULTS tables of enough confidence (a missing one is enough), and DESCRIPTIVE ones."""
    from factloom.plans import phases

    classes = _classes(spark, sf)
    found = classes.select("key", "table_number").distinct().select("*", F.lit("t").alias("title"), F.lit("p").alias("location"))
    results, descriptive = phases.split_classes(classes, found)
    return results.unionByName(descriptive).select("key", "table_number", "classification", "confidence")


@query(f"""SELECT key, count(*) AS total_tables, count(*) FILTER (WHERE classification = 'RESULTS') AS results_tables, count(*) FILTER (WHERE classification = 'DESCRIPTIVE') AS descriptive_tables FROM ({_CLASSES}) GROUP BY key""")
def class_totals(spark, sf):
    from factloom.plans import phases

    return phases.class_totals(_classes(spark, sf))


@query("""SELECT user_id AS key, event_type AS outcome_name, arg_min(CAST(value AS VARCHAR), event_id) OVER (PARTITION BY user_id, event_type) AS outcome_description, strftime(ts, '%Y-%m-%d') AS table_number, value AS effect_size, CAST(event_id AS VARCHAR) AS literal_text,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events""")
def flatten_groups(spark, sf):
    """Statistics grouped by outcome and unnested again, each with its group's name and description."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("value").cast("string").alias("text"), F.date_format("ts", "yyyy-MM-dd").alias("table_number"), F.col("value").alias("effect_size"), F.col("event_id").cast("string").alias("literal_text"), F.lit("").alias("arm"))
    g = O.group_outcomes(e, ["user_id"], "event_type", "text", "event_id", "table_number", "arm", "arm", ["table_number", "effect_size", "literal_text"])
    flat = O.flatten_groups(g, "user_id", "user_id")
    return flat.select("key", "outcome_name", "outcome_description", "table_number", "effect_size", "literal_text", (F.col("pos") + 1).cast("long").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS field, o_orderkey, length(o_orderstatus) + o_custkey % 500 = 1 AS differs FROM orders), n AS (SELECT field, count(*) FILTER (WHERE differs) AS n FROM c GROUP BY field)
SELECT field, o_orderkey FROM c JOIN n USING (field) WHERE differs AND n <= 50""")
def few_disagreements(spark, sf):
    """Mismatches of those fields that have only a few."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("field"), "o_orderkey", (F.length("o_orderstatus") + F.col("o_custkey") % 500 != 1).alias("is_match"))
    return A.disagreements(o, 50).select("field", "o_orderkey")


@query("""WITH s AS (SELECT h.n_nationkey AS key, h.c AS human_count, coalesce(m.c, 0) AS llm_count FROM (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) h LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS c FROM supplier GROUP BY 1) m USING (n_nationkey))
SELECT key, row_number() OVER (ORDER BY llm_count <> 0, llm_count / human_count, key)::INT AS place FROM s ORDER BY place LIMIT 100""")
def worst_first(spark, sf):
    """The first hundred studies in the order of a review (the limit is the report's): without any machine outcome first, then by recall."""
    from pyspark.sql import Window

    status = A.study_status(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "key"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "key"), "key")
    first = A.worst_first(status, "key").limit(100)
    return first.select("key", F.row_number().over(Window.orderBy(F.col("status") != "llm_missing", F.col("recall").asc_nulls_last(), "key")).alias("place"))


@query("""SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def upsert_annotations(spark, sf):
    """Annotations of two sessions, the latest of each key."""
    from factloom.sources.sinks import upsert_annotations as upsert

    li = table(spark, sf, "lineitem").withColumn("at", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"))
    return upsert(li.where("l_linenumber <= 3"), li.where("l_linenumber > 3"), ["l_partkey"], "at").select("l_partkey", "l_orderkey", "l_quantity")


@query("""SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def top_values(spark, sf):
    """The ten most frequent values of a column (the limit is the report's)."""
    return R.value_counts(table(spark, sf, "orders"), "o_orderstatus", 10).select(F.col("o_orderstatus").alias("value"), "n")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority AS human FROM lineitem l JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1) o ON o.o_custkey = l.l_suppkey""")
def first_human_record(spark, sf):
    """Machine records with the first human record of their study; those without one are left out."""
    human = table(spark, sf, "orders").select(F.col("o_custkey").alias("study"), "o_orderkey", "o_orderpriority")
    llm = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("study"), "l_orderkey", "l_linenumber")
    return A.match_records(llm, human, "study", [F.col("o_orderkey")])[0].select("l_orderkey", "l_linenumber", F.col("o_orderpriority").alias("human"))


@query("""SELECT DISTINCT l_suppkey AS study FROM lineitem WHERE l_suppkey NOT IN (SELECT o_custkey FROM orders)""")
def records_without_human(spark, sf):
    """Studies that only the machine has: what a comparison must warn of."""
    human = table(spark, sf, "orders").select(F.col("o_custkey").alias("study"), "o_orderkey")
    return A.match_records(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("study")), human, "study", [F.col("o_orderkey")])[1].distinct()


@query("""SELECT o_orderkey, o_custkey::VARCHAR AS id, year(o_orderdate)::INT AS year FROM orders WHERE o_custkey % 7 <> 0""")
def metadata_rows(spark, sf):
    """Rows of a dimension with a key, its id as text and its year as a number."""
    from factloom.sources.readers import metadata_rows as rows

    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("key"), "o_custkey", F.date_format("o_orderdate", "yyyy").alias("y"))
    return rows(o, "key", "o_custkey", "y").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("y").alias("year"))


@query("""SELECT c_custkey, to_base64(encode(c_name)) AS image, octet_length(encode(c_name)) / 1024 AS kb FROM customer""")
def binary_payloads(spark, sf):
    """Bytes as base64 text, and their size."""
    x = F.col("c_name").cast("binary")
    return table(spark, sf, "customer").select("c_custkey", F.base64(x).alias("image"), T.kilobytes(F.octet_length(x)).alias("kb"))


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf):
    """The windowed counts of the streaming front end, over a finished table."""
    from factloom.streaming import watch

    w = watch.event_windows(table(spark, sf, "events"))
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 6).alias("total"))


@query("""SELECT o_orderkey::VARCHAR AS study_id, o_orderstatus AS author_name, year(o_orderdate)::INT AS year_of_publication, o_orderpriority AS country, 'LLM Extraction' AS coder_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS extraction_timestamp, '1.0' AS extraction_version, CAST(NULL AS DOUBLE) AS effect_size FROM orders""")
def flat_estimates(spark, sf):
    """Nested estimate records with only their required fields, on one level."""
    from factloom.plans import records

    given = {"study_id": F.col("o_orderkey"), "author_name": F.col("o_orderstatus"), "year_of_publication": F.year("o_orderdate"), "country": F.col("o_orderpriority")}
    flat = records.flat_records(records.empty_records(table(spark, sf, "orders"), given, F.col("o_orderdate")))
    return flat.select("study_id", "author_name", "year_of_publication", "country", "coder_name", "extraction_timestamp", "extraction_version", "effect_size")


@query("""SELECT l_orderkey AS key, l_linenumber::VARCHAR AS table_number, arg_max(l_returnflag, (l_quantity, l_extendedprice, l_partkey)) AS title FROM lineitem GROUP BY ALL""")
def table_contexts(spark, sf):
    """What a classifier is shown of each paper's tables, by number; the last of repeated numbers counts."""
    from factloom.plans import records

    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("string").alias("table_number"), F.struct("l_quantity", "l_extendedprice", "l_partkey").alias("pos"), F.col("l_returnflag").alias("title"), F.lit(None).cast("string").alias("location"))
    return records.table_contexts(t).select("key", F.explode("contexts").alias("table_number", "c")).select("key", "table_number", F.col("c.title").alias("title"))


@query("""SELECT l_orderkey AS key, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R') AS tei_tables, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS pdf_tables, count(*) AS outcomes,
count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R') + count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS total_tables FROM lineitem GROUP BY 1""")
def merge_summary(spark, sf):
    """Tables and outcomes that each source gave."""
    from factloom.plans import records

    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("table_number"), "l_returnflag")
    return records.merge_summary(O.merge_sources(t.where("l_returnflag = 'R'"), t.where("l_returnflag <> 'R'")))
