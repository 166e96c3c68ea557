"""The engine's queries over the standard tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import geometry as G
from ..functions import images as I
from ..functions import numbers as N
from ..functions import ocr as O
from ..functions import styles as K
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import blocks as B
from ..operators import boilerplate as R
from ..operators import joins as J
from ..operators import layout as L
from ..operators import nesting as E
from ..operators import numbering as U
from ..operators import pages as P
from ..operators import paging as Y
from ..operators import routing as Z
from ..operators import sequences as S
from ..operators.tables import ruled_tables as ruled
from ..sinks import markdown as M
from ..sinks.archives import archives
from ..sinks.pdf import text_documents
from ..sources.html import pages_to_markdown
from ..sources.lines import text_lines
from ..streaming import jobs as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SP, CJK = T.SPACE, T.CJK


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt by key before they are split: what follows works by document or page and shuffles no more, where
    lines with all their columns would be several times as large."""
    return table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")


def epoch(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp read as UTC; the session's zone doesn't matter."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


# --- text -------------------------------------------------------------------------------------------------------------

LINES_SQL = f"""
 split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 raw AS (SELECT doc_id, unnest(range(len(ls))) AS seq, unnest(ls) AS text FROM split),
 kept AS (SELECT *, length(text) - length(regexp_replace(text, '^ +', '')) AS indent FROM raw WHERE regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g') <> ''),
 lines AS (SELECT doc_id, CAST(seq // 45 AS INT) AS page_index, seq, seq % 45 AS n, text, 72.0::DOUBLE + indent * (10.5::DOUBLE * 0.55::DOUBLE) AS x,
   (length(text) - indent) * (10.5::DOUBLE * 0.55::DOUBLE) AS w, 90.0::DOUBLE + 15.0::DOUBLE * (seq % 45) AS baseline, 10.5::DOUBLE AS font_size FROM kept)
"""
MARKER_SQL = f"regexp_matches(text, '^[•·▪◦‣⁃●○■□∙]([{SP}]+|[㐀-鿿（【「])') OR regexp_matches(text, '^[*–—-][{SP}]+') OR (regexp_matches(text, '^(\\(?[0-9]+(\\.[0-9]+)*[.)）、]|\\(?[a-zA-Z][.)）]|[①-⑳]|[一二三四五六七八九十百]+[、.)]|（[0-9]+）|\\([0-9]+\\))') AND NOT regexp_matches(text, '^[0-9]{{4}}[.)]'))"
ENDS_SQL = f"regexp_matches(regexp_replace(text, '[{SP}]+$', ''), '[.。!！?？;；:：\"”』」）)]$') OR regexp_replace(text, '[{SP}]+$', '') = ''"
REPORT_SQL = f"""
WITH {LINES_SQL},
 m AS (SELECT *, min(x) OVER p AS lft, max(x + w) OVER p AS rgt, baseline - lag(baseline) OVER o AS gap, ({MARKER_SQL}) AS marked, ({ENDS_SQL}) AS ends,
   regexp_matches(text, '[{CJK}]') AS cjk FROM lines WINDOW p AS (PARTITION BY doc_id, page_index), o AS (PARTITION BY doc_id, page_index ORDER BY baseline, seq)),
 g AS (SELECT doc_id, page_index, list_sort(list(gap)) AS gs FROM m WHERE gap > 0 GROUP BY ALL),
 b AS (SELECT m.*, coalesce(gs[CAST(floor((len(gs) - 1) * 0.3::DOUBLE + 0.5) AS INT) + 1], 12.6::DOUBLE) AS base FROM m LEFT JOIN g USING (doc_id, page_index)),
 q AS (SELECT *, lag(x + w) OVER o < rgt - 26.25::DOUBLE AS early, x + w < rgt - 26.25::DOUBLE AS short, x > lft + 10.5::DOUBLE * 0.7::DOUBLE AS indented,
   lag(marked) OVER o AS pm, lag(x) OVER o AS px, lag(ends) OVER o AS pe, lag(cjk) OVER o AS pc FROM b WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY baseline, seq)),
 s AS (SELECT *, CASE WHEN gap IS NULL OR gap > base * 1.55::DOUBLE + 1 OR marked OR (pm AND x < px - 10.5::DOUBLE * 0.7::DOUBLE AND (early OR short)) OR (early AND NOT indented AND pe)
   OR (early AND pc) OR (indented AND NOT early) THEN 1 ELSE 0 END AS begins FROM q),
 n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, page_index ORDER BY baseline, seq) AS block FROM s),
 k AS (SELECT doc_id, page_index, block, count(*) AS lines, sum(length(text)) AS characters, arg_min(marked, seq) AS marked FROM n GROUP BY ALL)
"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.classify_blocks(B.paragraph_breaks(text_lines(dealt(spark, sf))), 10.5)


@query(REPORT_SQL + """SELECT doc_id, page_index, count(*) FILTER (NOT (marked AND lines <= 6)) AS paragraphs, CAST(0 AS BIGINT) AS headings, count(*) FILTER (marked AND lines <= 6) AS list_items,
 CAST(sum(characters) AS BIGINT) AS characters FROM k GROUP BY ALL""")
def page_report(spark, sf):
    return B.page_report(_blocks(spark, sf))


@query(REPORT_SQL + """, r AS (SELECT doc_id, page_index, count(*) FILTER (NOT (marked AND lines <= 6)) AS paragraphs, sum(characters) AS characters FROM k GROUP BY ALL)
 SELECT doc_id, count(*) AS pages, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(characters) AS BIGINT) AS characters, CAST(max(characters) AS BIGINT) AS fullest_page FROM r GROUP BY doc_id""")
def doc_report(spark, sf):
    return B.page_report(_blocks(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("paragraphs").alias("paragraphs"), F.sum("characters").alias("characters"), F.max("characters").alias("fullest_page"))


HEALTH_SQL = """SELECT doc_id, length(text) AS chars, b / greatest(length(text), 1)::DOUBLE AS replacement_ratio, CASE WHEN length(text) > 0 THEN (length(text) - b) / length(text)::DOUBLE ELSE 0 END AS printable_ratio,
 b / greatest(length(text), 1)::DOUBLE > 0.12::DOUBLE OR (length(text) > 20 AND (length(text) - b) / length(text)::DOUBLE < 0.7::DOUBLE) AS suspicious
 FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]')) AS b FROM documents)"""


@query(HEALTH_SQL)
def text_health(spark, sf):
    health = table(spark, sf, "documents").select("doc_id", A.text_health(F.col("text")).alias("h"))
    return health.select("doc_id", "h.chars", "h.replacement_ratio", "h.printable_ratio", "h.suspicious")


@query(f"SELECT page_id, regexp_replace(html, '{T.NOT_IN_XML}', '', 'g') AS clean, length(html) - length(regexp_replace(html, '{T.NOT_IN_XML}', '', 'g')) AS removed FROM pages")
def sanitize_text(spark, sf):
    clean = T.sanitize(F.col("html"))
    return table(spark, sf, "pages").select("page_id", clean.alias("clean"), (F.length("html") - F.length(clean)).alias("removed"))


@query(f"SELECT conv_id, turn, len(regexp_extract_all(text, '[{CJK}]')) AS cjk, length(text) AS chars, regexp_matches(text, '[{CJK}]') AS has_cjk FROM (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN '版面分析' ELSE '' END AS text FROM conversations)")
def cjk_profile(spark, sf):
    text = F.concat("text", F.when(F.col("turn") % 3 == 0, "版面分析").otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.cjk_count(text).alias("cjk"), F.length(text).alias("chars"), T.contains_cjk(text).alias("has_cjk"))


NUMBERED = "CASE seq % 6 WHEN 0 THEN '• ' WHEN 1 THEN CAST(seq + 1 AS VARCHAR) || '. ' WHEN 2 THEN 'b) ' WHEN 3 THEN '2.' || CAST(seq AS VARCHAR) || ' ' WHEN 4 THEN '2013. ' ELSE '' END || text"


def _numbered(spark, sf) -> DataFrame:
    """Lines with markers in front, since the documents have none."""
    lines = text_lines(table(spark, sf, "documents"))
    k, n = F.col("seq") % 6, F.col("seq").cast("string")
    mark = F.when(k == 0, "• ").when(k == 1, F.concat((F.col("seq") + 1).cast("string"), F.lit(". "))).when(k == 2, "b) ").when(k == 3, F.concat(F.lit("2."), n, F.lit(" "))).when(k == 4, "2013. ").otherwise("")
    return lines.withColumn("text", F.concat(mark, "text"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, seq, {NUMBERED} AS text FROM lines),
 m AS (SELECT *, regexp_extract(text, '^([•·▪◦‣⁃●○■□∙])[{SP}]+|^([*–—-])[{SP}]+', 1) || regexp_extract(text, '^([•·▪◦‣⁃●○■□∙])[{SP}]+|^([*–—-])[{SP}]+', 2) AS bul,
  regexp_extract(text, '^(\\(?[0-9]+(?:\\.[0-9]+)*[.)）、]|\\(?[a-zA-Z][.)）]|[①-⑳]|[一二三四五六七八九十百]+[、.)]|（[0-9]+）|\\([0-9]+\\))', 1) AS ord FROM t)
 SELECT CASE WHEN bul <> '' THEN 'bullet' WHEN regexp_matches(ord, '^[(（]') OR regexp_matches(ord, '^[0-9]+\\.[0-9]') THEN 'other' WHEN regexp_matches(ord, '^[0-9]+[.)]$') THEN 'decimal'
  WHEN regexp_matches(ord, '^[a-zA-Z][.)]$') THEN 'letter' ELSE 'other' END AS style, bul = '' AS ordered, CASE WHEN bul <> '' THEN bul ELSE ord END AS marker, count(*) AS lines
 FROM m WHERE bul <> '' OR (ord <> '' AND NOT regexp_matches(ord, '^[0-9]{{4}}[.)]')) GROUP BY ALL""")
def list_markers(spark, sf):
    found = _numbered(spark, sf).select(T.list_marker(F.col("text")).alias("m")).where("m is not null")
    return found.groupBy(F.col("m.style").alias("style"), F.col("m.ordered").alias("ordered"), F.col("m.marker").alias("marker")).agg(F.count("*").alias("lines"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, seq, {NUMBERED} AS text FROM lines), d AS (SELECT *, regexp_extract(regexp_replace(text, '^[{SP}]+', ''), '^([0-9]{{1,3}}(?:\\.[0-9]{{1,3}})*)[{SP}]+[^{SP}]', 1) AS num FROM t)
 SELECT doc_id, seq, len(string_split(num, '.')) AS depth FROM d WHERE num <> '' AND len(string_split(num, '.')) <= 4""")
def section_numbers(spark, sf):
    return _numbered(spark, sf).select("doc_id", F.col("seq").cast("long").alias("seq"), T.section_depth(F.col("text")).cast("long").alias("depth")).where("depth is not null")


@query(f"""WITH {LINES_SQL}, a AS (SELECT doc_id, seq, CASE WHEN seq % 4 = 1 THEN text || 'con-' ELSE text END AS t FROM lines),
 l AS (SELECT doc_id, list(t ORDER BY seq) AS ls FROM a GROUP BY doc_id)
 SELECT doc_id, list_reduce(ls, lambda p, t: CASE WHEN regexp_matches(p, '[A-Za-z][-\\x{{AD}}]$') AND regexp_matches(t, '^[a-z]') THEN left(p, length(p) - 1) || t
  WHEN regexp_matches(p, '[{SP}]$') OR regexp_matches(p, '[{CJK}]$') OR regexp_matches(t, '^[{CJK}]') THEN p || t ELSE p || ' ' || t END) AS joined FROM l""")
def line_join_paragraphs(spark, sf):
    lines = text_lines(dealt(spark, sf))
    text = F.when(F.col("seq") % 4 == 1, F.concat("text", F.lit("con-"))).otherwise(F.col("text"))
    ordered = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda s: s["t"]).alias("ls"))
    return ordered.select("doc_id", T.join_lines(F.col("ls")).alias("joined"))


@query("SELECT doc_id, regexp_replace(t, '[\\x{10000}-\\x{10FFFF}]', '□', 'g') AS text, len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')) AS replaced FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN '😀𠀀' ELSE '' END AS t FROM documents)")
def replace_astral(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "😀𠀀").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", T.replace_astral(text).alias("r")).select("doc_id", "r.text", "r.replaced")


ROMAN_SQL = "repeat('m', n // 1000) || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][n % 1000 // 100 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n % 100 // 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1]"


#: Letters of a number: there are (26**k - 26) / 25 numbers of fewer than k letters.
ALPHA_SQL = "CASE " + " ".join(f"WHEN n <= {(26 ** (k + 1) - 26) // 25} THEN " + " || ".join(f"chr(CAST(97 + (n - 1 - {(26**k - 26) // 25}) // {26 ** (k - i)} % 26 AS INT))" for i in range(1, k + 1)) for k in range(1, 7)) + " END"


@query(f"""SELECT n, CASE WHEN n > 0 THEN {ROMAN_SQL} ELSE CAST(n AS VARCHAR) END AS lower_roman, CASE WHEN n > 0 THEN {ALPHA_SQL} ELSE CAST(n AS VARCHAR) END AS lower_alpha, CASE WHEN n >= 0 THEN translate(CAST(n AS VARCHAR), '0123456789', '〇一二三四五六七八九') ELSE CAST(n AS VARCHAR) END AS cjk_decimal,
  CASE WHEN n BETWEEN 0 AND 9 THEN '0' ELSE '' END || n AS leading_zero FROM (SELECT DISTINCT p_partkey AS n FROM part)""")
def counters(spark, sf):
    n = F.col("n")
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("n")).distinct()
    return keys.select("n", T.counter(n, "lower-roman").alias("lower_roman"), T.counter(n, "lower-alpha").alias("lower_alpha"), T.counter(n, "cjk-decimal").alias("cjk_decimal"), T.counter(n, "decimal-leading-zero").alias("leading_zero"))


# --- aggregates -------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id % 20 AS grp, floor(n_chars / 50.0::DOUBLE + 0.5) * 50.0::DOUBLE AS k, count(*) AS c FROM documents GROUP BY ALL)
 SELECT grp, arg_max(k, c * 1e9 - k) AS mode, max(c) AS weight FROM b GROUP BY grp""")
def size_mode(spark, sf):
    docs = table(spark, sf, "documents").withColumn("grp", F.col("doc_id") % 20)
    return A.mode_by_bucket(docs, ["grp"], "n_chars", 50.0)


@query("""WITH b AS (SELECT l_orderkey, floor(l_quantity / 0.5::DOUBLE + 0.5) * 0.5::DOUBLE AS k, sum(least(40, l_linenumber * 7)) AS c FROM lineitem GROUP BY ALL)
 SELECT l_orderkey, arg_max(k, c * 1e6 - k) AS mode, CAST(max(c) AS BIGINT) AS weight FROM b GROUP BY l_orderkey""")
def body_font_mode(spark, sf):
    return A.mode_by_bucket(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", 0.5, F.least(F.lit(40), F.col("l_linenumber") * 7))


MEDIAN_SQL = """s AS (SELECT l_orderkey, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
 r AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS run, sum(w) OVER (PARTITION BY l_orderkey) AS tot FROM s), d AS (SELECT l_orderkey, min(l_quantity) AS median FROM r WHERE run >= tot / 2 GROUP BY l_orderkey)"""


@query(f"WITH {MEDIAN_SQL} SELECT * FROM d")
def weighted_median_size(spark, sf):
    return A.weighted_median(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


@query(f"""WITH {MEDIAN_SQL} SELECT l_orderkey, l_linenumber, median AS dominant, CASE WHEN abs(l_quantity / median - 1) < 0.35::DOUBLE THEN median WHEN l_quantity / median > 3 THEN median * 3 ELSE l_quantity END AS snapped
 FROM lineitem JOIN d USING (l_orderkey)""")
def snap_sizes(spark, sf):
    return A.snap_sizes(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "dominant", "snapped")


@query("""WITH t AS (SELECT l_partkey % 100 AS doc, l_suppkey % 10 AS page, l_orderkey, l_linenumber, l_quantity AS q, l_linenumber AS w FROM lineitem),
 a AS (SELECT doc, page, q, sum(w) AS w FROM t GROUP BY ALL), ar AS (SELECT *, sum(w) OVER (PARTITION BY doc, page ORDER BY q) AS run, sum(w) OVER (PARTITION BY doc, page) AS tot FROM a),
 p AS (SELECT doc, page, min(q) AS pq, any_value(tot) AS w FROM ar WHERE run >= tot / 2 GROUP BY doc, page), pd AS (SELECT doc, pq, sum(w) AS w FROM p GROUP BY ALL),
 pr AS (SELECT *, sum(w) OVER (PARTITION BY doc ORDER BY pq) AS run, sum(w) OVER (PARTITION BY doc) AS tot FROM pd), d AS (SELECT doc, min(pq) AS dq FROM pr WHERE run >= tot / 2 GROUP BY doc)
 SELECT l_orderkey, l_linenumber, CASE WHEN abs(pq / dq - 1) < 0.2::DOUBLE AND q = pq THEN dq ELSE q END AS unified FROM t JOIN p USING (doc, page) JOIN d USING (doc)""")
def unify_sizes(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("doc"), (F.col("l_suppkey") % 10).alias("page"), "l_orderkey", "l_linenumber", "l_quantity")
    return A.unify_sizes(t, "doc", "page", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "unified")


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.3::DOUBLE + 0.5) AS INT) + 1] AS value_at FROM lineitem GROUP BY l_suppkey")
def nearest_rank_percentile(spark, sf):
    return A.percentile_nearest(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.3)


@query("SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 40000 AS kept FROM documents")
def running_budget(spark, sf):
    return A.running_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 40000).drop("n_chars")


WARN_SQL = """w AS (SELECT event_id AS seq, user_id AS doc_id, event_type AS code, CAST(floor(epoch(ts) / 86400) AS BIGINT) % 7 AS page_index FROM events),
 u AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, code, page_index ORDER BY seq) = 1)"""


def _warnings(spark, sf) -> DataFrame:
    day = F.floor(epoch("ts") / 86400).cast("long") % 7
    events = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("code"), day.alias("page_index"))
    return S.first_of(events, ["doc_id", "code", "page_index"], ["seq"])


@query(f"WITH {WARN_SQL} SELECT doc_id, code, count(*) AS pages, min(seq) AS first_seq, rank() OVER (PARTITION BY doc_id ORDER BY count(*)) AS rarity FROM u GROUP BY doc_id, code")
def warning_summary(spark, sf):
    counted = _warnings(spark, sf).groupBy("doc_id", "code").agg(F.count("*").alias("pages"), F.min("seq").alias("first_seq"))
    return counted.withColumn("rarity", F.rank().over(Window.partitionBy("doc_id").orderBy("pages")))


# --- sequences --------------------------------------------------------------------------------------------------------

EVENTS_SQL = "e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", epoch("ts").alias("s"))


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT *, CASE WHEN s - lag(s) OVER o <= 3600 THEN 0 ELSE 1 END AS n FROM e WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id)),
 k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id) AS cluster FROM b) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, round(avg(s), 3) AS center, count(*) AS members FROM k GROUP BY user_id, cluster""")
def cluster_1d(spark, sf):
    return S.cluster_1d(_events(spark, sf), ["user_id"], "s", 3600, "event_id").withColumn("center", rounded(F.col("center"), 3))


INTERVALS_SQL = "i AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS a, CAST(epoch(o_orderdate) AS BIGINT) // 86400 + 20 + o_orderkey % 60 AS b FROM orders)"


def _intervals(spark, sf) -> DataFrame:
    day = F.floor(epoch("o_orderdate") / 86400).cast("long")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + 20 + F.col("o_orderkey") % 60).alias("b"))


@query(f"""WITH {INTERVALS_SQL}, m AS (SELECT *, CASE WHEN a <= 3 + max(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i),
 k AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS part FROM m) SELECT o_custkey, CAST(part AS BIGINT) AS part, min(a) AS a, max(b) AS b, count(*) AS members FROM k GROUP BY o_custkey, part""")
def merge_intervals(spark, sf):
    return S.merge_intervals(_intervals(spark, sf), ["o_custkey"], "a", "b", 3, ["o_orderkey"])


@query(f"""WITH {INTERVALS_SQL}, m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_from FROM i)
 SELECT o_custkey, gap_from, a AS gap_to FROM m WHERE a > gap_from""")
def find_gaps(spark, sf):
    return S.find_gaps(_intervals(spark, sf), ["o_custkey"], "a", "b", ["o_orderkey"])


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER o = role THEN 0 ELSE 1 END AS n FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 k AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t) SELECT conv_id, CAST(run AS BIGINT) AS run, any_value(role) AS role, min(turn) AS first_turn, count(*) AS turns FROM k GROUP BY conv_id, run""")
def run_merge(spark, sf):
    runs = S.islands(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], lambda prev: F.col("role") != prev("role"), "run")
    return runs.groupBy("conv_id", "run").agg(F.any_value("role").alias("role"), F.min("turn").alias("first_turn"), F.count("*").alias("turns"))


@query("""WITH t AS (SELECT *, CAST(floor(l_quantity / 10) AS BIGINT) || ':' || CAST(l_linenumber % 2 AS VARCHAR) AS key FROM lineitem),
 m AS (SELECT *, CASE WHEN lag(key) OVER o = key THEN 0 ELSE 1 END AS n FROM t WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
 k AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS section FROM m) SELECT l_orderkey, CAST(section AS BIGINT) AS section, any_value(key) AS page_size, count(*) AS pages FROM k GROUP BY l_orderkey, section""")
def section_islands(spark, sf):
    key = F.concat_ws(":", F.floor(F.col("l_quantity") / 10).cast("string"), (F.col("l_linenumber") % 2).cast("string"))
    pages = table(spark, sf, "lineitem").withColumn("key", key)
    runs = S.islands(pages, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], lambda prev: F.col("key") != prev("key"), "section")
    return runs.groupBy("l_orderkey", "section").agg(F.any_value("key").alias("page_size"), F.count("*").alias("pages"))


@query("""WITH t AS (SELECT p_partkey, split_part(p_name, ' ', 1) || '.docx' AS name FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM t)
 SELECT p_partkey, CASE WHEN k > 1 THEN left(name, length(name) - 5) || ' (' || k || ')' || '.docx' ELSE name END AS unique_name FROM k""")
def unique_names(spark, sf):
    named = table(spark, sf, "part").select("p_partkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".docx")).alias("name"))
    return S.unique_names(named, [], "name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""WITH d AS (SELECT DISTINCT l_orderkey % 500 AS doc_id, CAST(l_linenumber AS BIGINT) AS i FROM lineitem), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM d),
 s AS (SELECT doc_id, min(i) + 1 AS a, max(i) + 1 AS b FROM r GROUP BY doc_id, g) SELECT doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM s GROUP BY doc_id""")
def format_ranges(spark, sf):
    pages = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").cast("long").alias("i"))
    return S.format_ranges(pages, ["doc_id"], "i")


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS a, o_custkey % 12 + 1 AS b, 10 AS total FROM orders)
 SELECT o_orderkey, CASE WHEN least(a, b) > 10 THEN NULL ELSE list_sort(list_distinct(list_concat(range(least(a, b) - 1, least(greatest(a, b), 10)), CASE WHEN o_orderkey % 2 = 0 THEN range(7, 10) ELSE [] END))) END AS pages FROM t""")
def page_ranges(spark, sf):
    text = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("-"), (F.col("o_custkey") % 12 + 1).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ", 8-").otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", N.page_range(text, F.lit(10)).alias("pages"))


@query(f"""WITH {EVENTS_SQL} SELECT event_id, least(row_number() OVER (PARTITION BY user_id ORDER BY s, event_id), greatest(count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW), 4), 600) AS samples FROM e""")
def eta_window(spark, sf):
    return S.sample_window(_events(spark, sf), ["user_id"], "s", ["s", "event_id"], 7200).select("event_id", "samples")


PROGRESS_SQL = """
WITH e AS (SELECT event_id, user_id AS job_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, CASE event_type WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'rendering' WHEN 'error' THEN 'ocr' WHEN 'signup' THEN 'ocr-model' ELSE 'writing' END AS stage, event_id // 20 AS page FROM events),
 g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY job_id ORDER BY s, event_id) > 100000 THEN 1 ELSE 0 END AS cut FROM e),
 j AS (SELECT *, sum(cut) OVER (PARTITION BY job_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run, stage IN ('extracting', 'rendering') AS paged FROM g),
 m AS (SELECT *, paged AND page > coalesce(max(CASE WHEN paged THEN page END) OVER (PARTITION BY job_id, run ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS sampled FROM j),
 n AS (SELECT *, count(*) FILTER (sampled) OVER w AS k, count(*) FILTER (stage = 'ocr') OVER w AS ocr_pages FROM m WINDOW w AS (PARTITION BY job_id, run ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT job_id, run, k, page, s, least(k, greatest(count(*) OVER (PARTITION BY job_id, run ORDER BY s RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW), 4), 600) AS held FROM n WHERE sampled),
 f AS (SELECT a.job_id, a.run, a.k, a.held, a.page AS p1, a.s AS t1, b.page AS p0, b.s AS t0 FROM p a JOIN p b ON a.job_id = b.job_id AND a.run = b.run AND b.k = a.k - a.held + 1)
SELECT job_id, event_id, coalesce(held, 0) AS samples, ocr_pages, CASE WHEN stage <> 'writing' AND held >= 4 AND t1 - t0 >= 5 AND p1 > p0 THEN round(greatest(0, (1000000 - p1) * ((t1 - t0) / (p1 - p0)) - (s - t1)), 2) END AS seconds_left, false AS closed FROM n LEFT JOIN f USING (job_id, run, k)
UNION ALL SELECT job_id, NULL, max_by(coalesce(held, 0), n.k), max(ocr_pages), NULL, true FROM n LEFT JOIN f USING (job_id, run, k) GROUP BY job_id, run"""


@query(PROGRESS_SQL)
def job_progress(spark, sf):
    """Events as progress of jobs, streamed in four parts, with a restart before each."""
    e = table(spark, sf, "events")
    stage = F.col("event_type")
    named = F.when(stage == "view", "extracting").when(stage == "click", "rendering").when(stage == "error", "ocr").when(stage == "signup", "ocr-model").otherwise("writing")
    rows = e.select(F.col("user_id").alias("job_id"), "event_id", F.timestamp_micros(micros("ts")).alias("at"), named.alias("stage"), F.floor(F.col("event_id") / 20).cast("int").alias("page"), F.lit(1_000_000).alias("total"))
    low, high = rows.agg(F.unix_micros(F.min("at")), F.unix_micros(F.max("at"))).first()
    low, high = low or 0, high or 0
    cuts = [low + (high - low) * k // 4 for k in range(4)] + [high + 1]
    at = F.unix_micros("at")
    parts = [rows.where((at >= a) & (at < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    made = W.run_to_end(parts, lambda stream: W.track(stream, span=43_200.0, idle=100_000.0))
    return made.select("job_id", "event_id", F.col("samples").cast("long").alias("samples"), F.col("ocr_pages").cast("long").alias("ocr_pages"), F.round("seconds_left", 2).alias("seconds_left"), "closed")


# --- joins ------------------------------------------------------------------------------------------------------------

BOXES_SQL = "bx AS (SELECT p_partkey AS id, p_partkey // 200 AS page, CAST(p_partkey * 37 % 500 AS DOUBLE) AS x, CAST(p_partkey * 91 % 700 AS DOUBLE) AS y, CAST(5 + p_size AS DOUBLE) AS w, CAST(8 + p_size % 9 AS DOUBLE) AS h FROM part)"

SHEETS_SQL = BOXES_SQL.replace("p_partkey // 200", "p_partkey % 40")


def _boxes(spark, sf, page: Column | None = None) -> DataFrame:
    """Boxes on pages of 200, or of another rule."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (F.floor(k / 200) if page is None else page).alias("page"), (k * 37 % 500).cast("double").alias("x"), (k * 91 % 700).cast("double").alias("y"), (5 + F.col("p_size")).cast("double").alias("w"), (8 + F.col("p_size") % 9).cast("double").alias("h"))


def _sheets(spark, sf) -> DataFrame:
    """Boxes on 40 pages, which hold more the larger the table is."""
    return _boxes(spark, sf, F.col("p_partkey") % 40)


CENTER = "b.page = a.page AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h"
COVERS_SQL = "cv AS (SELECT id, page, x, y, w * 8 AS w, h * 30 AS h FROM bx WHERE id % 7 = 0), sp AS (SELECT * FROM bx WHERE id % 7 <> 0)"


def _covers(boxes: DataFrame) -> DataFrame:
    return boxes.where("id % 7 = 0").withColumn("w", F.col("w") * 8).withColumn("h", F.col("h") * 30)


@query(f"WITH {BOXES_SQL}, {COVERS_SQL} SELECT id, page FROM sp a WHERE NOT EXISTS (SELECT 1 FROM cv b WHERE {CENTER})")
def containment_anti_join(spark, sf):
    boxes = _boxes(spark, sf)
    return J.outside(boxes.where("id % 7 <> 0"), _covers(boxes), ["page"]).select("id", "page")


@query(f"WITH {SHEETS_SQL}, {COVERS_SQL} SELECT a.id, b.id AS cover FROM sp a JOIN cv b ON {CENTER.replace('b.x AND b.x + b.w', 'b.x - 1 AND b.x + b.w + 1').replace('b.y AND b.y + b.h', 'b.y - 1 AND b.y + b.h + 1')}")
def containment_join(spark, sf):
    boxes = _sheets(spark, sf)
    return J.inside(boxes.where("id % 7 <> 0"), _covers(boxes), ["page"], 1.0).select("id", F.col("_r_id").alias("cover"))


@query(f"""WITH {SHEETS_SQL}, r AS (SELECT page, y AS position, x AS s, x + w * 4 AS e FROM bx WHERE id % 3 = 0) SELECT id FROM bx a WHERE EXISTS (SELECT 1 FROM r WHERE r.page = a.page AND abs(r.position - a.y) <= 2.5 AND r.s <= a.x + 3 AND r.e >= a.x + a.w - 3)""")
def band_semi_join(spark, sf):
    boxes = _sheets(spark, sf).withColumn("position", F.col("y")).withColumn("s", F.col("x"))
    rules = boxes.where("id % 3 = 0").select("page", "position", "s", (F.col("x") + F.col("w") * 4).alias("e"))
    return J.ruled(boxes.withColumn("e", F.col("x") + F.col("w")), rules, ["page"], "position", "s", "e").select("id")


@query(f"WITH {EVENTS_SQL}, i AS (SELECT * FROM e WHERE event_id % 3 = 0), b AS (SELECT * FROM e WHERE event_id % 3 <> 0) SELECT i.user_id, i.event_id, min(b.event_id) AS before FROM i LEFT JOIN b ON b.user_id = i.user_id AND b.s >= i.s GROUP BY i.user_id, i.event_id")
def asof_first_after(spark, sf):
    e = _events(spark, sf)
    return J.first_after(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["user_id"], "event_id", "s", "event_id")


@query(f"""WITH RECURSIVE {BOXES_SQL}, ed AS (SELECT a.page, a.id AS u, b.id AS v FROM bx a JOIN bx b ON a.page = b.page AND a.x <= b.x + b.w + 12 AND b.x <= a.x + a.w + 12 AND a.y <= b.y + b.h + 12 AND b.y <= a.y + a.h + 12),
 c(page, id, r) AS (SELECT page, id, id FROM bx UNION SELECT ed.page, ed.v, c.r FROM c JOIN ed ON ed.page = c.page AND ed.u = c.id) SELECT page, id, min(r) AS component FROM c GROUP BY page, id""")
def box_components(spark, sf):
    return J.page_components(_boxes(spark, sf), ["page"], "id", 12.0)


@query(f"""WITH RECURSIVE {BOXES_SQL}, b AS MATERIALIZED (SELECT page, id, x, y, w * 4 AS w, h * 6 AS h, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM bx),
 f AS (SELECT page, k, id, true AS ok, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM b WHERE k = 1
  UNION ALL SELECT q.page, q.k, q.id, q.ok, CASE WHEN q.ok THEN list_append(q.kept, {{'x': q.x, 'y': q.y, 'w': q.w, 'h': q.h}}) ELSE q.kept END
   FROM (SELECT b.*, f.kept, len(list_filter(list_transform(f.kept, lambda o: greatest(0, least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * greatest(0, least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y)) / (o.w * o.h + b.w * b.h - greatest(0, least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * greatest(0, least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y)))), lambda v: v > 0.3::DOUBLE)) = 0 AS ok
    FROM f JOIN b ON b.page = f.page AND b.k = f.k + 1) q)
SELECT page, id FROM f WHERE ok""")
def nms_greedy(spark, sf):
    boxes = _boxes(spark, sf).withColumn("w", F.col("w") * 4).withColumn("h", F.col("h") * 6)
    return J.suppress(boxes, ["page"], "id", "id", 0.3).select("page", "id")


HEAD_SQL = f"""WITH {LINES_SQL},
 pg AS (SELECT doc_id // 40 AS doc_id, dense_rank() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id, page_index) AS page_index, seq, n, CASE WHEN n = 0 THEN 'Chapter ' || (doc_id % 3) || ' Title 7' WHEN n = 1 THEN CAST(doc_id AS VARCHAR) ELSE text END AS text,
   CASE WHEN n = 0 THEN 40.0::DOUBLE + doc_id % 5 WHEN n = 1 THEN 780.0::DOUBLE ELSE 300.0::DOUBLE END AS y FROM lines),
 f AS (SELECT *, CASE WHEN y + 5 < 842 * 0.11::DOUBLE THEN 'header' WHEN y + 5 > 842 * (1 - 0.11::DOUBLE) THEN 'footer' END AS band,
   CASE WHEN regexp_matches(text, '^[0-9]{{1,4}}$') THEN '<pageno>' ELSE lower(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[{SP}]+', ' ', 'g')) END AS key FROM pg),
 d AS (SELECT doc_id, greatest(2, ceil(count(DISTINCT page_index) / 2.0)) AS needed FROM pg GROUP BY doc_id HAVING count(DISTINCT page_index) >= 3),
 k AS (SELECT f.doc_id, band, key, any_value(needed) AS needed FROM f JOIN d USING (doc_id) WHERE band IS NOT NULL GROUP BY f.doc_id, band, key HAVING count(DISTINCT page_index) >= any_value(needed))
 SELECT f.doc_id, f.page_index, f.seq AS line_id, f.band FROM f JOIN k USING (doc_id, band, key)"""


def _books(spark, sf) -> DataFrame:
    """Pages of documents taken as pages of books of 40 documents: the first line of each becomes a running title, the second a number."""
    lines = text_lines(table(spark, sf, "documents"))
    d, n = F.col("doc_id"), F.col("n")
    text = F.when(n == 0, F.concat(F.lit("Chapter "), (d % 3).cast("string"), F.lit(" Title 7"))).when(n == 1, d.cast("string")).otherwise(F.col("text"))
    y = F.when(n == 0, F.lit(40.0) + d % 5).when(n == 1, 780.0).otherwise(300.0)
    page = F.dense_rank().over(Window.partitionBy(F.floor(d / 40)).orderBy("doc_id", "page_index"))
    pages = lines.select(F.floor(d / 40).alias("doc_id"), page.cast("long").alias("page_index"), F.col("seq").cast("long").alias("line_id"), text.alias("text"), F.lit(72.0).alias("x"), y.alias("y"), F.lit(100.0).alias("w"), F.lit(10.0).alias("h"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.lit(False).alias("rotated"))
    return pages


@query(HEAD_SQL)
def repeated_boilerplate(spark, sf):
    return R.repeated_lines(_books(spark, sf)).select("doc_id", "page_index", "line_id", "band")


HEAD_CTE = HEAD_SQL[: HEAD_SQL.rindex(" SELECT f.doc_id")] + ", rl AS (SELECT f.* FROM f JOIN k USING (doc_id, band, key))"


@query(HEAD_CTE + """ SELECT doc_id, page_index, CASE band WHEN 'footer' THEN 'foot' ELSE 'head' END AS part, count(*) AS lines, min(y) AS y, max(y) + 10 - min(y) AS h, string_agg(text, chr(10) ORDER BY y, seq) AS text FROM rl GROUP BY ALL""")
def page_furniture(spark, sf):
    """Heads and feet of the books' pages, as a writer repeats them."""
    return R.furniture(R.repeated_lines(_books(spark, sf))).select("doc_id", "page_index", "part", "lines", "y", "h", "text")


@query(HEAD_CTE + """ SELECT doc_id, page_index, seq AS line_id FROM pg ANTI JOIN rl USING (doc_id, page_index, seq)""")
def body_lines(spark, sf):
    """What is left of the books' pages without running heads and feet."""
    pages = _books(spark, sf)
    return R.without(pages, R.repeated_lines(pages)).select("doc_id", "page_index", "line_id")




# --- image plans ------------------------------------------------------------------------------------------------------

SIZE_SQL = "t AS (SELECT p_partkey, p_size * 120 AS w, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part)"


def _sizes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 120).alias("w"), F.floor("p_retailprice").cast("long").alias("h"))


@query(f"""WITH {SIZE_SQL} SELECT p_partkey, CASE WHEN 1920 < greatest(w, h) THEN greatest(1, floor(w * (1920::DOUBLE / greatest(w, h)) + 0.5)) ELSE w END::DOUBLE AS width,
 CASE WHEN 1920 < greatest(w, h) THEN greatest(1, floor(h * (1920::DOUBLE / greatest(w, h)) + 0.5)) ELSE h END::DOUBLE AS height FROM t""")
def resize_plan(spark, sf):
    return _sizes(spark, sf).select("p_partkey", I.plan_resize(F.col("w"), F.col("h"), "long", 1920).alias("p")).select("p_partkey", "p.width", "p.height")


@query(f"""WITH {SIZE_SQL}, c AS (SELECT *, greatest(800::DOUBLE / w, 600::DOUBLE / h) AS s FROM t) SELECT p_partkey, CASE WHEN w = 800 AND h = 600 THEN 0 ELSE round((w - least(w, 800 / s)) / 2, 6) END AS sx, CASE WHEN w = 800 AND h = 600 THEN 0 ELSE round((h - least(h, 600 / s)) / 2, 6) END AS sy FROM c""")
def exact_plan(spark, sf):
    return _sizes(spark, sf).select("p_partkey", I.plan_resize(F.col("w"), F.col("h"), "exact", exact=(800, 600)).alias("p")).select("p_partkey", rounded(F.col("p.sx")).alias("sx"), rounded(F.col("p.sy")).alias("sy"))


@query(f"""WITH {SIZE_SQL}, c AS (SELECT *, least(1.0::DOUBLE, sqrt(1000000::DOUBLE / (w::DOUBLE * h)), 16384::DOUBLE / greatest(w, h)) AS s FROM t) SELECT p_partkey, CASE WHEN s >= 1 THEN w ELSE greatest(1, floor(w * s)) END::DOUBLE AS width, CASE WHEN s >= 1 THEN h ELSE greatest(1, floor(h * s)) END::DOUBLE AS height, s < 1 AS changed FROM c""")
def limit_plan(spark, sf):
    plan = I.plan_resize(F.col("w"), F.col("h"), "none")
    return _sizes(spark, sf).withColumn("p", plan).select("p_partkey", I.limit_plan(F.col("p"), 1_000_000).alias("p")).select("p_partkey", "p.width", "p.height", "p.changed")


FACTS_SQL = "f AS (SELECT p_partkey, ['jpeg','png','webp','gif','bmp'][p_partkey % 5 + 1] AS src, ['keep','webp','png','jpeg'][p_size % 4 + 1] AS choice, p_partkey % 2 = 0 AS alpha, p_partkey % 3 = 0 AS photo, p_partkey % 7 < 4 AS webp FROM part)"


@query(f"""WITH {FACTS_SQL} SELECT p_partkey, CASE WHEN choice = 'webp' THEN CASE WHEN webp THEN 'webp' WHEN alpha OR NOT photo THEN 'png' ELSE 'jpeg' END WHEN choice <> 'keep' THEN choice WHEN src IN ('jpeg','png') OR (src = 'webp' AND webp) THEN src WHEN alpha OR NOT photo THEN 'png' ELSE 'jpeg' END AS format,
 CASE WHEN choice = 'webp' THEN NOT webp WHEN choice <> 'keep' THEN false ELSE NOT (src IN ('jpeg','png') OR (src = 'webp' AND webp)) END AS changed FROM f""")
def choose_format(spark, sf):
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    made = I.choose_format(pick(["jpeg", "png", "webp", "gif", "bmp"], k % 5), pick(["keep", "webp", "png", "jpeg"], F.col("p_size") % 4), k % 2 == 0, k % 3 == 0, k % 7 < 4)
    return table(spark, sf, "part").select("p_partkey", made.alias("m")).select("p_partkey", "m.format", "m.changed")


@query("SELECT p_partkey, p_partkey % 2 = 0 AND NOT p_size % 3 = 0 AND NOT p_size % 5 = 0 AND p_partkey % 97 >= p_size AS kept FROM part")
def keep_original(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", I.keep_original(k % 2 == 0, s % 3 == 0, s % 5 == 0, s, k % 97).alias("kept"))


@query(f"""WITH {SIZE_SQL}, o AS (SELECT *, CASE WHEN w > h THEN 841.89::DOUBLE ELSE 595.28::DOUBLE END AS pw, CASE WHEN w > h THEN 595.28::DOUBLE ELSE 841.89::DOUBLE END AS ph FROM t), s AS (SELECT *, least((pw - 56.7::DOUBLE) / w, (ph - 56.7::DOUBLE) / h) AS s FROM o)
 SELECT p_partkey, pw AS page_width, round((pw - w * s) / 2, 6) AS x, round((ph - h * s) / 2, 6) AS y, round(w * s, 6) AS width, round(h * s, 6) AS height FROM s""")
def place_image(spark, sf):
    placed = _sizes(spark, sf).select("p_partkey", I.place_image(F.col("w"), F.col("h"), "a4", "auto", "small").alias("p"))
    return placed.select("p_partkey", "p.page_width", *[rounded(F.col(f"p.{c}")).alias(c) for c in ("x", "y", "width", "height")])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice * 0.92::DOUBLE <= 20000 THEN 0.92::DOUBLE WHEN l_extendedprice * 0.3::DOUBLE > 20000 THEN 0.3::DOUBLE ELSE
 list_reduce([{'lo': 0.3::DOUBLE, 'hi': 0.92::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}, {'lo': 0::DOUBLE, 'hi': 0::DOUBLE}],
  lambda a, b: {'lo': CASE WHEN l_extendedprice * ((a.lo + a.hi) / 2) <= 20000 THEN (a.lo + a.hi) / 2 ELSE a.lo END, 'hi': CASE WHEN l_extendedprice * ((a.lo + a.hi) / 2) <= 20000 THEN a.hi ELSE (a.lo + a.hi) / 2 END}).lo END AS quality, l_extendedprice * 0.3::DOUBLE <= 20000 AS fits FROM lineitem""")
def quality_search(spark, sf):
    found = I.search_quality(lambda q: F.col("l_extendedprice") * q, F.lit(20000.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", found.alias("f")).select("l_orderkey", "l_linenumber", "f.quality", "f.fits")


@query(f"WITH {SHEETS_SQL} SELECT a.page, a.id AS a, b.id AS b, round(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))), 9) AS iou FROM bx a JOIN bx b ON a.page = b.page AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def box_iou(spark, sf):
    return J.overlapping_keys(_sheets(spark, sf), ["page"], "id", iou=rounded(G.iou(G.columns(), G.columns("_r_")), 9))


# --- pages ------------------------------------------------------------------------------------------------------------


ADVANCE, SPAN_ROWS, SPAN_WIDTH = 5.5, 48, 232.0


def _spans(spark, sf) -> DataFrame:
    """Two-column pages from documents: words of a line as spans, odd lines in the right column.

    A line takes as many rows as its words need; a column goes on down the pages of its document, 48 rows a page. A word
    wider than a column has a row to itself, in a type small enough to fit."""
    lines = text_lines(dealt(spark, sf)).select("doc_id", "seq", (F.col("n") % 2).alias("side"), P.wrapped(F.col("text"), ADVANCE, SPAN_WIDTH).alias("ws"))
    column = Window.partitionBy("doc_id", "side").orderBy("seq")
    # words of earlier lines of the text, and rows of earlier lines of the column
    placed = lines.withColumn("first", F.sum(F.size("ws")).over(Window.partitionBy("doc_id").orderBy("seq")) - F.size("ws"))
    rows = F.element_at("ws", -1)["row"] + 1
    placed = placed.withColumn("top", F.sum(rows).over(column) - rows)
    spans = placed.select("doc_id", "side", "first", "top", F.posexplode("ws").alias("k", "w"))
    row = F.col("top") + F.col("w.row")
    baseline = F.lit(92.0) + row % SPAN_ROWS * 14
    size = F.least(F.lit(10.0), F.lit(10 * SPAN_WIDTH / ADVANCE) / F.length("w.text"))
    return spans.select(
        "doc_id", F.floor(row / SPAN_ROWS).cast("int").alias("page_index"), (F.col("first") + F.col("k")).alias("seq"), "w.text", (F.lit(60.0) + F.col("side") * 270 + F.col("w.x")).alias("x"),
        (baseline - size * 0.8).alias("y"), (F.length("w.text") * size * (ADVANCE / 10)).alias("w"), size.alias("h"), baseline.alias("baseline"), size.alias("font_size"), F.lit(595.0).alias("page_width"),
    )


@query()
def build_lines(spark, sf):
    return P.build_lines(_spans(spark, sf))


@query()
def xy_cut(spark, sf):
    return P.reading_order(_spans(spark, sf))


def _styled(spark, sf) -> DataFrame:
    """Pages of one column, 45 lines each, in several sizes and weights, with list markers and section numbers."""
    lines = dealt(spark, sf).select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda t: t.rlike(f"[^{SP}]"))).alias("seq", "line"))
    k, n = F.col("seq") % 11, F.col("seq") % 45
    text = F.concat(F.when(k == 5, "• ").when(k == 7, "2.1 ").when(k == 9, "3. ").otherwise(""), "line")
    size = F.when(n == 0, 20.0).when(n == 15, 15.5).when(n == 30, 12.5).otherwise(10.5)
    lines = lines.select("doc_id", F.floor(F.col("seq") / 45).cast("int").alias("page_index"), "seq", n.alias("n"), text.alias("text"), size.alias("font_size"))
    baseline = F.lit(90.0) + n * 15
    return lines.select(
        "doc_id", "page_index", "seq", "text", (F.lit(72.0) + F.when(F.col("seq") % 3 == 2, 10.5).otherwise(0.0)).alias("x"), (baseline - F.col("font_size") * F.lit(0.8)).alias("y"), (F.length("text") * (F.col("font_size") * F.lit(0.55))).alias("w"),
        F.col("font_size").alias("h"), baseline.alias("baseline"), "font_size", (F.col("seq") % 9 == 4).alias("bold"), F.lit(595.0).alias("page_width"),
    )


LAYOUT_SQL = f"""
WITH raw AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: regexp_matches(t, '[^{SP}]')) AS ls FROM documents),
 e AS (SELECT doc_id, unnest(range(len(ls))) AS seq, unnest(ls) AS line FROM raw),
 l AS (SELECT doc_id, CAST(seq // 45 AS INT) AS page_index, seq, CASE seq % 11 WHEN 5 THEN '• ' WHEN 7 THEN '2.1 ' WHEN 9 THEN '3. ' ELSE '' END || line AS text,
   CASE seq % 45 WHEN 0 THEN 20.0::DOUBLE WHEN 15 THEN 15.5::DOUBLE WHEN 30 THEN 12.5::DOUBLE ELSE 10.5::DOUBLE END AS size, 72.0::DOUBLE + CASE WHEN seq % 3 = 2 THEN 10.5::DOUBLE ELSE 0::DOUBLE END AS x, 90.0::DOUBLE + 15 * (seq % 45) AS baseline, seq % 9 = 4 AS bold FROM e),
 sz AS (SELECT doc_id, size, sum(least(40, length(regexp_replace(text, '^[{SP}]+|[{SP}]+$', '', 'g')))) AS w FROM l GROUP BY ALL), body AS (SELECT doc_id, arg_max(size, w * 100 - size) AS body_size FROM sz GROUP BY doc_id),
 m AS (SELECT l.*, body_size, length(text) * (size * 0.55::DOUBLE) AS w, ({MARKER_SQL}) AS marked, ({ENDS_SQL}) AS ends, regexp_matches(text, '[{CJK}]') AS cjk FROM l JOIN body USING (doc_id)),
 p AS (SELECT *, min(x) OVER g AS lft, max(x + w) OVER g AS rgt, baseline - lag(baseline) OVER o AS gap, lag(size) OVER o AS psize, lag(bold) OVER o AS pbold, lag(marked) OVER o AS pm, lag(x) OVER o AS px, lag(x + w) OVER o AS pe, lag(ends) OVER o AS pends, lag(cjk) OVER o AS pcjk,
   least(size, lag(size) OVER o) AS em FROM m WINDOW g AS (PARTITION BY doc_id, page_index), o AS (PARTITION BY doc_id, page_index ORDER BY seq)),
 b AS (SELECT *, CASE WHEN gap IS NULL OR gap > 15 * 1.55::DOUBLE + 1 OR abs(size - psize) > em * 0.15::DOUBLE OR bold <> pbold OR marked OR (pm AND x < px - em * 0.7::DOUBLE AND (pe < rgt - em * 2.5::DOUBLE OR x + w < rgt - em * 2.5::DOUBLE))
   OR (pe < rgt - em * 2.5::DOUBLE AND NOT x > lft + em * 0.7::DOUBLE AND pends) OR (pe < rgt - em * 2.5::DOUBLE AND pcjk) OR (x > lft + em * 0.7::DOUBLE AND NOT pe < rgt - em * 2.5::DOUBLE) THEN 1 ELSE 0 END AS begins FROM p),
 n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, page_index ORDER BY seq) - 1 AS reading_order FROM b),
 k AS (SELECT doc_id, page_index, reading_order, any_value(body_size) AS body_size, any_value(lft) AS lft, any_value(rgt) AS rgt, count(*) AS lines, regexp_replace(string_agg(text, ' ' ORDER BY seq), '^[{SP}]+|[{SP}]+$', '', 'g') AS joined, median(size) AS size, bool_and(bold) AS bold,
   arg_min(marked, seq) AS marked, arg_min(text, seq) AS head, arg_min(x, seq) AS x, min(baseline) AS top, max(baseline) AS low, avg(x - lft) AS before, avg(rgt - x - w) AS after, list(rgt - x - w < size * 0.6::DOUBLE ORDER BY seq) AS filled FROM n GROUP BY ALL),
 d AS (SELECT *, size / body_size AS ratio, CASE WHEN regexp_matches(joined, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{0,3}}[{SP}]+[^{SP}]') THEN len(string_split(regexp_extract(joined, '^[0-9.]+'), '.')) END AS depth,
   CASE WHEN regexp_matches(joined, '^[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(joined, '^[（(][一二三四五六七八九十]+[）)]') THEN 3 END AS cl, regexp_matches(joined, '[.。!！?？;；:："”』」）)]$') AS jends FROM k),
 h AS (SELECT *, lines <= 3 AND length(joined) <= 120 AND ((ratio >= 1.12::DOUBLE AND (lines = 1 OR ratio >= 1.25::DOUBLE) AND NOT regexp_matches(joined, '[，、,]$')) OR (bold AND ratio >= 0.98::DOUBLE AND NOT jends AND length(joined) <= 60) OR (depth IS NOT NULL AND (bold OR ratio >= 1.05::DOUBLE))) AS heading FROM d),
 t AS (SELECT *, CASE WHEN marked AND lines <= 6 AND NOT (heading AND (ratio >= 1.12::DOUBLE OR regexp_matches(head, '^[{SP}]*[一二三四五六七八九十]+、'))) THEN 'list-item' WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind FROM h),
 pt AS (SELECT doc_id, page_index, max(CASE WHEN kind <> 'heading' AND lines > 1 THEN 15 ELSE 0 END) AS pitch, max(CASE WHEN reading_order = 0 THEN 0 END) AS z FROM t GROUP BY ALL),
 ls AS (SELECT doc_id, page_index, reading_order, arg_max(size, seq) AS last_size FROM n GROUP BY ALL)
SELECT doc_id, page_index, CAST(reading_order AS INT) AS reading_order, kind, CAST(CASE kind WHEN 'list-item' THEN least(4, floor((x - lft) / greatest(size * 1.4::DOUBLE, 8.0::DOUBLE))) WHEN 'heading' THEN CASE WHEN depth IS NOT NULL THEN least(4, depth) WHEN cl IS NOT NULL AND ratio < 1.4::DOUBLE THEN cl WHEN ratio >= 1.7::DOUBLE THEN 1 WHEN ratio >= 1.4::DOUBLE THEN 2 WHEN ratio >= 1.18::DOUBLE THEN 3 ELSE 4 END END AS INT) AS level,
 CASE WHEN kind = 'paragraph' THEN CASE WHEN before > greatest(1, rgt - lft) * 0.12::DOUBLE AND abs(before - after) < greatest(1, rgt - lft) * 0.06::DOUBLE THEN 'center' WHEN before > greatest(1, rgt - lft) * 0.25::DOUBLE AND after < greatest(1, rgt - lft) * 0.05::DOUBLE THEN 'right' WHEN lines >= 3 AND list_bool_and(list_slice(filled, 1, len(filled) - 1)) THEN 'justify' ELSE 'left' END END AS alignment,
 CAST(lines AS INT) AS lines, size AS font_size, bold, body_size,
 CAST(CASE WHEN lead(top) OVER o IS NULL THEN 0 ELSE greatest(0, least(24, floor(lead(top) OVER o - low - CASE WHEN lines > 1 THEN 15 WHEN pitch > 0 THEN pitch ELSE last_size * 1.2::DOUBLE END + 0.5))) END AS INT) AS space_after
FROM t JOIN pt USING (doc_id, page_index) JOIN ls USING (doc_id, page_index, reading_order) WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY reading_order)"""


@query(LAYOUT_SQL)
def layout_blocks(spark, sf):
    return L.layout(_styled(spark, sf)).select("doc_id", "page_index", "reading_order", "kind", "level", "alignment", "lines", "font_size", "bold", "body_size", "space_after")


@query()
def layout_pages(spark, sf):
    """The whole chain over the two-column pages: every block with its text and spacing."""
    return L.layout(_spans(spark, sf))


# --- documents --------------------------------------------------------------------------------------------------------

NUMBERING_SQL = """WITH t AS (SELECT conv_id, turn, turn % 3 AS level FROM conversations),
 g AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER o AS i1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER o AS i2 FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 c AS (SELECT *, i1 AS c0, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, i1 ORDER BY turn) AS c1, sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, i2 ORDER BY turn) AS c2 FROM g)
 SELECT conv_id, turn, CASE level WHEN 0 THEN CAST(c0 AS VARCHAR) || '.' WHEN 1 THEN CAST(c0 AS VARCHAR) || '.' || CAST(c1 AS VARCHAR) ELSE CAST(c0 AS VARCHAR) || '.' || CAST(c1 AS VARCHAR) || '.' || CAST(c2 AS VARCHAR) END AS label FROM c"""


@query(NUMBERING_SQL)
def numbering(spark, sf):
    items = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("level"))
    return S.hierarchical_numbers(items, ["conv_id"], ["turn"], "level", 3).select("conv_id", "turn", "label")


_ROMAN = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(repeat('I', CAST({0} AS INT)), 'IIIII', 'V'), 'VV', 'X'), 'XXXXX', 'L'), 'LL', 'C'), 'CCCCC', 'D'), 'DD', 'M'), 'DCCCC', 'CM'), 'CCCC', 'CD'), 'LXXXX', 'XC'), 'XXXX', 'XL'), 'VIIII', 'IX'), 'IIII', 'IV')"
_ALPHA = "CASE WHEN {0} > 702 THEN chr(CAST(96 + ({0} - 1 - 26) // 676 AS INT)) ELSE '' END || CASE WHEN {0} > 26 THEN chr(CAST(97 + (({0} - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(97 + ({0} - 1) % 26 AS INT))"
SHEET_SQL = f"""
WITH {LINES_SQL}, t AS (SELECT doc_id, seq, seq % 2 AS list, (seq * 7 + doc_id) % 11 % 4 AS level FROM lines),
 g AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER o AS i1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER o AS i2, doc_id % 4 + sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER o AS c0, sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER o AS c3 FROM t WINDOW o AS (PARTITION BY doc_id, list ORDER BY seq)),
 c AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, list, i1 ORDER BY seq) AS c1, 2 + sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, list, i2 ORDER BY seq) AS c2 FROM g),
 w AS (SELECT *, CASE WHEN c0 > 0 THEN {_ROMAN.format('c0')} ELSE '0' END AS t0, CASE WHEN c1 > 0 THEN {_ALPHA.format('c1')} ELSE '0' END AS t1, CASE WHEN c2 < 10 THEN '0' ELSE '' END || CAST(c2 AS VARCHAR) AS t2, lower({_ROMAN.format('c3')}) AS t3 FROM c)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CASE level WHEN 0 THEN t0 || '.' WHEN 1 THEN t0 || '.' || t1 || ')' WHEN 2 THEN t0 || '.' || t1 || '.' || t2 || chr(9) ELSE t3 || ' ' END AS label FROM w"""


@query(SHEET_SQL)
def numbering_sheets(spark, sf):
    """A sheet for each document, with a first number of its own, and its lines as items of two interleaved lists."""
    rules = "".join(
        f"p.w-num-{n}-0:before {{{{ content: \"\" counter(w-num-{n}-0, upper-roman) \".\"; }}}} p.w-num-{n}-1:before {{{{ content: counter(w-num-{n}-0, decimal)\".\"counter(w-num-{n}-1, lower-alpha) \")\" }}}} "
        f"p.w-num-{n}-2:before {{{{ content: counter(w-num-{n}-0) \".\" counter(w-num-{n}-1) \".\" counter(w-num-{n}-2, decimal-leading-zero) \"\\9\" }}}} p.w-num-{n}-3 {{{{ list-style-type: lower-roman }}}} "
        f":root {{{{ counter-reset: w-num-{n}-0 START w-num-{n}-1 w-num-{n}-2 2; }}}} "
        for n in (0, 1)
    ).replace("{{", "{").replace("}}", "}")
    docs = dealt(spark, sf)
    sheets = docs.select("doc_id", F.replace(F.lit(rules), F.lit("START"), (F.col("doc_id") % 4).cast("string")).alias("css"))
    level = (F.col("seq") * 7 + F.col("doc_id")) % 11 % 4
    items = text_lines(docs).select("doc_id", F.col("seq").cast("long").alias("seq"), F.concat_ws("-", F.lit("w-num"), (F.col("seq") % 2).cast("string"), level.cast("string")).alias("class"))
    return U.labels(items, sheets).select("doc_id", "seq", "label")


NESTED_SQL = f"""
WITH RECURSIVE {LINES_SQL}, it AS MATERIALIZED (SELECT doc_id, CAST(seq AS BIGINT) AS seq, (seq * 5 + doc_id) % 13 % 6 AS lvl, seq % 3 = 0 AS ordered, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM lines),
 st AS (SELECT doc_id, seq, k, [{{'level': lvl, 'list': seq, 'last': seq, 'up': NULL::BIGINT}}] AS s FROM it WHERE k = 1
  UNION ALL SELECT n.doc_id, n.seq, n.k, CASE WHEN n.lvl > n.p[len(n.p)].level THEN list_append(n.p, {{'level': n.lvl, 'list': n.seq, 'last': n.seq, 'up': n.p[len(n.p)].last}})
    ELSE list_append(list_slice(n.p, 1, len(n.p) - 1), {{'level': n.p[len(n.p)].level, 'list': n.p[len(n.p)].list, 'last': n.seq, 'up': n.p[len(n.p)].up}}) END
   FROM (SELECT it.doc_id, it.seq, it.k, it.lvl, list_concat([st.s[1]], list_filter(list_slice(st.s, 2, len(st.s)), lambda x: x.level <= it.lvl)) AS p FROM st JOIN it ON it.doc_id = st.doc_id AND it.k = st.k + 1) n),
 o AS (SELECT doc_id, seq, s[len(s)].up AS parent, s[len(s)].list AS list, len(s) AS depth FROM st)
SELECT o.doc_id, o.seq, parent, list, CAST(depth AS INT) AS depth, CAST(row_number() OVER (PARTITION BY o.doc_id, list ORDER BY o.seq) - 1 AS INT) AS position, f.ordered AS list_ordered FROM o JOIN it f ON f.doc_id = o.doc_id AND f.seq = o.list"""


@query(NESTED_SQL)
def nested_lists(spark, sf):
    """Lines as list items whose levels jump and fall back, also to levels that were never opened."""
    seq = F.col("seq").cast("long")
    items = text_lines(dealt(spark, sf)).select("doc_id", seq.alias("seq"), ((seq * 5 + F.col("doc_id")) % 13 % 6).alias("level"), (seq % 3 == 0).alias("ordered"))
    return E.nested_lists(items, ["doc_id"], "seq", "level", "ordered").select("doc_id", "seq", "parent", "list", "depth", "position", "list_ordered")


CELLS_SQL = "c AS (SELECT l_orderkey, l_linenumber AS k, (l_linenumber - 1) // 2 AS r, l_partkey % 3 AS c, 1 + l_suppkey % 2 AS rs, 1 + CAST(l_quantity AS INT) % 2 AS cs, l_returnflag || CAST(l_partkey AS VARCHAR) AS t FROM lineitem)"
GRID_SQL = f"""
WITH {CELLS_SQL}, z AS (SELECT l_orderkey, max(r + rs) AS nr, max(c + cs) AS nc FROM c GROUP BY 1),
 pl AS (SELECT l_orderkey, pr, unnest(range(nc)) AS pc FROM (SELECT l_orderkey, nc, unnest(range(nr)) AS pr FROM z)),
 cv AS (SELECT DISTINCT pl.l_orderkey, pr, pc FROM pl JOIN c ON c.l_orderkey = pl.l_orderkey AND pr >= r AND pr < r + rs AND pc >= c.c AND pc < c.c + cs AND NOT (pr = r AND pc = c.c)),
 og AS (SELECT l_orderkey, r, c, arg_max(rs, k) AS rs, arg_max(cs, k) AS cs, arg_max(t, k) AS t FROM c GROUP BY 1, 2, 3),
 gr AS (SELECT pl.l_orderkey, pr, pc, coalesce(rs, 1) AS rs, coalesce(cs, 1) AS cs, t FROM pl LEFT JOIN cv USING (l_orderkey, pr, pc) LEFT JOIN og ON og.l_orderkey = pl.l_orderkey AND og.r = pr AND og.c = pc WHERE cv.pr IS NULL)"""


def _grid(spark, sf) -> DataFrame:
    n = F.col("l_linenumber")
    cells = table(spark, sf, "lineitem").select(
        "l_orderkey", n.alias("k"), F.floor((n - 1) / 2).cast("int").alias("row"), (F.col("l_partkey") % 3).cast("int").alias("col"), (1 + F.col("l_suppkey") % 2).cast("int").alias("row_span"),
        (1 + F.col("l_quantity").cast("int") % 2).alias("col_span"), F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
        # line numbers repeat within an order: of equal ones SQL keeps the table's first row
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    )
    return E.dense_grid(cells, ["l_orderkey"], "k", ["file", "at"])


@query(GRID_SQL + " SELECT l_orderkey, CAST(pr AS INT) AS row, CAST(pc AS INT) AS col, CAST(rs AS INT) AS row_span, CAST(cs AS INT) AS col_span, t AS text FROM gr")
def table_grid(spark, sf):
    """Lines of an order as cells of a table, with spans that overlap and rows of unequal length."""
    return _grid(spark, sf).select("l_orderkey", "row", "col", "row_span", "col_span", "text")


@query(GRID_SQL + " SELECT l_orderkey, string_agg(t, ' ' ORDER BY pr, pc) AS text FROM gr WHERE t <> '' GROUP BY l_orderkey")
def table_text(spark, sf):
    """Tables as plain text: their cells' texts in order."""
    return E.flattened(_grid(spark, sf), ["l_orderkey"], "text")


@query(f"""WITH {LINES_SQL}, g AS (SELECT doc_id, page_index, n // 9 AS cell, seq, baseline - lag(baseline) OVER (PARTITION BY doc_id, page_index, n // 9 ORDER BY seq) AS gap FROM lines),
 u AS (SELECT *, coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY doc_id, page_index, cell), 12.6::DOUBLE) AS usual FROM g)
 SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(sum(CASE WHEN gap IS NULL OR gap > usual * 1.6::DOUBLE + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index, cell ORDER BY seq) AS BIGINT) AS paragraph FROM u""")
def cell_paragraphs(spark, sf):
    lines = text_lines(dealt(spark, sf)).withColumn("cell", F.floor(F.col("n") / 9))
    return E.cell_paragraphs(lines, ["doc_id", "page_index", "cell"]).select("doc_id", F.col("seq").cast("long").alias("seq"), "paragraph")


CLAIM_SQL = """
WITH RECURSIVE cand AS MATERIALIZED (SELECT o_custkey, o_orderkey, list_sort(list_distinct(list(l_partkey % 12))) AS ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey),
 f AS (SELECT o_custkey, k, o_orderkey, ms AS mine, len(ms) >= 3 AS ok, CASE WHEN len(ms) >= 3 THEN ms ELSE [] END AS taken FROM cand WHERE k = 1
  UNION ALL SELECT q.o_custkey, q.k, q.o_orderkey, q.mine, len(q.mine) >= 3, CASE WHEN len(q.mine) >= 3 THEN list_concat(q.taken, q.mine) ELSE q.taken END
   FROM (SELECT c.o_custkey, c.k, c.o_orderkey, f.taken, list_filter(c.ms, lambda m: NOT list_contains(f.taken, m)) AS mine FROM f JOIN cand c ON c.o_custkey = f.o_custkey AND c.k = f.k + 1) q)"""


def _claims(spark, sf) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_partkey") % 12).alias("member"))
    pairs = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    return pairs, E.claims(pairs, ["o_custkey"], "o_orderkey", "member", 3)


@query(CLAIM_SQL + " SELECT o_custkey, o_orderkey, ok AS accepted, CASE WHEN ok THEN mine ELSE [] END AS members FROM f")
def claims_rollback(spark, sf):
    """Orders of a customer claim kinds of parts in turn; with under three that are free an order gives them back."""
    return _claims(spark, sf)[1]


@query(CLAIM_SQL + """, held AS (SELECT o_custkey, unnest(mine) AS m FROM f WHERE ok)
 SELECT DISTINCT o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN held USING (o_custkey) WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.o_custkey = orders.o_custkey AND h.m = l_partkey % 12)""")
def unclaimed_lines(spark, sf):
    pairs, claimed = _claims(spark, sf)
    return E.unclaimed(pairs, claimed, ["o_custkey"], "l_linenumber", "member")


PLACED_SQL = f"""
WITH RECURSIVE {BOXES_SQL}, g AS (SELECT id // 24 AS page, id, x, y, w, id % 4 = 0 AS item FROM bx),
 it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM g WHERE item),
 b0 AS (SELECT p.page, coalesce(list({{'id': id, 'item': item, 'x': x, 'y': y, 'w': w}} ORDER BY id) FILTER (NOT item), []) AS s FROM (SELECT DISTINCT page FROM g) p JOIN g USING (page) GROUP BY p.page),
 f AS (SELECT page, CAST(0 AS BIGINT) AS k, s FROM b0
  UNION ALL SELECT q.page, q.k, list_concat(list_concat(list_slice(q.s, 1, q.at - 1), [q.b]), list_slice(q.s, q.at, len(q.s)))
   FROM (SELECT f.page, it.k, f.s, {{'id': it.id, 'item': it.item, 'x': it.x, 'y': it.y, 'w': it.w}} AS b,
     coalesce(list_min(list_filter(range(1, len(f.s) + 1), lambda j: f.s[j].y >= it.y AND greatest(0, least(f.s[j].x + f.s[j].w, it.x + it.w) - greatest(f.s[j].x, it.x)) / least(f.s[j].w, it.w) > 0.1::DOUBLE)), len(f.s) + 1) AS at
     FROM f JOIN it ON it.page = f.page AND it.k = f.k + 1) q),
 d AS (SELECT page, arg_max(s, k) AS s FROM f GROUP BY page)
SELECT page, CAST(unnest(range(len(s))) AS INT) AS position, unnest(list_transform(s, lambda e: e.id)) AS id, unnest(list_transform(s, lambda e: e.item)) AS item FROM d"""


@query(PLACED_SQL)
def sequential_insertion(spark, sf):
    """Of the boxes of a page, 24 by key, each fourth is put in between the others."""
    boxes = _boxes(spark, sf).withColumn("page", F.floor(F.col("id") / 24))
    item = F.col("id") % 4 == 0
    return E.insert_by_position(boxes.where(~item), boxes.where(item), ["page"], "id", "id")


PAGING_SQL = f"""
WITH {LINES_SQL}, s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 20.0::DOUBLE * (doc_id % 5) END AS hh, CASE WHEN doc_id % 2 = 0 THEN 14.0::DOUBLE ELSE 0::DOUBLE END AS fh FROM documents),
 g AS (SELECT *, greatest(72, CASE WHEN hh > 0 THEN 36 + hh + 6 ELSE 0 END)::DOUBLE AS top, greatest(72, CASE WHEN fh > 0 THEN 36 + fh + 6 ELSE 0 END)::DOUBLE AS bottom FROM s),
 z AS (SELECT *, greatest(72, 842 - top - bottom)::DOUBLE AS ch FROM g),
 c AS (SELECT l.doc_id, l.seq, l.x - 72 AS ix, floor(l.seq * 15 / ch) AS col, l.seq * 15 - floor(l.seq * 15 / ch) * ch AS pos, ch, top FROM lines l JOIN z USING (doc_id)),
 b AS (SELECT doc_id, seq, ix, CAST(CASE WHEN pos > 0 AND pos + 15 > ch THEN col + 1 ELSE col END AS INT) AS col, CASE WHEN pos > 0 AND pos + 15 > ch THEN 0 ELSE pos END AS pos, top FROM c),
 n AS (SELECT doc_id, max(col + CAST(floor((ix + 1) / 499.0::DOUBLE) AS INT)) + 1 AS pages FROM b GROUP BY doc_id), e AS (SELECT z.doc_id, hh, fh, unnest(range(coalesce(pages, 1))) AS page FROM z LEFT JOIN n USING (doc_id))
SELECT doc_id, CAST(col + floor((ix + 1) / 499.0::DOUBLE) AS INT) AS page, 'body' AS part, CAST(seq AS BIGINT) AS seq, round(ix - floor((ix + 1) / 499.0::DOUBLE) * 499 + 72, 6) AS x, round(pos + top, 6) AS y FROM b
UNION ALL SELECT doc_id, CAST(page AS INT), 'head', 0, 72, 36 FROM e WHERE hh > 0 UNION ALL SELECT doc_id, CAST(page AS INT), 'foot', 1, 272, 842 - 36 - fh + 2 FROM e WHERE fh > 0"""


@query(PAGING_SQL)
def page_bands(spark, sf):
    """Documents' lines flowing down pages with heads of several heights, some of which push the body, and feet."""
    docs, d = dealt(spark, sf), F.col("doc_id")
    lit = lambda v: F.lit(float(v))
    head, foot = F.when(d % 3 == 0, 0.0).otherwise(lit(20) * (d % 5)), F.when(d % 2 == 0, 14.0).otherwise(0.0)
    box = Y.content_box(lit(595), lit(842), {"left": lit(72), "right": lit(72), "top": lit(72), "bottom": lit(72)}, head, foot, lit(36), lit(36))
    sections = docs.select("doc_id", lit(842).alias("height"), lit(36).alias("head_at"), lit(36).alias("foot_at"), foot.alias("foot_height"), head.alias("head_height"), box.alias("body"))
    flow = text_lines(docs).select("doc_id", "seq", (F.col("x") - 72).alias("x"), (F.col("seq") * 15).cast("double").alias("top"), F.lit(15.0).alias("h"))
    columns = Y.columns_of(flow, sections, "doc_id", "top", "h")
    ops = columns.select("doc_id", "seq", (F.col("x") + F.col("column") * (595 - 144 + Y.COLUMN_GAP)).alias("x"), F.col("at").alias("y"))
    band = lambda part, seq, x, y, there: sections.where(there > 0).select("doc_id", F.lit(part).alias("part"), F.lit(seq).alias("seq"), lit(x).alias("x"), lit(y).alias("y"))
    bands = band("head", 0, 0, 0, F.col("head_height")).unionByName(band("foot", 1, 200, 2, F.col("foot_height")))
    made = Y.paginate(ops, bands, sections, "doc_id")
    return made.select("doc_id", "page", "part", "seq", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages), r AS (SELECT page_id, unnest(range(len(hs))) AS k, unnest(hs) AS src FROM h),
 n AS (SELECT page_id, k, src, CASE WHEN regexp_matches(src, '(?i)^([a-z][a-z0-9+.-]*:|//)') THEN 'blocked' ELSE 'file' END AS kind, string_split(src, '/')[-1] AS name FROM r),
 f AS (SELECT page_id, CASE k % 4 WHEN 1 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN lower(name) ELSE name END AS name, 'f/' || k AS path FROM n WHERE kind = 'file' AND k % 4 < 3),
 x AS (SELECT page_id, name, min(path) AS p FROM f GROUP BY ALL), l AS (SELECT page_id, lower(name) AS name, min(path) AS p FROM f GROUP BY ALL)
 SELECT n.page_id, k, kind, CASE WHEN kind = 'file' THEN coalesce(x.p, l.p) END AS path FROM n LEFT JOIN x ON x.page_id = n.page_id AND x.name = n.name LEFT JOIN l ON l.page_id = n.page_id AND l.name = lower(n.name)""")
def named_files(spark, sf):
    """What pages refer to, found among their files: by name, or else by name in lower case."""
    found = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "src"))
    rows = found.select("page_id", F.col("k").cast("long").alias("k"), I.image_reference(F.col("src")).alias("r")).select("page_id", "k", "r.kind", "r.name")
    case, name = F.col("k") % 4, F.col("name")
    files = rows.where((F.col("kind") == "file") & (case < 3)).select("page_id", F.when(case == 1, F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(case == 2, F.lower(name)).otherwise(name).alias("name"), F.concat(F.lit("f/"), F.col("k").cast("string")).alias("path"))
    return J.named_file(rows, files, ["page_id"], "name", "path").select("page_id", "k", "kind", "path")


_IMAGE_EXT = "('jpg','jpeg','png','webp','gif','bmp','avif','svg')"


@query(f"""WITH f AS (SELECT l_orderkey, ['a.PDF','b.docx','n.md','p.png','q.heic','README','x.y.Txt','v.svg','data','m.markdown','t.tiff','w.jpeg'][CAST((l_partkey * l_suppkey + l_linenumber) % 12 AS INT) + 1] AS name, ['','application/pdf','image/webp','text/plain','text/markdown','audio/ogg',''][CAST(l_suppkey % 7 AS INT) + 1] AS media FROM lineitem),
 e AS (SELECT *, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext, starts_with(media, 'image/') AS im FROM f),
 c AS (SELECT l_orderkey, count(*) FILTER (ext = 'pdf' OR media = 'application/pdf') AS pdf, count(*) FILTER (ext = 'docx') AS word, count(*) FILTER (ext IN {_IMAGE_EXT} OR im) AS img, count(*) FILTER (ext IN {_IMAGE_EXT} OR im OR ext IN ('heic','heif','tif','tiff','ico')) AS more,
   CASE WHEN count(*) FILTER (ext IN ('md','markdown','txt') OR media = 'text/markdown') > 0 THEN count(*) FILTER (ext IN ('md','markdown','txt') OR media IN ('text/markdown','text/plain') OR ext IN {_IMAGE_EXT} OR im) ELSE 0 END AS md FROM e GROUP BY 1)
 SELECT l_orderkey, greatest(pdf, word, md, img, more) AS votes, CASE greatest(pdf, word, md, img, more) WHEN 0 THEN NULL WHEN pdf THEN 'pdf-to-word' WHEN word THEN 'word-to-pdf' WHEN md THEN 'markdown-to-pdf' WHEN img THEN 'images-to-pdf' ELSE 'compress-images' END AS tool FROM c""")
def route_files(spark, sf):
    """Lines of an order as a batch of files: the tool that most of them are for."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    name = pick(["a.PDF", "b.docx", "n.md", "p.png", "q.heic", "README", "x.y.Txt", "v.svg", "data", "m.markdown", "t.tiff", "w.jpeg"], (F.col("l_partkey") * F.col("l_suppkey") + F.col("l_linenumber")) % 12)
    media = pick(["", "application/pdf", "image/webp", "text/plain", "text/markdown", "audio/ogg", ""], F.col("l_suppkey") % 7)
    return Z.route(table(spark, sf, "lineitem").select("l_orderkey", name.alias("name"), media.alias("media")), ["l_orderkey"])


@query(f"""WITH {BOXES_SQL}, i AS (SELECT id, page, x, y, CASE WHEN id % 10 = 0 THEN 560.0::DOUBLE ELSE w END AS w, CASE WHEN id % 10 = 0 THEN 800.0::DOUBLE ELSE h END AS h, id % 7 <> 3 AS stored, page % 2 = 0 AS scan FROM bx WHERE id % 3 <> 0),
 t AS (SELECT page, x, y, w * 8 AS w, h * 30 AS h FROM bx WHERE id % 3 = 0)
 SELECT id, page FROM i WHERE stored AND w >= 12 AND h >= 12 AND NOT (scan AND w > 595 * 0.85::DOUBLE AND h > 842 * 0.85::DOUBLE) AND (scan OR NOT EXISTS (SELECT 1 FROM t WHERE t.page = i.page AND i.x >= t.x - 2 AND i.y >= t.y - 2 AND i.x + i.w <= t.x + t.w + 2 AND i.y + i.h <= t.y + t.h + 2))""")
def image_blocks(spark, sf):
    boxes, k = _boxes(spark, sf), F.col("id")
    large = k % 10 == 0
    images = boxes.where(k % 3 != 0).withColumn("w", F.when(large, 560.0).otherwise(F.col("w"))).withColumn("h", F.when(large, 800.0).otherwise(F.col("h")))
    images = images.select("*", (k % 7 != 3).alias("stored"), (F.col("page") % 2 == 0).alias("scan"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    tables = boxes.where(k % 3 == 0).select("page", "x", "y", (F.col("w") * 8).alias("w"), (F.col("h") * 30).alias("h"))
    return J.image_blocks(images, tables, ["page"]).select("id", "page")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE round(CASE WHEN l_linenumber % 3 = 1 THEN (l_partkey % 101) / 100.0::DOUBLE ELSE (l_partkey % 256) / 255.0::DOUBLE END, 9) END AS red, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE round((l_suppkey % 256) / 255.0::DOUBLE, 9) END AS green FROM lineitem""")
def colors(spark, sf):
    """Colours as styles have them, with shares, bytes, and some all but transparent."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), (F.col("l_suppkey") % 256).cast("string")
    red = F.when(n % 3 == 1, F.concat((p % 101).cast("string"), F.lit("%"))).otherwise((p % 256).cast("string"))
    style = F.concat(F.lit("rgba("), red, F.lit(", "), s, F.lit(", 7"), F.when(n % 5 == 0, ", 0.01").when(n % 2 == 0, ", .5").otherwise(""), F.lit(")"))
    made = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", K.color(style).alias("c"))
    return made.select("l_orderkey", "l_linenumber", F.round("c.r", 9).alias("red"), F.round("c.g", 9).alias("green"))


FIELDS_SQL = """WITH f AS (SELECT doc_id % 50 AS book, doc_id AS page, 'Report ' || (2020 + doc_id % 50 % 3) || ' - ' || (doc_id // 50 + 1) || ' -' AS text FROM documents),
 d AS (SELECT *, regexp_extract_all(text, '[0-9]{1,4}') AS ns FROM f), e AS (SELECT book, page, len(ns) AS k, unnest(range(len(ns))) AS pos, unnest(ns) AS v FROM d),
 v AS (SELECT book, k, pos, count(DISTINCT v) > 1 AS flagged FROM e GROUP BY book, k, pos), o AS (SELECT book, count(*) AS pages FROM f GROUP BY book)
 SELECT e.book, e.page, e.pos AS position, e.v AS value, CASE WHEN o.pages = 1 THEN false ELSE v.flagged END AS is_page_number FROM e JOIN v USING (book, k, pos) JOIN o USING (book)"""


@query(FIELDS_SQL)
def page_number_fields(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("Report "), (F.lit(2020) + d % 50 % 3).cast("string"), F.lit(" - "), (F.floor(d / 50) + 1).cast("string"), F.lit(" -"))
    return S.page_numbers(table(spark, sf, "documents").select((d % 50).alias("book"), d.alias("page"), text.alias("text")), "book", "page")


@query()
def markdown_documents(spark, sf):
    return M.documents(_blocks(spark, sf))


@query(REPORT_SQL + """SELECT doc_id, '{"version":1,"blocks":[' || string_agg('{"page_index":' || page_index || ',"block":' || block || ',"kind":"' || CASE WHEN marked AND lines <= 6 THEN 'list-item' ELSE 'paragraph' END || '"}', ',' ORDER BY page_index, block) || ']}' AS manifest FROM k GROUP BY doc_id""")
def markdown_manifest(spark, sf):
    return M.manifest(_blocks(spark, sf))


@query()
def html_to_markdown(spark, sf):
    return pages_to_markdown(table(spark, sf, "pages")).select("page_id", "markdown", "removed")


@query()
def text_pdf(spark, sf):
    return text_documents(text_lines(dealt(spark, sf)))


@query()
def crc_manifest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.crc32(F.col("text").cast("binary")).alias("crc32"))


@query()
def zip_archives(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.floor(F.col("doc_id") / 100).alias("bundle"), F.concat("lang", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"))
    return archives(files, "bundle")


@query("""WITH c AS (SELECT doc_id, n_chars % 90 AS chars, (doc_id * 7 % 100) / 100.0::DOUBLE AS cov, doc_id % 11 = 0 AS susp, doc_id % 5 = 0 AS deco FROM documents)
 SELECT doc_id, (chars = 0 AND cov > 0.1::DOUBLE) OR (chars < 24 AND cov > 0.35::DOUBLE) OR (cov > 0.6::DOUBLE AND chars < 300 AND deco) OR susp AS recognize FROM c""")
def should_recognize(spark, sf):
    d = F.col("doc_id")
    made = O.should_recognize("auto", F.col("n_chars") % 90, (d * 7 % 100) / F.lit(100.0), d % 11 == 0, d % 5 == 0)
    return table(spark, sf, "documents").select("doc_id", made.alias("recognize"))


@query("""WITH l AS (SELECT doc_id, list_sort(list_filter(list_transform(string_split(text, ' '), lambda w: length(w)), lambda n: n > 0)) AS ls FROM documents)
 SELECT doc_id, coalesce(list_sum(ls), 0) < 40 OR (list_sum(ls) < 300 AND ls[len(ls) // 2 + 1] <= 6) AS sparse FROM l""")
def sparse_pages(spark, sf):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    return table(spark, sf, "documents").select("doc_id", O.sparse(lengths).alias("sparse"))


@query(f"""WITH {SIZE_SQL} SELECT p_partkey, CASE WHEN w <= 1584 AND h <= 1584 THEN w WHEN h > 1584 AND (w <= 595.28::DOUBLE * 1.05::DOUBLE OR h / w::DOUBLE > 2) THEN 595.28::DOUBLE ELSE round(w * (1584.0::DOUBLE / greatest(w, h)), 6) END::DOUBLE AS width, NOT (w <= 1584 AND h <= 1584) AS clamped FROM t""")
def word_pages(spark, sf):
    made = _sizes(spark, sf).select("p_partkey", O.word_page(F.col("w"), F.col("h")).alias("p"))
    return made.select("p_partkey", rounded(F.col("p.width")).alias("width"), "p.clamped")


@query("""WITH t AS (SELECT p_partkey, CAST(p_size * 130 AS DOUBLE) AS h FROM part), s AS (SELECT p_partkey, h, unnest(CASE WHEN h <= 1080 THEN [0] ELSE range(0, CAST(ceil((h - 720) / 690.0::DOUBLE) AS BIGINT) * 690 + 1, 690) END) AS top FROM t)
 SELECT p_partkey, CAST(top AS DOUBLE) AS top, CASE WHEN h <= 1080 THEN h ELSE least(720, h - top) END AS height FROM s""")
def page_strips(spark, sf):
    cut = table(spark, sf, "part").select("p_partkey", F.explode(O.strips((F.col("p_size") * 130).cast("double"))).alias("s"))
    return cut.select("p_partkey", "s.top", "s.height")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'cancelled' WHEN event_id % 5 = 1 THEN 'password-required' WHEN event_id % 5 = 2 THEN 'invalid-pdf' WHEN event_id % 5 = 3 THEN 'out-of-memory' ELSE 'unknown' END AS code,
 CASE WHEN event_id * 977 // 3600000 > 0 THEN CAST(event_id * 977 // 3600000 AS VARCHAR) || ':' || lpad(CAST(event_id * 977 // 60000 % 60 AS VARCHAR), 2, '0') ELSE CAST(event_id * 977 // 60000 AS VARCHAR) END || ':' || lpad(CAST(event_id * 977 // 1000 % 60 AS VARCHAR), 2, '0') AS clock FROM events""")
def error_codes(spark, sf):
    k = F.col("event_id")
    name = F.when(k % 5 == 0, "CancelledError").when(k % 5 == 1, "PasswordException").otherwise("Error")
    message = F.when(k % 5 == 2, "Invalid PDF structure").when(k % 5 == 3, "WASM memory: Out of memory").otherwise("No password given")
    return table(spark, sf, "events").select("event_id", D.error_code(name, message, F.lit(False)).alias("code"), D.clock(k * 977).alias("clock"))


@query("""WITH f AS (SELECT p_partkey, ['SimSun','ABCDEE+Arial-Bold','KaiTi','Georgia','Foo','Courier New'][p_partkey % 6 + 1] AS n, ['serif','sans-serif','monospace'][p_partkey % 3 + 1] AS fam FROM part)
 SELECT p_partkey, CASE n WHEN 'SimSun' THEN 'Times New Roman' WHEN 'ABCDEE+Arial-Bold' THEN 'Arial' WHEN 'KaiTi' THEN 'Times New Roman' WHEN 'Georgia' THEN 'Times New Roman' WHEN 'Courier New' THEN 'Consolas'
  ELSE CASE fam WHEN 'monospace' THEN 'Consolas' WHEN 'serif' THEN 'Times New Roman' ELSE 'Arial' END END AS latin, regexp_replace(n, '^[A-Z]{6}\\+', '') AS clean FROM f""".replace("\\\\+", "\\+"))
def font_names(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    name, family = pick(["SimSun", "ABCDEE+Arial-Bold", "KaiTi", "Georgia", "Foo", "Courier New"], F.col("p_partkey") % 6), pick(["serif", "sans-serif", "monospace"], F.col("p_partkey") % 3)
    return table(spark, sf, "part").select("p_partkey", D.font(name, family)["latin"].alias("latin"), D.clean_font_name(name).alias("clean"))


@query()
def palette(spark, sf):
    """Vectors as colours: the first four dimensions of each label's vectors cut to 16 colours and refined."""
    return P.palettes(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 16)


@query()
def ruled_tables(spark, sf):
    """A grid of regions by nations' first letters, drawn as rules and spans on a page for each region."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit(0).alias("page_index"), "n_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("k"))
    spans = n.select("doc_id", "page_index", F.col("n_name").alias("text"), (F.lit(110.0) + (F.col("k") - 1) % 2 * 100).alias("x"), (F.lit(110.0) + F.floor((F.col("k") - 1) / 2) * 30).alias("y"), F.lit(40.0).alias("w"), F.lit(10.0).alias("h"), (F.lit(118.0) + F.floor((F.col("k") - 1) / 2) * 30).alias("baseline"))
    pages = n.select("doc_id", "page_index").distinct()
    rule = lambda o, p, a, b: F.struct(F.lit(o).alias("orientation"), F.lit(float(p)).alias("position"), F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(False).alias("raster"))
    drawn = F.array(*[rule("horizontal", y, 100, 300) for y in (100, 130, 160, 190)], *[rule("vertical", x, 100, 190) for x in (100, 200, 300)])
    return ruled(pages.select("doc_id", "page_index", F.explode(drawn).alias("r")).select("doc_id", "page_index", "r.*"), spans)
