"""Queries over the driver's tables, one or more for each group of operators, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline import cases, streaming
from sheafline.functions import encoding
from sheafline.functions import text as X
from sheafline.functions import time as CLOCK
from sheafline.operators import archive, chat, detect, document, grid, image, media, pdf_items, structured, subtitle
from sheafline.plans import registry
from sheafline.sources import chat_exports, workbook

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# conversations ------------------------------------------------------------------------------------------------------------

MESSAGES = """m AS (
  SELECT conv_id AS conv, turn AS msg, lower(trim(role)) AS role, coalesce(text, '') AS text FROM conversations
)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def chat_plain_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = chat.drop_system(_messages(spark, sf_dir))
    got = said.groupBy("conv").agg(F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY msg)").alias("transcript"))
    return got.select(F.col("conv").alias("conv_id"), "transcript")


@query("SELECT conv_id AS conv, turn AS msg, text FROM conversations WHERE role = 'user'")
def chat_role_filter_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.keep_role(_messages(spark, sf_dir), "user").select("conv", "msg", "text")


@query("SELECT conv_id AS conv, turn AS msg, text FROM conversations WHERE role = 'assistant'")
def chat_role_filter_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.keep_role(_messages(spark, sf_dir), "assistant").select("conv", "msg", "text")


@query("SELECT conv_id AS conv FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0")
def chat_emptied_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return chat.emptied(m, chat.keep_role(m, "system"))


@query(
    """SELECT conv_id AS conv, count(*)::BIGINT AS n_messages, count(*) FILTER (role = 'user')::BIGINT AS n_user, count(*) FILTER (role = 'assistant')::BIGINT AS n_assistant,
    count(*) FILTER (role = 'system')::BIGINT AS n_system, count(*) FILTER (role NOT IN ('user', 'assistant', 'system'))::BIGINT AS n_other,
    arg_min(left(text, 120), turn) FILTER (trim(text) <> '') AS preview FROM conversations GROUP BY conv_id"""
)
def chat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.conversations(_messages(spark, sf_dir))
    return got.select("conv", "n_messages", "n_user", "n_assistant", "n_system", "n_other", "preview")


@query("SELECT count(DISTINCT conv_id)::BIGINT AS n_conversations, count(*)::BIGINT AS n_messages FROM conversations")
def chat_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.overview(_messages(spark, sf_dir)).select("n_conversations", "n_messages")


@query(
    f"WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY msg) AS index, dense_rank() OVER (ORDER BY conv) AS pos FROM m) "
    """SELECT conv, msg, '{"conversation":' || pos || ',"title":"","index":' || index || ',"role":"' || role || '","time":"","text":' || to_json(text) || '}' AS line FROM n WHERE trim(text) <> ''"""
)
def chat_jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return chat.jsonl_rows(m.join(chat.in_order(chat.conversations(m)).select("conv", "conv_pos"), "conv"))


QUOTE = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"
LABEL = "CASE role WHEN 'user' THEN '我' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN '系统' WHEN 'tool' THEN '工具' ELSE role END"


@query(
    f"""WITH {MESSAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY msg) AS index FROM m)
    SELECT conv, msg, ',' || index || ',' || {LABEL} || ',,' || {QUOTE.format("text")} AS line FROM n WHERE trim(text) <> ''"""
)
def chat_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.csv_rows(_messages(spark, sf_dir))


@query(
    f"""WITH {MESSAGES} SELECT conv, string_agg({LABEL} || '：' || chr(10) || regexp_replace(trim(text), '(^|\\n)([^\\n])', '\\1  \\2', 'g'), chr(10) || chr(10) ORDER BY msg) AS body
    FROM m GROUP BY conv"""
)
def chat_layout_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.documents(chat.message_blocks(_messages(spark, sf_dir), "chat"))


@query(f"WITH {MESSAGES} SELECT conv, string_agg('**' || {LABEL} || '**' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY msg) AS body FROM m GROUP BY conv")
def chat_layout_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.documents(chat.message_blocks(_messages(spark, sf_dir), "transcript"))


ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    f"""WITH {MESSAGES} SELECT conv, msg, '<div class="message">' || chr(10) || '<div class="meta"><span class="role">' || {LABEL} || '</span></div>' || chr(10) || '<pre class="body">'
    || {ESCAPE.format("trim(text)")} || '</pre>' || chr(10) || '</div>' AS block FROM m WHERE trim(text) <> ''"""
)
def chat_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.message_blocks(_messages(spark, sf_dir), "html").select("conv", "msg", "block")


@query("SELECT row_number() OVER (ORDER BY turn, conv_id)::BIGINT AS pos, conv_id AS conv, turn AS msg FROM conversations")
def chat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumn("time", F.timestamp_seconds(F.col("msg") + 1))
    return chat.timeline(m).select("pos", "conv", "msg")


@query(
    """WITH s AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM s)
    SELECT conv_id AS conv, role, min(turn) AS msg, count(*)::BIGINT AS n_merged, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role"""
)
def chat_island_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.merge_adjacent(_messages(spark, sf_dir)).select("conv", "role", "msg", "n_merged", "text")


@query(
    """WITH o AS (SELECT conv_id AS conv, row_number() OVER (ORDER BY min(length(text)), conv_id)::BIGINT AS conv_pos FROM conversations GROUP BY conv_id)
    SELECT conv, conv_pos FROM o WHERE conv_pos IN (1, 3, 7, 20)"""
)
def chat_select_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumn("time", F.timestamp_seconds(F.length("text")))
    return chat.select_conversations(chat.in_order(chat.conversations(m)), [1, 3, 7, 20, 1_000_000_000])[0].select("conv", "conv_pos")


# text -----------------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, length(text)::BIGINT AS chars, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '\r\n|\r|\n')) + 1 END::BIGINT AS lines,
    len(regexp_extract_all(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]'))::BIGINT AS cjk, len(regexp_extract_all(text, '[A-Za-z0-9_''’-]+'))::BIGINT AS words FROM documents"""
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in X.text_stats("text").items()))


_GARBLED = r"""len(regexp_extract_all(left(text, 4000), '\x{FFFD}'))::BIGINT AS replaced,
    len(regexp_extract_all(left(text, 4000), '[ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß][\x{80}-\x{FF}]'))::BIGINT AS mojibake, len(regexp_extract_all(left(text, 4000), '[\x{E000}-\x{F8FF}]'))::BIGINT AS private,
    len(regexp_extract_all(left(text, 4000), '[\x{3000}-\x{303F}\x{3100}-\x{312F}\x{31C0}-\x{31EF}]'))::BIGINT AS rare, greatest(1, least(length(text), 4000)) AS n"""


@query(
    f"""WITH g AS (SELECT doc_id, {_GARBLED} FROM documents UNION ALL
    SELECT -doc_id - 1, {_GARBLED} FROM (SELECT doc_id, repeat(CASE doc_id % 4 WHEN 0 THEN 'Ð¿Ñ' WHEN 1 THEN chr(65533) WHEN 2 THEN '、。' ELSE chr(57345) END, 20) || left(text, 300) AS text FROM documents))
    SELECT doc_id, replaced, mojibake, private, rare, (replaced / n > 0.02 OR mojibake / n > 0.05 OR private / n > 0.02 OR rare / n > 0.3) AS garbled FROM g"""
)
def garbled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and beside it one damaged in one of four ways."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = F.element_at(F.array(*(F.lit(x) for x in ("Ð¿Ñ", "�", "、。", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = d.union(d.select(-F.col("doc_id") - 1, F.concat(F.repeat(bad, F.lit(20)), F.substring("text", 1, 300))))
    m = X.garbled_measures("text")
    return d.select("doc_id", *(m[k].alias(k) for k in ("replaced", "mojibake", "private", "rare")), X.looks_garbled("text").alias("garbled"))


@query(f"SELECT doc_id, {QUOTE.format('text')} AS cell FROM documents")
def csv_quote_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.csv_quote("text").alias("cell"))


@query(f"SELECT p_partkey, p_partkey || ',' || {QUOTE.format('p_name')} || ',' || {QUOTE.format('p_brand')} || ',' || {QUOTE.format('p_type')} AS line FROM part")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.csv_line(F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type").alias("line"))


@query("SELECT p_partkey, '| ' || rpad(p_name, 40, ' ') || ' |' AS line, length(p_name)::INT AS width FROM part")
def display_width_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("| "), X.pad_display("p_name", F.lit(40)), F.lit(" |"))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), X.display_width("p_name").alias("width"))


@query(
    """WITH d AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.MD' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' ELSE '.' END AS path FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'gz' ELSE '' END AS ext, doc_id || CASE WHEN doc_id % 4 = 1 THEN '.tar' ELSE '' END AS base FROM d"""
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 4 == 0, ".MD").when(F.col("doc_id") % 4 == 1, ".tar.gz").when(F.col("doc_id") % 4 == 2, "").otherwise(".")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), tail).alias("path"))
    return d.select("doc_id", X.ext_of("path").alias("ext"), X.base_name("path").alias("base"))


@query(
    r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^\\/]*)$', 1), '^.+\.([^.]+)$', 1)) AS ext,
    CASE WHEN regexp_matches(regexp_extract(url, '([^\\/]*)$', 1), '^.+\.[^.]*$') THEN regexp_replace(regexp_extract(url, '([^\\/]*)$', 1), '\.[^.]*$', '') ELSE regexp_extract(url, '([^\\/]*)$', 1) END AS base FROM pages"""
)
def url_base_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.ext_of("url").alias("ext"), X.base_name("url").alias("base"))


@query(
    r"""WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g')) AS n FROM pages), t AS (SELECT page_id, regexp_replace(regexp_replace(n, '^\.+', ''), '\.+$', '') AS n FROM c)
    SELECT page_id, CASE WHEN n = '' THEN 'untitled' ELSE n END AS name FROM t"""
)
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.safe_file_name("url").alias("name"))


@query(
    """WITH n AS (SELECT doc_id, source || '.txt' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
    SELECT doc_id, CASE WHEN k = 0 THEN name ELSE replace(name, '.txt', '') || '-' || k || '.txt' END AS unique_name FROM n"""
)
def unique_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"))
    return archive.unique_names(d, "name", "doc_id").select("doc_id", "unique_name")


@query(
    """SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE CASE WHEN n / 1024.0 >= 100 THEN format('{:.0f}', round((n / 1024.0)::DOUBLE, 0)) ELSE format('{:.1f}', round((n / 1024.0)::DOUBLE, 1)) END || ' KB' END AS size
    FROM (SELECT doc_id, strlen(text) AS n FROM documents)"""
)
def file_sizes_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.format_bytes(F.octet_length("text")).alias("size"))


@query(
    r"""WITH v AS (SELECT p_partkey, unnest([p_partkey::VARCHAR, '00' || p_partkey, p_size || '.50', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'null' END, p_brand]) AS cell, unnest([1, 2, 3, 4, 5]) AS pos FROM part)
    SELECT p_partkey, pos, CASE WHEN cell IN ('true', 'false') THEN 'boolean' WHEN cell = 'null' THEN 'null' WHEN regexp_matches(cell, '^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$') THEN 'number' ELSE 'string' END AS kind,
    CASE WHEN cell IN ('true', 'false', 'null') OR regexp_matches(cell, '^-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$') THEN cell ELSE to_json(cell)::VARCHAR END AS json FROM v"""
)
def coerce_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = F.array(
        F.col("p_partkey").cast("string"), F.concat(F.lit("00"), F.col("p_partkey").cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(".50")), F.when(F.col("p_size") % 2 == 0, "true").otherwise("null"), F.col("p_brand")
    )
    v = p.select("p_partkey", F.posexplode(cells).alias("at", "cell"))
    return v.select("p_partkey", (F.col("at") + 1).alias("pos"), X.scalar_kind("cell").alias("kind"), X.json_scalar("cell").alias("json"))


# grids ------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT n_nationkey::VARCHAR AS a, n_name AS b, n_regionkey::VARCHAR AS c, n_nationkey AS o FROM nation), h AS (SELECT 'n_nationkey' AS a, 'n_name' AS b, 'n_regionkey' AS c, -1 AS o UNION ALL SELECT * FROM c),
    w AS (SELECT greatest(3, max(length(a))) AS wa, greatest(3, max(length(b))) AS wb, greatest(3, max(length(c))) AS wc FROM h), r AS (SELECT *, row_number() OVER (ORDER BY o) AS n FROM h)
    SELECT n::DOUBLE AS row_pos, '| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' | ' || rpad(c, wc::INT, ' ') || ' |' AS line FROM r, w
    UNION ALL SELECT 1.5, '|' || repeat('-', wa::INT + 2) || '|' || repeat('-', wb::INT + 2) || '|' || repeat('-', wc::INT + 2) || '|' FROM w"""
)
def md_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.markdown_lines(grid.from_table(table(spark, sf_dir, "nation"), "n_nationkey"))


@query(
    f"""WITH h AS (SELECT 'r_regionkey' AS a, 'r_name' AS b, -1 AS o UNION ALL SELECT r_regionkey::VARCHAR, r_name, r_regionkey FROM region), r AS (SELECT *, row_number() OVER (ORDER BY o)::INT AS row_pos FROM h)
    SELECT row_pos, CASE WHEN row_pos = 1 THEN '<tr><th style="{grid.HEAD_STYLE}">' || a || '</th><th style="{grid.HEAD_STYLE}">' || b || '</th></tr>'
    ELSE '<tr><td style="{grid.CELL_STYLE}">' || a || '</td><td style="{grid.CELL_STYLE}">' || b || '</td></tr>' END AS line FROM r"""
)
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.html_rows(grid.from_table(table(spark, sf_dir, "region"), "r_regionkey"))


@query("""SELECT (n_nationkey + 2)::INT AS row_pos, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS record FROM nation""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.json_records(grid.from_table(table(spark, sf_dir, "nation"), "n_nationkey"))


@query("""SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":' || to_json(s_name) || ',"s_nationkey":' || s_nationkey || '}' AS line FROM supplier""")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("line"))


@query(
    """WITH h AS (SELECT p_size AS tab, p_type AS header, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey)::INT AS pos FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY tab, header ORDER BY pos) AS k FROM h) SELECT tab, pos, header, CASE WHEN k = 1 THEN header ELSE header || '_' || k END AS name FROM n"""
)
def header_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("tab")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda s: s["p_type"]).alias("cells"))
    return grid.headers(heads.withColumn("row_pos", F.lit(1)), "tab").select("tab", "pos", "header", "name")


# HTML -------------------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_title("html").alias("title"))


_NOISE = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
for _t in X.NOISE_TAGS.split("|"):
    _NOISE = f"regexp_replace({_NOISE}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"


@query(f"SELECT page_id, {_NOISE} AS html FROM pages")
def html_noise_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_noise_html("html").alias("html"))


_TEXT = "html"
for _p, _by in X.HTML_TO_TEXT:
    _TEXT = f"""regexp_replace({_TEXT}, '{_p.replace("'", "''")}', {"'" + _by.replace("$1", chr(92) + "1") + "'"}, 'g')"""
for _ref, _ch in X.ENTITIES:
    _TEXT = f"""replace({_TEXT}, '{_ref}', '{_ch.replace("'", "''")}')"""
_TEXT = f"regexp_replace(regexp_replace(regexp_replace({_TEXT}, '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text("html").alias("text"))


@query(f"SELECT doc_id, {ESCAPE.format('text')} AS escaped FROM documents")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.html_escape("text").alias("escaped"))


# cues -----------------------------------------------------------------------------------------------------------------------------

CUES = """e AS (SELECT event_id, (epoch_us(ts) // 1000) % 86400000 AS start_ms, event_type AS text FROM events),
c AS (SELECT (event_id + 1)::INT AS idx, start_ms::BIGINT AS start_ms, (start_ms + 500 + event_id % 3000)::BIGINT AS end_ms, text FROM e)"""


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) % 86400000).alias("start_ms"), F.col("event_type").alias("text"))
    return e.select((F.col("event_id") + 1).cast("int").alias("idx"), "start_ms", (F.col("start_ms") + 500 + F.col("event_id") % 3000).alias("end_ms"), "text", F.lit("Default").alias("style"))


def _clock_sql(ms: str, sep: str) -> str:
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || '{sep}' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


@query(f"WITH {CUES} SELECT idx, idx || chr(13) || chr(10) || {_clock_sql('start_ms', ',')} || ' --> ' || {_clock_sql('end_ms', ',')} || chr(13) || chr(10) || text AS block FROM c")
def cue_render_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle.cue_blocks(_cues(spark, sf_dir), "srt").select("idx", "block")


@query(f"WITH {CUES} SELECT idx, {_clock_sql('start_ms', '.')} || ' --> ' || {_clock_sql('end_ms', '.')} || chr(10) || text AS block FROM c")
def cue_render_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle.cue_blocks(_cues(spark, sf_dir), "vtt").select("idx", "block")


def _ass_sql(ms: str) -> str:
    return f"({ms} // 3600000) || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(({ms} // 10 % 100)::VARCHAR, 2, '0')"


@query(f"WITH {CUES} SELECT idx, 'Dialogue: 0,' || {_ass_sql('start_ms')} || ',' || {_ass_sql('end_ms')} || ',Default,,0,0,0,,' || text AS block FROM c")
def cue_render_ass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle.cue_blocks(_cues(spark, sf_dir), "ass").select("idx", "block")


@query(
    f"""WITH {CUES} SELECT idx, greatest(0, start_ms - 40000000)::BIGINT AS start_ms, greatest(0, end_ms - 40000000, greatest(0, start_ms - 40000000))::BIGINT AS end_ms,
    start_ms < 40000000 OR end_ms < 40000000 AS clamped FROM c"""
)
def cue_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle.shift(_cues(spark, sf_dir), -40000.0).select("idx", "start_ms", "end_ms", "clamped")


@query(
    f"""WITH {CUES}, k AS (SELECT idx, start_ms // 60000 * 60000 AS start_ms, text FROM c), f AS (SELECT start_ms, text, min(idx) AS first FROM k GROUP BY start_ms, text),
    g AS (SELECT start_ms, string_agg(text, chr(10) ORDER BY first) AS text, min(first) AS first FROM f GROUP BY start_ms), n AS (SELECT start_ms, count(*)::BIGINT AS n_merged FROM k GROUP BY start_ms)
    SELECT row_number() OVER (ORDER BY first)::INT AS idx, start_ms::BIGINT AS start_ms, text, n_merged FROM g JOIN n USING (start_ms)"""
)
def cue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(F.col("start_ms") / 60000).cast("long") * 60000
    c = _cues(spark, sf_dir).withColumn("start_ms", minute).withColumn("end_ms", F.col("start_ms") + 60000)
    return subtitle.merge_same_times(c).select("idx", "start_ms", "text", "n_merged")


@query("WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) SELECT user_id, (event_id + 1)::INT AS idx, event_type AS text FROM l WHERE last IS NULL OR last <> event_type")
def cue_dedup_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") + 1).cast("int").alias("idx"), F.col("event_type").alias("text"))
    return subtitle.drop_repeats(e, "user_id").select("user_id", "idx", "text")


@query(f"WITH {CUES} SELECT idx, start_ms, end_ms FROM c")
def timecode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cues(spark, sf_dir).select("idx", CLOCK.clock("start_ms", ",").alias("a"), CLOCK.clock("end_ms", ".").alias("b"))
    return c.select("idx", CLOCK.parse_timecode("a").alias("start_ms"), CLOCK.parse_timecode("b").alias("end_ms"))


@query(f"WITH {CUES}, u AS (SELECT c.*, event_id, user_id FROM c JOIN events ON idx = event_id + 1) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY idx)::INT AS idx, start_ms, end_ms, text FROM u")
def srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select((F.col("event_id") + 1).cast("int").alias("idx"), "user_id")
    c = _cues(spark, sf_dir).join(users, "idx")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("idx")).cast("int")
    files = subtitle.render(c.withColumn("idx", nth), "srt", "user_id")
    return subtitle.read_srt_vtt(files, "user_id", text="body").select("user_id", "idx", "start_ms", "end_ms", "text")


# structured values ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, 1::INT AS path_pos, 'k' AS path, json_extract_string(props, '$.k') AS leaf FROM events")
def kv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.paths(table(spark, sf_dir, "events").select("event_id", "props"), "props", ["event_id"]).select("event_id", "path_pos", "path", "leaf")


@query("SELECT event_id, 'k = ' || json_extract_string(props, '$.k') || chr(10) AS output FROM events")
def kv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.write(table(spark, sf_dir, "events").select("event_id", "props"), "kv", "props").select("event_id", "output")


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '","user":{"id":' || user_id || '}}' AS json FROM events""")
def yaml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "yaml")


@query(ORACLES["yaml_round_trip"])
def xml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "xml")


@query(ORACLES["yaml_round_trip"])
def ini_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "ini")


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    value = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"type":"'), F.col("event_type"), F.lit('","user":{"id":'), F.col("user_id").cast("string"), F.lit("}}"))
    wrote = structured.write(table(spark, sf_dir, "events").select("event_id", value.alias("value")), kind, "value").select("event_id", "output")
    return structured.read(wrote, kind, "output").select("event_id", "json")


@query("SELECT c_mktsegment, string_agg(c_custkey || ' = ' || c_name, chr(10) ORDER BY c_custkey) AS section FROM customer GROUP BY c_mktsegment")
def ini_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("line", F.concat(F.col("c_custkey").cast("string"), F.lit(" = "), F.col("c_name")))
    return c.groupBy("c_mktsegment").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY c_custkey)").alias("section"))


# detection and routing --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, 'html' AS kind FROM pages")
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", detect.text_format("html").alias("kind"))


@query("SELECT page_id, strlen(html)::BIGINT AS size, 'html' AS ext, 'text' AS family, 'utf-8' AS encoding, 'txt' AS default_target FROM pages")
def analyze_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.concat(F.col("page_id").cast("string"), F.lit(".htm")).alias("name"))
    return detect.analyze(p).select("page_id", "size", "ext", "family", "encoding", "default_target")


@query(cases.MATRIX_SQL)
def registry_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.matrix(spark)


# encodings, archives, documents ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text AS back, 0::BIGINT AS n_lost, 'utf-16le' AS encoding FROM documents")
def encoding_roundtrip_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encoding.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "utf-16le")
    return encoding.with_encoding(made.select("doc_id", "n_lost", "content")).select("doc_id", F.col("text").alias("back"), "n_lost", "encoding")


@query("SELECT doc_id, text AS back FROM documents")
def encoding_roundtrip_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheafline.plans.rows import map_rows

    made = encoding.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "gb18030").select("doc_id", "content")
    return map_rows(made, lambda b: (encoding.decode(b, "gb18030"),), ["content"], "back string").select("doc_id", "back")


@query(
    """SELECT n_nationkey % 5 AS box, (row_number() OVER (PARTITION BY n_nationkey % 5 ORDER BY n_nationkey))::INT AS entry_pos, lpad(n_nationkey::VARCHAR, 3, '0') || '.txt' AS entry, strlen(n_name)::BIGINT AS size, n_name AS body
    FROM nation"""
)
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("box"), F.concat(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".txt")).alias("name"), F.col("n_name").cast("binary").alias("content"))
    boxes = archive.bundles(files, "box").select("box", F.col("bundle").alias("content"), F.lit("box.zip").alias("name"))
    return archive.entries(boxes).select("box", "entry_pos", "entry", "size", F.col("bytes").cast("string").alias("body"))


@query("SELECT n_regionkey AS box, count(*)::BIGINT AS n_entries, sum(strlen(n_name))::BIGINT AS total_size, 0::BIGINT AS n_hidden FROM nation GROUP BY n_regionkey")
def zip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("box"), F.concat("n_name", F.lit(".txt")).alias("name"), F.col("n_name").cast("binary").alias("content"))
    boxes = archive.bundles(files, "box").select("box", F.col("bundle").alias("content"), F.lit("box.zip").alias("name"))
    return archive.manifest(archive.entries(boxes), "box").select("box", "n_entries", "total_size", "n_hidden")


@query("SELECT n_regionkey AS book, n_name AS cell, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS row_pos FROM nation")
def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book"), F.lit("nations").alias("sheet"), F.lit(1).alias("sheet_pos"), nth.alias("row_pos"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("cells"))
    books = workbook.write(rows, "book").select("book", "workbook")
    return workbook.read(books, "workbook").select("book", F.col("cells")[0].alias("cell"), "row_pos")


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.block_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "block_pos", "type", "depth", "block")


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return document.read(p, "html").select("page_id", "markdown", "title", "n_images")


@query("SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || n_regionkey || chr(10) AS markdown FROM nation")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\n"), F.col("n_regionkey").cast("string"), F.lit("\n"))
    made = document.write(table(spark, sf_dir, "nation").select("n_nationkey", md.alias("markdown")), "docx").select("n_nationkey", F.col("output").alias("content"))
    return document.read(made, "docx").select("n_nationkey", "markdown")


@query("SELECT conv_id AS conv, turn AS msg, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE lower(role) END AS role, text FROM conversations WHERE text <> ''")
def chat_export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").where("text <> ''")
    item = F.struct(F.col("turn"), F.col("role"), F.col("text").alias("content"))
    files = said.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("text"), F.array_sort(F.collect_list("turn")).alias("turns"))
    got = chat_exports.read(files)
    return got.select(F.col("conv_id").alias("conv"), F.col("turns")[F.col("msg_pos") - 1].alias("msg"), "role", "text")


# pictures, pages, media ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, greatest(1, floor(w * s + 0.5))::INT AS width, greatest(1, floor(h * s + 0.5))::INT AS height FROM (SELECT p_partkey, w, h, least(1.0::DOUBLE, 800.0::DOUBLE / greatest(w, h)) AS s FROM
    (SELECT p_partkey, p_size * 100 AS w, p_partkey % 3000 + 1 AS h FROM part))"""
)
def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 3000 + 1).alias("h"))
    w, h = image.plan_columns("w", "h", 800)
    return p.select("p_partkey", w.alias("width"), h.alias("height"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN list_concat(range(2, 2 + p_size % 7)::INT[], [1]::INT[]) END AS selected, CASE WHEN p_size % 7 = 0 THEN 'PDF_PAGES_INVALID' END AS error_code FROM part")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (F.col("p_size") % 7 + 1).cast("string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("2-"), last, F.lit("，1,2")).alias("pages"), F.lit(50).alias("n_pages"))
    return pdf_items.ranges(p).select("p_partkey", "selected", "error_code")


@query(
    """WITH p AS (SELECT DISTINCT p_size AS k, p_partkey % 60 AS page FROM part), i AS (SELECT *, page - row_number() OVER (PARTITION BY k ORDER BY page) AS island FROM p),
    r AS (SELECT k, island, min(page) AS a, max(page) AS b FROM i GROUP BY k, island) SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, '_' ORDER BY a) AS label FROM r GROUP BY k"""
)
def page_run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("k"), (F.col("p_partkey") % 60).alias("page"))
    return pdf_items.page_runs(p, "k")


_CRF = "'-preset', 'veryfast', '-crf', (p_size % 40 + 1)::VARCHAR, '-pix_fmt', 'yuv420p', '-c:a', 'aac', '-b:a', '192k'"


@query(
    f"""SELECT p_partkey, CASE p_partkey % 6
    WHEN 0 THEN ['-y', '-ss', p_size::VARCHAR, '-i', 'a.mp4', '-t', (100 - p_size)::VARCHAR, '-c:v', 'libx264', {_CRF}, 'o.mp4']
    WHEN 1 THEN ['-y', '-i', 'a.mp4', '-vf', 'scale=''if(gt(iw,ih),min(720,iw),-2)'':''if(gt(iw,ih),-2,min(720,ih))''', '-c:v', 'libx264', {_CRF}, 'o.mp4']
    WHEN 2 THEN ['-y', '-i', 'a.mp4', '-c:v', 'libvpx-vp9', '-crf', (p_size % 40 + 1)::VARCHAR, '-b:v', '0', '-c:a', 'libopus', '-b:a', '192k', 'o.webm']
    WHEN 3 THEN ['-y', '-i', 'a.mp4', '-filter_complex', 'fps=' || (p_size % 30 + 1) || ',scale=iw:-1:flags=lanczos,split[a][b];[a]palettegen[p];[b][p]paletteuse', '-an', 'o.gif']
    WHEN 4 THEN ['-y', '-i', 'a.mp3', '-vn', '-c:a', 'libmp3lame', '-b:a', '128k', 'o.mp3']
    ELSE ['-y', '-ss', p_size || '.5', '-i', 'a.mp4', '-frames:v', '1', '-q:v', '2', 'o.jpg'] END AS argv FROM part"""
)
def media_argv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = (("trim", "a.mp4", "o.mp4"), ("convert", "a.mp4", "o.mp4"), ("convert", "a.mp4", "o.webm"), ("convert", "a.mp4", "o.gif"), ("compress", "a.mp3", "o.mp3"), ("extractFrame", "a.mp4", "o.jpg"))
    pick = lambda i: F.element_at(F.array(*(F.lit(c[i]) for c in cases)), (F.col("p_partkey") % 6 + 1).cast("int"))
    size, case = F.col("p_size"), F.col("p_partkey") % 6
    options = {
        "trimStart": size.cast("string"), "trimEnd": F.lit("00:01:40"), "videoCrf": (size % 40 + 1).cast("string"), "gifFps": (size % 30 + 1).cast("string"),
        "frameAt": F.concat(F.lit("0:"), size.cast("string"), F.lit(".5")), "scale": F.when(case == 1, "720").otherwise("source"), "audioBitrate": F.when(case == 4, "320k").otherwise("192k"),
    }
    given = F.create_map(*(x for k, v in options.items() for x in (F.lit(k), v)))
    p = table(spark, sf_dir, "part").select("p_partkey", pick(0).alias("action"), pick(1).alias("source"), pick(2).alias("target"), given.alias("options"))
    return media.commands(p).select("p_partkey", "argv")


# event time ---------------------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_ms, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streaming.windowed(_events(spark, sf_dir), "ts", "1 hour", keys=["event_type"], n=F.count("*"))
    return got.select("event_type", F.unix_millis("window_start").alias("start_ms"), "n")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g) SELECT user_id, count(*)::BIGINT AS n, (epoch_us(min(ts)))::BIGINT AS start_us FROM s GROUP BY user_id, nth"""
)
def window_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streaming.sessions(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], n=F.count("*"))
    return got.select("user_id", "n", F.unix_micros("session_start").alias("start_us"))


QUERIES |= cases.QUERIES
ORACLES |= cases.ORACLES
