"""Registry of the queries for the reference's own operators, and their SQL.

The given tables hold no office documents. So each query runs an operator of
the document pipeline on a table that carries the shape it needs: turns of a
conversation are paragraphs, lines of an order are records or cells.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import binary as bn
from paperloom.functions import text as tx
from paperloom.operators import converting as cv
from paperloom.operators import editor as et
from paperloom.operators import edits as ed
from paperloom.operators import importing as im
from paperloom.operators import giants as gi
from paperloom.operators import lookups as lk
from paperloom.operators import rescue as rs
from paperloom.operators import sweeps as sw
from paperloom.operators import windows as wn
from paperloom.sources import containers as ct
from paperloom.sources import docx_writer as dw
from paperloom.sources import office as of
from paperloom.sources import records as rc
from paperloom.sources.work import new_folder
from paperloom.streaming import drafts as dr

# Rows of a block, that is of a task, where documents may be of any size.
GIANT_ROWS = 8_000

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL for what several queries share.
_CLEAN = r"""regexp_replace(text, '[^\P{C}\n\r\t]|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')"""
_LINES = rf"""list_filter(list_transform(regexp_split_to_array({_CLEAN}, '\r\n|\r|\n'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"""
_LINE_ROWS = f"SELECT doc_id, line, CAST(pos - 1 AS BIGINT) AS pos FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {_LINES} AS l FROM documents))"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _score(x: str, more: str = "0") -> str:
    h, a = _count(x, "[가-힣]"), _count(x, "[A-Za-z0-9]")
    return f"CASE WHEN {h} >= 2 THEN {h} * 60 + {a} * 10 + least(length({x}), 80) + {more} WHEN {a} >= 4 THEN {a} * 24 + least(length({x}), 80) + {more} ELSE 0 END"


_MORE = f"{_count('line', ' ')} * 4 + {_count('line', '[!-/:-@[-`{-~·…“”‘’]')} * 6 - length(regexp_replace(line, '[가-힣\\x21-\\x7e \\n\\t]+', '', 'g')) * 60"
_SEGMENTS = rf"""SELECT doc_id, seg, pos, {_score('seg')} AS score FROM (SELECT doc_id, trim(unnest(s), ' ' || chr(9) || chr(10)) AS seg, generate_subscripts(s, 1) AS pos
  FROM (SELECT doc_id, regexp_split_to_array(array_to_string({_LINES}, chr(10)), '[^가-힣\x21-\x7e \n\t]+') AS s FROM documents))"""


def lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.visible_lines("text")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_visible FROM documents")
def visible_paragraph_counts(spark, sf_dir):
    """F1, A1: how many lines of each document stay visible."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.visible_lines("text")).cast("long").alias("n_visible"))


@query(f"SELECT doc_id, array_to_string({_LINES}, chr(10)) AS clean FROM documents")
def strip_control_lines(spark, sf_dir):
    """T1."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_control_codes("text").alias("clean"))


@query(_LINE_ROWS)
def paragraph_explode(spark, sf_dir):
    """Lines as rows with their ordinals."""
    return lines(spark, sf_dir)


@query(f"SELECT doc_id, pos, CAST({_score('line')} AS BIGINT) AS score, CAST({_score('line', _MORE)} AS BIGINT) AS full_score, ({_score('line', _MORE)}) >= 120 AS accepted FROM ({_LINE_ROWS})")
def text_scores(spark, sf_dir):
    """T4, T5, T6."""
    line = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "pos", tx.segment_score(line).cast("long").alias("score"), tx.text_score(line).cast("long").alias("full_score"), (tx.text_score(line) >= tx.ACCEPTED).alias("accepted"))


@query(f"SELECT doc_id, seg AS best FROM ({_SEGMENTS}) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(seg) DESC, pos) = 1")
def best_text_segment(spark, sf_dir):
    """T2, T3, A7."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.meaningful_text("text").alias("best")).where("best <> ''")


@query(f"SELECT doc_id, seg AS segment, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(seg) DESC, pos) AS rank FROM ({_SEGMENTS}) WHERE score > 0) WHERE rank <= 5")
def top_segments(spark, sf_dir):
    """O1, O2: the five best segments of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(tx.ranked_segments("text"), 1, 5)).alias("k", "s"))
    return docs.select("doc_id", F.col("s.segment").alias("segment"), (-F.col("s.score")).cast("long").alias("score"), (F.col("k") + 1).cast("long").alias("rank"))


@query(f"SELECT doc_id, arg_max(line, {_count('line', '[A-Za-z0-9]')} * 1000000000000 + length(line) * 1000000 - pos) AS line FROM ({_LINE_ROWS}) GROUP BY doc_id")
def metadata_argmax(spark, sf_dir):
    """The line with most letters and digits, the longer and then the first on ties."""
    rank = F.struct(tx.count_of("line", tx.ASCII_WORD), F.length("line"), -F.col("pos"))
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.max_by("line", rank).alias("line"))


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text_decoded FROM (SELECT doc_id, line, min(pos) AS pos FROM ({_LINE_ROWS}) GROUP BY doc_id, line) GROUP BY doc_id")
def dedup_join_text(spark, sf_dir):
    """A2, A3."""
    return wn.joined_texts(lines(spark, sf_dir), ["doc_id"], "pos", F.col("line"))


@query(f"SELECT doc_id, pos, line FROM ({_LINE_ROWS}) WHERE NOT (NOT regexp_matches(line, '[가-힣]') AND (pos % 7 = 1 OR (length(line) <= 32 AND NOT regexp_matches(line, '[0-9]'))))")
def noise_filter(spark, sf_dir):
    """what stays of paragraphs before an image; every seventh line carries a control tag."""
    tags = F.array(F.when(F.col("pos") % 7 == 1, F.lit(71)).otherwise(F.lit(66)))
    control = F.array(*[F.lit(t) for t in wn.CONTROL_TAGS])
    return lines(spark, sf_dir).where(~tx.is_noise_before_image(F.col("line"), tags, control))


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS paragraph FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)")
def paragraph_islands(spark, sf_dir):
    """A user's turn opens a group."""
    return wn.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "paragraph").select("conv_id", "turn", "paragraph")


@query("SELECT conv_id, turn, CASE WHEN role <> 'system' THEN row_number() OVER (PARTITION BY conv_id, seg, role ORDER BY turn) || '.' END AS marker_text FROM (SELECT *, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM conversations)")
def list_markers(spark, sf_dir):
    """Counts by role, anew after a system turn."""
    return wn.numbered_markers(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "system", ["role"]).select("conv_id", "turn", "marker_text")


@query("SELECT conv_id, turn, substr(role, 1, 1) || row_number() OVER (PARTITION BY conv_id, substr(role, 1, 1) ORDER BY turn) AS node_id FROM conversations")
def node_ids(spark, sf_dir):
    """W11."""
    return wn.node_ids(table(spark, sf_dir, "conversations").withColumn("p", F.substring("role", 1, 1)), ["conv_id"], "p", ["turn"]).select("conv_id", "turn", "node_id")


@query("""WITH l AS (SELECT lang, doc_id, CAST(pos AS BIGINT) - 1 AS pos, strlen(line) AS n FROM (SELECT lang, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
s AS (SELECT *, sum(CASE WHEN n % 50 = 0 THEN 1 ELSE 0 END) OVER w AS seg, row_number() OVER w AS rn FROM l WINDOW w AS (PARTITION BY lang ORDER BY doc_id, pos))
SELECT lang, doc_id, pos, CAST(sum(CASE WHEN n % 5 = 0 AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY rn) AS BIGINT) AS paragraph,
  CASE WHEN n % 50 <> 0 THEN row_number() OVER (PARTITION BY lang, seg, n % 3 ORDER BY rn) || '.' END AS marker_text,
  CASE WHEN n % 2 = 0 THEN 'p' ELSE 't' END || row_number() OVER (PARTITION BY lang, n % 2 ORDER BY rn) AS node_id FROM s""")
def giant_documents(spark, sf_dir):
    """W1, W2, W11 for documents of any size: all lines of a language are one document."""
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    n = F.octet_length("line")
    rows = lines.select("lang", "doc_id", F.col("pos").cast("long").alias("pos"), (n % 5 == 0).alias("opens"), (n % 50 == 0).alias("cuts"), (n % 3).alias("num"), F.when(n % 2 == 0, "p").otherwise("t").alias("kind"))
    by, order = ["lang"], ["doc_id", "pos"]
    found = gi.islands(gi.blocked(rows, by, order, GIANT_ROWS), by, order, F.col("opens"), "paragraph")
    found = gi.node_ids(gi.numbered_markers(found, by, order, F.col("cuts"), ["num"]), by, "kind", order)
    return found.select("lang", "doc_id", "pos", "paragraph", "marker_text", "node_id")


@query("SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn <= last")
def trim_trailing_empty(spark, sf_dir):
    """turns behind the last user's count as empty."""
    return wn.trim_trailing(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") != "user").select("conv_id", "turn")


_BLOCKS = """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'table' WHEN turn % 4 = 3 THEN 'image' ELSE 'paragraph' END AS block_type, CASE WHEN turn % 5 = 1 THEN '' ELSE text END AS text, CASE WHEN turn % 4 = 2 THEN 'image_control_visible_text' ELSE 'bodytext_paragraph_records' END AS text_origin FROM conversations"""


@query(f"""WITH b AS ({_BLOCKS}),
a AS (SELECT *, max(CASE WHEN block_type <> 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS special FROM b),
c AS (SELECT * FROM a WHERE NOT (special = 1 AND block_type = 'paragraph' AND trim(text) = '')),
d AS (SELECT *, max(CASE WHEN block_type = 'paragraph' AND trim(text) <> '' AND text_origin <> 'image_control_visible_text' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS r, lead(block_type) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM c)
SELECT conv_id, turn, block_type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block_index FROM d WHERE NOT (r = 1 AND block_type = 'paragraph' AND text_origin = 'image_control_visible_text' AND coalesce(nx = 'image', false))""")
def block_cleanup(spark, sf_dir):
    """F6, W10."""
    turn = F.col("turn")
    kind = F.when(F.col("role") == "system", "table").when(turn % 4 == 3, "image").otherwise("paragraph")
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("block_type"), F.when(turn % 5 == 1, "").otherwise(F.col("text")).alias("text"), F.when(turn % 4 == 2, "image_control_visible_text").otherwise("bodytext_paragraph_records").alias("text_origin"))
    return wn.clean_blocks(blocks, ["conv_id"], ["turn"]).select("conv_id", "turn", "block_type", "block_index")


@query("""SELECT l.conv_id, l.turn, r.turn AS template_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn > 0) l
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) r USING (conv_id, role, n)""")
def ordinal_template_join(spark, sf_dir):
    """Turns but the first against all, by role."""
    turns = table(spark, sf_dir, "conversations")
    return lk.ordinal_join(turns.where("turn > 0"), turns, ["conv_id", "role"], "turn", ["turn"]).select("conv_id", "turn", "template_turn")


@query("SELECT l_orderkey, l_linenumber, w & 1023 AS tag_id, (w >> 10) & 1023 AS level, (w >> 20) & 4095 AS size FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 1024) | (CAST(l_linenumber AS BIGINT) << 10) | ((l_suppkey % 4096) << 20) AS w FROM lineitem)")
def record_header_bits(spark, sf_dir):
    """Packs and unpacks record headers."""
    word = (F.col("l_partkey") % 1024).bitwiseOR(F.shiftleft(F.col("l_linenumber").cast("long"), 10)).bitwiseOR(F.shiftleft(F.col("l_suppkey") % 4096, 20))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bn.record_header(word).alias("h")).select("l_orderkey", "l_linenumber", "h.*")


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256, substr(lower(hex(encode(html))), 1, 128) AS preview FROM pages")
def stream_metadata(spark, sf_dir):
    """K2, S9."""
    return table(spark, sf_dir, "pages").select("page_id", bn.stream_metadata(F.col("html").cast("binary")).alias("m")).select("page_id", "m.*")


@query("SELECT page_id, CAST('0x' || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS first_u16, CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) AS BIGINT) AS second_u32 FROM (SELECT page_id, hex(encode(html)) AS h FROM pages)")
def little_endian_words(spark, sf_dir):
    """B1."""
    html = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", bn.u16_at(html, 0).alias("first_u16"), bn.u32_at(html, 4).alias("second_u32"))


@query("SELECT page_id, 'data:image/png;base64,' || base64(encode(html)) AS url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def data_urls(spark, sf_dir):
    """Bytes as a data URL and back."""
    url = bn.data_url(F.lit("page.png"), F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.octet_length(bn.data_url_bytes(url)).cast("long").alias("n_bytes"))


@query(r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS leaf FROM pages")
def path_leaf(spark, sf_dir):
    """The last component."""
    return table(spark, sf_dir, "pages").select("page_id", lk.leaf(F.col("url")).alias("leaf"))


@query("""WITH w AS (SELECT DISTINCT regexp_extract(url, '([^/]*/[^/]*)$', 1) AS suffix FROM pages), u AS (SELECT DISTINCT url FROM pages),
f AS (SELECT suffix, count(url) AS matches, min(url) AS one FROM w LEFT JOIN u ON url = suffix OR ends_with(url, '/' || suffix) GROUP BY suffix)
SELECT suffix, CAST(matches AS BIGINT) AS matches, CASE WHEN matches = 1 THEN one END AS resolved FROM f""")
def suffix_resolve_unique(spark, sf_dir):
    """Resolves the last two components of each URL among all URLs."""
    pages = table(spark, sf_dir, "pages")
    return lk.resolve_suffix(pages.select(F.regexp_extract("url", "([^/]*/[^/]*)$", 1).alias("suffix")), pages.select(F.col("url").alias("path")))


@query("SELECT host, arg_min(url, lower(url) || chr(0) || url) AS first_path FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, url FROM pages) GROUP BY host")
def first_binary_ref(spark, sf_dir):
    """The first URL of each host."""
    return lk.first_stream(table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)), "host", "url")


@query(r"""SELECT page_id, CAST(k - 1 AS BIGINT) AS ord, CASE regexp_extract(b, '<(h1|p|li)', 1) WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' ELSE 'paragraph' END AS block_type, trim(regexp_replace(b, '<[^>]*>', '', 'g')) AS text
FROM (SELECT page_id, unnest(m) AS b, generate_subscripts(m, 1) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h1|p|li)(?:\s[^>]*)?>.*?</(?:h1|p|li)>') AS m FROM pages))""")
def page_blocks(spark, sf_dir):
    """Blocks of a page in document order."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<(?:h1|p|li)(?:\s[^>]*)?>.*?</(?:h1|p|li)>"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("ord", "b"))
    tag = F.regexp_extract("b", "<(h1|p|li)", 1)
    kind = F.when(tag == "h1", "heading").when(tag == "li", "list_item").otherwise("paragraph")
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), kind.alias("block_type"), F.trim(F.regexp_replace("b", "<[^>]*>", "")).alias("text"))


def _records(spark, sf_dir) -> DataFrame:
    """Events as records of a stream for each user."""
    e, u = F.col("event_id"), F.col("user_id")
    tags = F.array(*[F.lit(t).cast("long") for t in (71, 77, 71, 76, 85, 72, 67)])
    control = F.when((e + u) % 5 == 0, "header").when((e + u) % 5 == 1, "footer")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.get(tags, ((e * 13 + u * 7) % 7).cast("int")).alias("tag_id"), (F.floor(e / 3) % 4).alias("level"), control.alias("control"))


_RECORDS = "SELECT user_id, event_id, [71, 77, 71, 76, 85, 72, 67][CAST((event_id * 13 + user_id * 7) % 7 AS INTEGER) + 1] AS tag_id, (event_id // 3) % 4 AS level, CASE (event_id + user_id) % 5 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' END AS control FROM events"


@query(f"SELECT user_id, event_id FROM (SELECT *, lead(tag_id) OVER w AS t, lead(level) OVER w AS l FROM ({_RECORDS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE tag_id = 71 AND t = 77 AND l = 2")
def table_starts(spark, sf_dir):
    """W4."""
    return wn.table_starts(_records(spark, sf_dir), ["user_id"], ["event_id"]).where("table_start").select("user_id", "event_id")


@query(f"""SELECT user_id, event_id FROM (SELECT *, lead(tag_id) OVER w AS t, lead(level) OVER w AS l, lead(tag_id, 2) OVER w AS two,
  max(CASE WHEN tag_id = 76 AND level = 2 THEN 1 ELSE 0 END) OVER f AS a, max(CASE WHEN tag_id = 85 AND level >= 3 THEN 1 ELSE 0 END) OVER f AS b
  FROM ({_RECORDS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
WHERE tag_id = 71 AND level = 1 AND NOT coalesce(t = 77 AND l = 2, false) AND a = 1 AND b = 1 AND two IS NOT NULL""")
def image_starts(spark, sf_dir):
    """W5."""
    return wn.image_starts(_records(spark, sf_dir), ["user_id"], ["event_id"]).where("image_start").select("user_id", "event_id")


@query(f"""WITH i AS (SELECT *, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM ({_RECORDS})),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS k, first(CASE WHEN tag_id = 71 AND level = 1 THEN control END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS kind FROM i)
SELECT user_id, event_id, kind IS NOT NULL AS consumed, CASE WHEN k > 1 AND NOT (k = 2 AND tag_id = 72 AND level = 2) THEN kind END AS region FROM n""")
def header_regions(spark, sf_dir):
    """W6, F3, A8."""
    return wn.control_regions(_records(spark, sf_dir), ["user_id"], ["event_id"]).select("user_id", "event_id", "consumed", "region")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN c BETWEEN 1 AND 2 THEN c - 1 END::BIGINT AS cell FROM (SELECT *, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS c FROM lineitem)")
def cell_regions(spark, sf_dir):
    """W7, W8."""
    return wn.cell_regions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") == "N", F.lit(2)).select("l_orderkey", "l_linenumber", "cell")


@query("SELECT l_orderkey, l_linenumber, NOT (first(h) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) >= 2 AND h = 0) AS accepted FROM (SELECT *, CAST(l_quantity AS BIGINT) % 4 AS h FROM lineitem)")
def exclusive_hangul(spark, sf_dir):
    """The quantity stands for the number of syllables."""
    rows = table(spark, sf_dir, "lineitem").withColumn("h", F.col("l_quantity").cast("long") % 4)
    return wn.exclusive_hangul(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "h").select("l_orderkey", "l_linenumber", "accepted")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - s AS BIGINT) AS column_index FROM (SELECT *, 1 + CAST(l_quantity AS BIGINT) % 3 AS s FROM lineitem)")
def grid_positions(spark, sf_dir):
    """W13."""
    rows = table(spark, sf_dir, "lineitem").withColumn("s", 1 + F.col("l_quantity").cast("long") % 3)
    return wn.grid_positions(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "s").select("l_orderkey", "l_linenumber", "column_index")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) = 'N' AS more FROM lineitem GROUP BY l_orderkey, l_linenumber),
i AS (SELECT *, sum(CASE WHEN more AND l_linenumber = prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev FROM c))
SELECT l_orderkey, l_linenumber, CASE WHEN NOT more THEN count(*) OVER (PARTITION BY l_orderkey, g) END AS rowspan FROM i""")
def vmerge_rowspans(spark, sf_dir):
    """J11, R5."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    rows = rows.select("l_orderkey", "l_linenumber", F.lit(0).alias("column_index"), F.lit(1).alias("colspan"), F.when(F.col("f") == "N", "continue").otherwise("restart").alias("m"))
    return wn.merged_rowspans(rows, ["l_orderkey"], "l_linenumber", F.col("m")).select("l_orderkey", "l_linenumber", "rowspan")


_CELLS = "SELECT l_orderkey, (l_linenumber - 1) // 3 AS r, (l_linenumber - 1) % 3 AS c, 1 + CAST(l_quantity AS BIGINT) % 2 AS cs, 1 + l_partkey % 2 AS rs, l_linenumber FROM lineitem"


@query(f"""WITH RECURSIVE g AS (SELECT l_orderkey, r, c, cs, rs, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, c, cs, rs, l_linenumber) AS k FROM ({_CELLS})),
t AS (SELECT l_orderkey, k, [{{'r': r, 'c': c, 'cs': cs, 'rs': rs}}] AS kept, l_linenumber, true AS stays FROM g WHERE k = 1
UNION ALL SELECT g.l_orderkey, g.k, CASE WHEN len(list_filter(t.kept, lambda x: g.r >= x.r AND g.r < x.r + x.rs AND g.c >= x.c AND g.c < x.c + x.cs)) > 0 THEN t.kept ELSE list_append(t.kept, {{'r': g.r, 'c': g.c, 'cs': g.cs, 'rs': g.rs}}) END, g.l_linenumber,
  len(list_filter(t.kept, lambda x: g.r >= x.r AND g.r < x.r + x.rs AND g.c >= x.c AND g.c < x.c + x.cs)) = 0 FROM t JOIN g ON g.l_orderkey = t.l_orderkey AND g.k = t.k + 1)
SELECT l_orderkey, l_linenumber FROM t WHERE stays""")
def covered_cells(spark, sf_dir):
    """Cells that no earlier kept cell covers, as the writer of tables keeps them."""
    n = F.col("l_linenumber").cast("int") - 1
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(n / 3).cast("int").alias("row_index"), (n % 3).alias("column_index"), (1 + F.col("l_quantity").cast("int") % 2).alias("colspan"), (1 + F.col("l_partkey") % 2).cast("int").alias("rowspan"), "l_linenumber")
    return sw.kept_cells(cells, ["l_orderkey"], ("l_linenumber",)).select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, row_index, list_transform(list_sort(coalesce(list({'a': l_suppkey, 'b': l_returnflag}) FILTER (WHERE l_orderkey IS NOT NULL), [])), lambda x: x.a || x.b) AS cells
FROM (SELECT o_orderkey, unnest(range(0, o_orderkey % 5)) AS row_index FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber - 1 = row_index GROUP BY o_orderkey, row_index""")
def row_scaffold(spark, sf_dir):
    """A4, G5."""
    tables = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("row_count"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).cast("long").alias("row_index"), F.col("l_suppkey").alias("column_index"), F.col("l_returnflag").alias("text"))
    return lk.row_scaffold(tables, cells, ["o_orderkey"]).select("o_orderkey", "row_index", F.transform("cells", lambda c: F.concat(c["column_index"].cast("string"), c["text"])).alias("cells"))


@query("""SELECT l_orderkey, CASE WHEN max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 'text_paragraph'
  WHEN bool_and(t IN (66, 68, 69)) AND max(l) <= 1 THEN 'empty_paragraph' WHEN bool_or(l_returnflag = 'R') THEN 'unknown_paragraph'
  WHEN bool_or(t IN (71, 73, 74, 75, 76, 85)) OR max(l) >= 2 THEN 'control_paragraph' ELSE 'unknown_paragraph' END AS paragraph_type
FROM (SELECT *, [66, 68, 69, 66, 67, 71, 85][l_linenumber] AS t, (l_linenumber * l_suppkey) % 3 AS l FROM lineitem) GROUP BY l_orderkey""")
def paragraph_classify(spark, sf_dir):
    """F2, G8."""
    tags = F.array(*[F.lit(t) for t in (66, 68, 69, 66, 67, 71, 85)])
    said = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), "text").otherwise("")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.get(tags, F.col("l_linenumber") - 1).alias("tag_id"), ((F.col("l_linenumber") * F.col("l_suppkey")) % 3).alias("level"), F.when(F.col("l_returnflag") == "R", said).alias("text"))
    return wn.paragraph_types(rows, ["l_orderkey"])


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS style_index FROM part")
def style_index(spark, sf_dir):
    """W3."""
    return wn.style_index(table(spark, sf_dir, "part"), ["p_brand"], "p_type", ["p_partkey"]).select("p_partkey", "style_index")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) ON l_suppkey = s_suppkey")
def style_lookup(spark, sf_dir):
    """Every third style is missing."""
    styles = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return lk.style_lookup(table(spark, sf_dir, "lineitem"), styles, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "s_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)")
def body_anti_filter(spark, sf_dir):
    """J4, J3."""
    consumed = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return lk.not_consumed(table(spark, sf_dir, "orders"), consumed, ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@query("""WITH s AS (SELECT n_nationkey AS style_id, n_nationkey AS num FROM nation WHERE n_nationkey % 2 = 0), p AS (SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, num) AS num FROM customer LEFT JOIN s ON c_nationkey = style_id)
SELECT c_custkey, CAST(0 AS BIGINT) AS level, coalesce(CASE r_name WHEN 'AFRICA' THEN 'bulleted' WHEN 'ASIA' THEN NULL ELSE CASE WHEN r_name IS NOT NULL THEN 'numbered' END END, CASE WHEN lower('List ' || c_mktsegment) LIKE 'list bu%' THEN 'bulleted' WHEN lower('List ' || c_mktsegment) LIKE 'list number%' THEN 'numbered' END) AS kind
FROM p LEFT JOIN nation ON num = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""".replace("LIKE 'list bu%'", "LIKE 'list bullet%'"))
def numbering_chain(spark, sf_dir):
    """Customers are paragraphs, nations lists and styles, regions abstract lists."""
    one = F.lit(0).alias("doc_id")
    null = F.lit(None).cast("int")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    paragraphs = table(spark, sf_dir, "customer").select(one, "c_custkey", F.col("c_nationkey").alias("style_id"), F.concat(F.lit("List "), "c_mktsegment").alias("style_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("num_id"), null.alias("ilvl"))
    styles = nations.where("n_nationkey % 2 = 0").select(one, F.col("n_nationkey").alias("style_id"), F.col("n_nationkey").alias("num_id"), null.alias("ilvl"))
    abstracts = nations.select(one, F.col("n_nationkey").alias("num_id"), F.col("n_regionkey").alias("abstract_id"))
    formats = regions.select(one, F.col("r_regionkey").alias("abstract_id"), F.lit(0).alias("ilvl"), F.when(F.col("r_name") == "AFRICA", "bullet").when(F.col("r_name") == "ASIA", "none").otherwise("decimal").alias("format"))
    return lk.numbering_kind(paragraphs, styles, abstracts, formats).select("c_custkey", F.col("level").cast("long").alias("level"), "kind")


@query("SELECT p_partkey, CASE WHEN round_even(e / 9525, 0) > 0 THEN CAST(round_even(e / 9525, 0) AS BIGINT) END AS px FROM (SELECT p_partkey, (p_partkey * 9525) // 2 - 9525 AS e FROM part)")
def emu_to_px(spark, sf_dir):
    """B10."""
    return table(spark, sf_dir, "part").select("p_partkey", bn.emu_to_px(F.floor(F.col("p_partkey") * 9525 / 2) - 9525).alias("px"))


@query("""SELECT l_orderkey, l_linenumber, CASE p & 12 WHEN 4 THEN 'left' WHEN 8 THEN 'right' WHEN 12 THEN 'center' END AS alignment, (f & 131072) <> 0 AS bold, round_even((s // 65536) / 100.0, 2)::DOUBLE AS font_size_pt,
  CASE WHEN f > 0 AND ((f >> 16) & 65535) > 0 THEN (f >> 16) & 65535 END AS numbering_ref, CASE WHEN f > 0 AND ((f >> 16) & 65535) > 0 THEN f & 65535 END AS level
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey * 65536 + l_partkey % 7 AS s, (l_suppkey % 9) * 65536 + l_linenumber AS f FROM lineitem)""")
def style_bits(spark, sf_dir):
    """B2, B3, B6."""
    flags = (F.col("l_suppkey") % 9) * 65536 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bn.alignment(F.col("l_partkey")).alias("alignment"), bn.char_shape(F.col("l_suppkey") * 65536 + F.col("l_partkey") % 7, flags).alias("c"), bn.list_bits(flags).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "alignment", "c.*", "b.numbering_ref", "b.level")


@query("""WITH e AS (SELECT user_id, event_id AS seq, event_type, event_id % 11 AS node, CASE event_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'bold' WHEN 2 THEN 'align' WHEN 3 THEN 'list' WHEN 4 THEN 'text' ELSE 'size' END AS op, CAST(event_id AS VARCHAR) AS v FROM events)
SELECT user_id, node, arg_max(v, seq) FILTER (WHERE op = 'text') AS text, arg_max(v, seq) FILTER (WHERE op = 'align') AS align, arg_max(v, seq) FILTER (WHERE op = 'size') AS size, arg_max(v, seq) FILTER (WHERE op = 'list') AS list, (count_if(op = 'bold') % 2) = 1 AS bold FROM e GROUP BY user_id, node""")
def edit_fold(spark, sf_dir):
    """The state that an edit log leaves each node in."""
    e = F.col("event_id")
    ops = F.array(*[F.lit(x) for x in ("text", "bold", "align", "list", "text", "size")])
    log = table(spark, sf_dir, "events").select("user_id", e.alias("seq"), (e % 11).alias("node"), F.get(ops, (e % 6).cast("int")).alias("op"), e.cast("string").alias("value"))
    return ed.fold(log, ["user_id", "node"]).select("user_id", "node", "text", "align", "size", "list", "bold")


@query(f"SELECT doc_id, pos, line AS text, pos % 3 = 0 AS bold FROM ({_LINE_ROWS})")
def docx_round_trip(spark, sf_dir):
    """Documents written as word-processing files and read back, a paragraph for each line."""
    run = F.struct(F.col("line").alias("text"), (F.col("pos") % 3 == 0).alias("bold"), F.lit(None).cast("double").alias("size"))
    cells = F.array().cast("array<struct<row_index:int,column_index:int,colspan:int,rowspan:int,text:string>>")
    blocks = lines(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("body").alias("region"), F.col("pos").cast("int").alias("ord"), F.lit("paragraph").alias("kind"), F.array(run).alias("runs"), F.lit("left").alias("alignment"),
        F.lit(None).cast("string").alias("list_kind"), F.lit(None).cast("int").alias("list_level"), cells.alias("cells"), F.lit(None).cast("struct<data:binary,width:int,height:int,alt:string>").alias("image"),
    )
    files = dw.write_docx(blocks).select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content"))
    return ct.docx_blocks(files).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ord").cast("long").alias("pos"), "text", F.col("runs")[0]["bold"].alias("bold"))


def _packed_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, payload): the lines of each document packed as tagged records."""
    bytes_le = lambda n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, k).bitwiseAND(F.lit(255))), 2, "0") for k in (0, 8, 16, 24)]))
    said = F.encode("line", "UTF-16LE")
    size = F.octet_length(said).cast("long")
    head = lambda tag, level, n: bytes_le(F.lit(tag + level * 1024).cast("long") + F.least(n, F.lit(4095)) * 1048576)
    zero = F.lit(0).cast("long")
    text = F.concat(head(67, 1, size), F.when(size >= 4095, bytes_le(size)).otherwise(F.unhex(F.lit(""))), said)
    packed = lines(spark, sf_dir).select("doc_id", "pos", F.hex(F.concat(head(66, 0, zero), text, head(68, 1, zero))).alias("h"))
    return packed.groupBy("doc_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), "")).alias("payload"))


@query(f"SELECT doc_id, CAST(3 * pos + 1 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS level, line AS said, CAST(octet_length(encode(line)) > 2000 AS BOOLEAN) AND length(line) * 2 >= 4095 AS long_header FROM ({_LINE_ROWS})")
def record_round_trip(spark, sf_dir):
    """Lines packed as tagged records of a stream for each document, split again and decoded."""
    streams = _packed_lines(spark, sf_dir)
    records = rc.split_records(streams.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("BodyText/Section0").alias("stream"), "payload"))
    told = records.where("tag_id = 67").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.col("level").cast("long").alias("level"), rc.direct_text("payload").alias("said"), (F.col("header_size") == 8).alias("long_header"))
    return told


@query(f"SELECT doc_id, CAST(3 * pos + 1 AS INTEGER) AS idx, 1 AS level, line AS said FROM ({_LINE_ROWS})")
def sql_records(spark, sf_dir):
    """Records as a table function of SQL, asked for one tag."""
    rc.register_records(spark)
    return spark.sql("SELECT doc_id, idx, level, decode(r.payload, 'UTF-16LE') AS said FROM {streams} s, LATERAL stream_records(s.payload, 67) r", streams=_packed_lines(spark, sf_dir))


_DRAFTS = """WITH d AS (SELECT 'paperloom.draft.v1:' || event_type || ':user%20' || user_id AS key, ts AS saved_at, sha256(coalesce(props, '')) AS digest, event_id FROM events)
"""


@query(_DRAFTS + """, s AS (SELECT *, lag(digest) OVER (PARTITION BY key ORDER BY saved_at, digest) AS before FROM d)
SELECT key, CAST(max(saved_at) AS TIMESTAMP) AS saved_at, arg_max(digest, (saved_at, digest)) AS digest, CAST(count_if(digest IS DISTINCT FROM before) AS BIGINT) AS n_saved, count(*) AS n_drafts FROM s GROUP BY key""")
def saved_drafts(spark, sf_dir):
    """The draft that holds for each key, and how many of its drafts a dirty check lets through."""
    events = table(spark, sf_dir, "events")
    label = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    told = dr.with_digest(events.select(dr.draft_key("event_type", label).alias("key"), F.col("ts").alias("saved_at"), F.col("props").alias("document")))
    saved = dr.changes(told).groupBy("key").agg(F.count("*").alias("n_saved"))
    return dr.latest(told).join(saved, "key").join(told.groupBy("key").agg(F.count("*").alias("n_drafts")), "key").select("key", "saved_at", "digest", "n_saved", "n_drafts")


def _documents(spark, sf_dir) -> DataFrame:
    """Conversations as documents: user and assistant turns are paragraphs, system turns tables of one cell."""
    turn = table(spark, sf_dir, "conversations")
    null = lambda t: F.lit(None).cast(t)
    table_ = F.col("role") == "system"
    run = "array(named_struct('kind', 'text', 'text', text, 'character_style', named_struct('bold', role = 'user', 'font_size_pt', cast(turn as double))))"
    rows = F.array(F.struct(F.array(F.struct(F.col("text"), F.lit(0).alias("row_index"), F.lit(0).alias("column_index"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))).alias("cells")))
    body = F.to_json(F.struct(F.when(table_, "table").otherwise("paragraph").alias("block_type"), F.when(~table_, F.expr(run)).alias("text_runs"), F.when(~table_ & (F.col("turn") % 2 == 0), True).alias("is_empty"), F.when(table_, rows).alias("rows")))
    blocks = turn.select("conv_id", "turn", F.from_json(body, et.BLOCK).alias("block"))
    blocks = blocks.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]).alias("blocks"))
    part = null(f"struct<blocks:array<{et.BLOCK}>>")
    return blocks.select(F.col("conv_id").alias("doc_id"), null("string").alias("source_path"), part.alias("header"), part.alias("footer"), "blocks")


@query("SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role <> 'system' AS is_paragraph, CASE WHEN role <> 'system' THEN role = 'user' END AS bold, text FROM conversations WHERE text <> ''")
def tree_round_trip(spark, sf_dir):
    """Documents to trees of nodes and back."""
    docs = _documents(spark, sf_dir)
    back = et.blocks_of_nodes(et.nodes(docs), et.blocks(docs))
    block = F.col("block")
    para = block["block_type"] == "paragraph"
    text = F.when(para, block["text"]).otherwise(F.get(F.get(block["rows"], 0)["cells"], 0)["text"])
    return back.select("doc_id", F.col("ord").cast("long").alias("ord"), para.alias("is_paragraph"), F.get(block["text_runs"], 0)["character_style"]["bold"].alias("bold"), text.alias("text")).where("text <> ''")


_EDITED = """WITH t AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS rn, role = 'system' AS cell FROM conversations),
a AS (SELECT *, text <> '' OR rn % 2 = 0 AS kid, CASE WHEN rn % 6 = 0 THEN 'again' WHEN rn % 2 = 0 THEN 'edited ' || rn ELSE text END AS told,
  CASE WHEN rn % 6 = 0 THEN false ELSE (text <> '' AND role = 'user') <> (rn % 3 = 0) END AS marked, CASE WHEN rn % 7 = 3 THEN 14.0 WHEN rn % 6 <> 0 AND text <> '' THEN turn END AS pt FROM t),
b AS (SELECT conv_id, rn, 0 AS behind, CASE WHEN cell THEN 'table' ELSE 'paragraph' END AS block_type, told AS text, CASE WHEN kid AND NOT cell THEN marked END AS bold, CASE WHEN kid AND NOT cell THEN CAST(pt AS DOUBLE) END AS size FROM a WHERE cell OR rn % 5 <> 4
  UNION ALL SELECT conv_id, rn, 1, 'paragraph', 'new', true, NULL FROM a WHERE NOT cell AND rn % 4 = 1)
"""


def _edit_log(spark, sf_dir) -> DataFrame:
    """Edits of the n-th paragraph of each conversation, in cells too: texts, marks, insertions and deletions."""
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    turn = table(spark, sf_dir, "conversations").select("conv_id", rn.alias("rn"))
    rn, own, new = F.col("rn"), F.concat(F.lit("p"), "rn"), F.concat(F.lit("n"), "rn")
    told = F.concat(F.lit("edited "), "rn")
    steps = [(rn % 2 == 0, "text", own, told), (rn % 3 == 0, "bold", own, None), (rn % 6 == 0, "text", own, ""), (rn % 6 == 0, "text", own, "again"), (rn % 4 == 1, "insert", own, new), (rn % 4 == 1, "text", new, "new"), (rn % 4 == 1, "bold", new, None), (rn % 5 == 4, "delete", own, None), (rn % 7 == 3, "size", own, "14")]
    edit = lambda k, when, op, node, value: F.when(when, F.struct((rn * 10 + k).cast("long").alias("seq"), F.lit(op).alias("op"), node.alias("node_id"), (value if value is told or value is new else F.lit(value)).cast("string").alias("value")))
    log = F.array_compact(F.array(*[edit(k, *step) for k, step in enumerate(steps)]))
    return turn.select(F.col("conv_id").alias("doc_id"), F.inline(log))


@query(_EDITED + "SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY rn, behind) - 1 AS ord, block_type, text, bold, size FROM b")
def edited_documents(spark, sf_dir):
    """E1 to E7 on trees, R3: documents to nodes, a log of edits applied, and back to blocks."""
    docs = _documents(spark, sf_dir)
    tree = ed.apply_edits(et.nodes(docs), _edit_log(spark, sf_dir))
    back = et.blocks_of_nodes(tree, et.blocks(docs))
    block = F.col("block")
    style = F.get(block["text_runs"], 0)["character_style"]
    text = F.when(block["block_type"] == "paragraph", block["text"]).otherwise(F.get(F.get(block["rows"], 0)["cells"], 0)["text"])
    return back.select("doc_id", F.col("ord").cast("long").alias("ord"), block["block_type"].alias("block_type"), text.alias("text"), style["bold"].alias("bold"), style["font_size_pt"].alias("size"))


@query(_EDITED + """SELECT conv_id AS doc_id, CASE behind WHEN 0 THEN 'p' ELSE 'n' END || rn AS node_id, coalesce(text, '') AS text, coalesce(bold, false) AS bold, size, 'left' AS align,
  row_number() OVER (PARTITION BY conv_id ORDER BY rn, behind) = 1 AS selected FROM b WHERE block_type = 'paragraph'""")
def edited_paragraphs(spark, sf_dir):
    """What an editor asks of each paragraph at the top after the edits, and which one is selected after a deletion."""
    tree = ed.apply_edits(et.nodes(_documents(spark, sf_dir)), _edit_log(spark, sf_dir))
    first = ed.first_paragraphs(tree).withColumn("selected", F.lit(True))
    found = ed.paragraphs(tree).join(first, ["doc_id", "node_id"], "left")
    return found.select("doc_id", "node_id", "text", "bold", "size", "align", F.coalesce("selected", F.lit(False)).alias("selected"))


@query("SELECT conv_id AS doc_id, CAST(count(*) AS BIGINT) AS n_blocks, CAST(count_if(CASE WHEN role = 'system' THEN text <> '' ELSE text <> '' AND turn % 2 <> 0 END) AS BIGINT) AS n_visible FROM conversations GROUP BY conv_id")
def visible_blocks(spark, sf_dir):
    """K4, A1: blocks that show something."""
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.size(F.filter("blocks", et.is_visible)).cast("long").alias("n_visible"))


_CHILDREN = "SELECT conv_id, list({'bold': role = 'user', 'size': CASE WHEN turn > 1 THEN turn END} ORDER BY turn) AS c FROM conversations GROUP BY conv_id"


@query(f"SELECT conv_id, len(list_filter(c, lambda x: NOT x.bold)) = 0 AS every_bold, CAST(list_filter(list_transform(c, lambda x: x.size), lambda x: x IS NOT NULL)[1] AS BIGINT) AS first_size FROM ({_CHILDREN})")
def child_styles(spark, sf_dir):
    """Whether every child is bold, and the first font size."""
    child = F.struct("turn", F.struct((F.col("role") == "user").alias("bold"), F.when(F.col("turn") > 1, F.col("turn").cast("long")).alias("size")).alias("c"))
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["c"]).alias("c"))
    return df.select("conv_id", tx.every_bold(F.col("c")).alias("every_bold"), tx.first_size(F.col("c")).alias("first_size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, list_contains(k, 'R') AS has_r, array_to_string(list_append(list_filter(k, lambda x: x <> 'R'), 'R'), ',') AS marks FROM (SELECT *, [l_returnflag, l_linestatus, 'R'][1:1 + l_linenumber % 3] AS k FROM lineitem)")
def replaced_marks(spark, sf_dir):
    """Marks of a type replaced by one."""
    mark = lambda c: F.struct(c.alias("type"), F.lit("old").alias("value"))
    marks = F.slice(F.array(mark(F.col("l_returnflag")), mark(F.col("l_linestatus")), mark(F.lit("R"))), F.lit(1), (F.col("l_linenumber") % 3 + 1).cast("int"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", marks.alias("m"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", tx.has_mark(F.col("m"), "R").alias("has_r"), F.array_join(F.transform(tx.replace_mark(F.col("m"), "R", F.lit("new")), lambda x: x["type"]), ",").alias("marks"))


_SOURCE = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN './' || url WHEN 2 THEN 'data:' || url WHEN 3 THEN 'a/' || url END"


@query(rf"SELECT page_id, coalesce(regexp_matches({_SOURCE}, '^(/|\./|\.\./|https?:|data:)'), false) AS loads FROM pages")
def loadable_sources(spark, sf_dir):
    """Sources that a browser can load."""
    return table(spark, sf_dir, "pages").select("page_id", tx.loads_in_browser(F.expr(_SOURCE)).alias("loads"))


@query("SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_mktsegment = c_name THEN [c_name] ELSE [c_mktsegment, c_name] END ELSE ['media', '.'] END, ':') AS roots FROM customer")
def image_search_roots(spark, sf_dir):
    """Explicit roots replace the default ones, each once."""
    given = F.when(F.col("c_custkey") % 3 == 0, F.array("c_mktsegment", "c_name", "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tx.search_roots(given, F.array(F.lit("media"), F.lit("."), F.lit("media"))), ":").alias("roots"))


@query("""SELECT host AS doc_id, '{"stream_count":' || count(*) || ',"streams":[' || string_agg('{"path":"' || path || '","size":' || size || ',"sha256":"' || sha || '"}', ',' ORDER BY path) || ']}' AS json
FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, 'p' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS path, strlen(html) AS size, sha256(html) AS sha FROM pages) GROUP BY host""")
def dump_summary(spark, sf_dir):
    """K1: the streams of each file with size and digest."""
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 12, "0"))
    return im.dump_summary(pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("doc_id"), path.alias("path"), F.col("html").cast("binary").alias("payload")))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(n - 1 AS BIGINT) AS para, CAST(n % 3 AS BIGINT) AS para_ref, CASE n % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS alignment, CASE WHEN n % 3 < 2 THEN n % 2 = 0 END AS bold, CASE WHEN n % 3 < 2 THEN CAST(10 + n % 2 AS DOUBLE) END AS font_size_pt,
  CASE WHEN n % 3 = 1 THEN row_number() OVER (PARTITION BY o_custkey, n % 3 ORDER BY n) || '.' END AS marker_text FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""")
def paragraph_styles(spark, sf_dir):
    """Orders as paragraphs of customers' documents, with references into style tables, some of which these lack."""
    le = lambda *n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x, k).bitwiseAND(F.lit(255))), 2, "0") for x in n for k in (0, 8, 16, 24)]))
    num = lambda x: F.lit(x).cast("long")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), n.alias("n"))
    char_ref = F.when(F.col("n") % 3 < 2, F.col("n") % 2).otherwise(F.lit(9).cast("long"))
    head = F.struct((F.col("n") * 2).alias("idx"), F.lit(0).alias("level"), F.lit(66).alias("tag_id"), le(num(0), num(0), F.col("n") % 3).alias("payload"))
    char = F.struct((F.col("n") * 2 + 1).alias("idx"), F.lit(1).alias("level"), F.lit(68).alias("tag_id"), le(num(0), char_ref).alias("payload"))
    records = orders.select("doc_id", F.inline(F.array(head, char)))
    para = lambda flags, bits: le(num(flags), *[num(0)] * 6, num(bits))
    shape = lambda size, flags: le(*[num(0)] * 10, num(size * 6553600), num(flags))
    made = [(21, shape(10, 0x20000)), (21, shape(11, 0)), (25, para(4, 0)), (25, para(8, 5 << 16 | 1))]
    docinfo = orders.select("doc_id").distinct().select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(t).alias("tag_id"), p.alias("payload")) for k, (t, p) in enumerate(made)])))
    found = im.paragraph_styles(records, docinfo, ["doc_id"])
    return found.select("doc_id", "para", F.col("para_ref").cast("long").alias("para_ref"), "alignment", "bold", F.col("font_size_pt").cast("double").alias("font_size_pt"), "marker_text")


def _as_files(written: DataFrame) -> DataFrame:
    return im.cut(written.select("doc_id", F.lit("docx").alias("kind"), F.col("docx").alias("content")))


@query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, CASE WHEN role = 'system' THEN 'table' ELSE 'paragraph' END AS block_type, text,
  CASE WHEN role <> 'system' AND text <> '' THEN role = 'user' END AS bold, CASE WHEN role <> 'system' AND text <> '' THEN CAST(turn AS DOUBLE) END AS size, CASE WHEN role = 'system' THEN 1 END AS column_count FROM conversations""")
def document_files(spark, sf_dir):
    """3.2, 3.3, K5, K8, S10, F8, F9, A4: documents written as files and imported as documents again."""
    back = et.blocks(cv.docx_documents(_as_files(cv.export_documents(_documents(spark, sf_dir)))))
    b = F.col("block")
    first = F.get(b["text_runs"], 0)["character_style"]
    text = F.coalesce(b["text"], F.get(F.get(b["rows"], 0)["cells"], 0)["text"])
    return back.select("doc_id", F.col("ord").cast("long").alias("ord"), b["block_type"].alias("block_type"), text.alias("text"), first["bold"].alias("bold"), first["font_size_pt"].alias("size"), b["column_count"].alias("column_count"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_custkey % 40 + 1 AS width, c_name AS alt, 'word/media/image1.png' AS ref, unhex('89504E470D0A1A0A') || encode(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE c_name END) AS data FROM customer WHERE c_custkey % 4 < 3""")
def document_images(spark, sf_dir):
    """An image in each file, found by the end of its path or replaced; one that two files fit is left out."""
    rows = table(spark, sf_dir, "customer")
    key, magic = F.col("c_custkey"), F.unhex(F.lit("89504E470D0A1A0A"))
    held = lambda c: F.concat(magic, F.encode(c, "UTF-8"))
    replaced = F.to_json(F.struct(F.when(key % 4 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(held("c_mktsegment")))).alias("replacement_data_url")))
    block = im.as_block(block_type=F.lit("image"), binary_stream_ref=F.lit("media/a.png"), width=(key % 40 + 1), height=F.lit(7), alt_text=F.col("c_name"), raw=replaced)
    blocks = rows.select(key.cast("string").alias("doc_id"), F.lit("body").alias("region"), F.lit(0).alias("ord"), block.alias("block"))
    paths = F.when(key % 4 == 3, F.array(F.lit("x/media/a.png"), F.lit("y/media/a.png"))).otherwise(F.array(F.lit("x/media/a.png"), F.lit("y/other-media/a.png")))
    media = rows.select(key.cast("string").alias("doc_id"), F.explode(paths).alias("path"), held("c_name").alias("payload"))
    files = _as_files(dw.write_docx(cv.writer_blocks(blocks, media)))
    found = et.blocks(cv.docx_documents(files)).select("doc_id", F.col("block.width").cast("long").alias("width"), F.col("block.alt_text").alias("alt"), F.col("block.binary_stream_ref").alias("ref"))
    return found.join(ct.docx_media(files).select("doc_id", F.col("path").alias("ref"), F.col("payload").alias("data")), ["doc_id", "ref"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc_id, o_orderkey AS source_index, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE o_orderpriority END AS text, o_orderkey % 3 = 2 AS is_empty, CASE WHEN o_orderkey % 2 = 0 THEN 'center' END AS alignment,
  CAST(o_orderkey % 5 AS BIGINT) AS style_ref, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 = 0 END AS bold, CASE WHEN o_orderkey % 3 = 0 THEN 8 WHEN o_orderkey % 3 = 1 THEN 7 END AS char_ref FROM orders""")
def style_reports(spark, sf_dir):
    """Orders as paragraphs of customers' style reports, with runs, with text alone, with neither."""
    k = F.col("o_orderkey")
    run = F.struct(F.col("o_orderpriority").alias("text"), F.lit(8).alias("char_style_ref"), F.struct((k % 4 == 0).alias("bold"), F.lit(9).alias("style_ref")).alias("char_style"))
    style = F.struct(F.when(k % 2 == 0, "center").alias("alignment"), F.when(k % 5 < 3, k % 5).otherwise(F.lit(99)).alias("style_ref"))
    one = F.struct(k.alias("index"), F.when(k % 3 == 1, F.col("o_orderpriority")).alias("text_decoded"), F.when(k % 5 >= 3, k % 5).alias("paragraph_style_ref"), F.lit(7).alias("char_style_ref"), style.alias("paragraph_style"), F.when(k % 3 == 0, F.array(run)).alias("text_runs"))
    reports = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("paragraphs"))).alias("json"))
    docs = cv.style_documents(reports.select("doc_id", F.inline(F.array(F.from_json("json", cv.REPORT)))))
    b = F.col("block")
    first = F.get(b["text_runs"], 0)["character_style"]
    found = et.blocks(docs).select("doc_id", b["source_index"].cast("long").alias("source_index"), b["text"].alias("text"), b["is_empty"].alias("is_empty"), b["paragraph_style"]["alignment"].alias("alignment"), b["paragraph_style"]["style_ref"].cast("long").alias("style_ref"), first["bold"].alias("bold"), first["style_ref"].alias("char_ref"))
    return found


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'BodyText/Section0' AS stream, '{"source_path":"BodyText/Section0","decoded_size":' || max(54 * l_linenumber) || ',"record_count":' || count(*) || ',"records":[' ||
  string_agg('{"index":' || l_linenumber || ',"offset":' || 54 * l_linenumber - 54 || ',"tag_id":' || l_suppkey % 99 || ',"level":' || l_partkey % 5 || ',"size":50,"header_size":4,"payload_preview_hex":"' || repeat(lower(hex(l_returnflag)), 32) || '"}', ',' ORDER BY l_linenumber, l_suppkey % 99, l_partkey % 5, l_returnflag) || ']}' AS json FROM lineitem GROUP BY l_orderkey""")
def record_reports(spark, sf_dir):
    """The records of each stream as JSON."""
    n = F.col("l_linenumber").cast("long")
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("BodyText/Section0").alias("stream"), n.alias("idx"), (54 * n - 54).alias("offset"), (F.col("l_suppkey") % 99).alias("tag_id"), (F.col("l_partkey") % 5).alias("level"), F.lit(50).cast("long").alias("size"), F.lit(4).alias("header_size"), F.encode(F.repeat("l_returnflag", F.lit(50)), "UTF-8").alias("payload"))
    return cv.record_report(records)


@query("""SELECT CAST(page_id AS VARCHAR) AS doc, 'BodyText/Section0' AS path, 'Contents/section0.xml' AS source_path, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS sha256, CAST(NULL AS VARCHAR) AS error FROM pages""")
def office_streams(spark, sf_dir):
    """Pages as zipped files in a folder each, written by the sink; of these the source reads the one stream asked for."""
    of.register(spark)

    def packed(frames):
        for frame in frames:
            rows = []
            for page, html in frame.itertuples(index=False):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("Contents/section0.xml", html or "")
                    z.writestr("Contents/header.xml", str(page))
                rows.append((str(page), f"{page}.hwpx", out.getvalue()))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "content"])

    files = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(packed, "doc_id string, name string, content binary")
    folder = new_folder(spark)
    files.write.format("office_files").mode("append").save(folder)
    found = spark.read.format("office_streams").load(folder).where("path = 'BodyText/Section0'")
    return found.select(F.regexp_extract("doc_id", "^([0-9]+)_", 1).alias("doc"), "path", "source_path", "size", F.sha2("payload", 256).alias("sha256"), "error")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) ELSE role END AS source_path, text, CASE WHEN turn % 5 <> 2 THEN CAST(turn AS INTEGER) END AS source_index, CASE WHEN turn % 2 = 0 THEN true END AS is_empty,
  CASE WHEN turn % 7 = 3 THEN NULL ELSE 9 END AS height, CAST((turn % 3 = 0)::INT + (turn % 4 = 1)::INT + (turn % 5 = 2)::INT + (turn % 2 <> 0)::INT + 1 AS INTEGER) AS n_rescued,
  concat_ws(' ', CASE WHEN turn % 2 <> 0 THEN '$.blocks[0].is_empty:STRING="no"' END, CASE WHEN turn % 5 = 2 THEN '$.blocks[0].source_index:STRING=' || '"' || turn || '"' END,
    CASE WHEN turn % 7 = 3 THEN '$.blocks[1]:STRING="stray"' ELSE '$.blocks[1].width:DECIMAL=1.5' END, CASE WHEN turn % 4 = 1 THEN '$.header:STRING="none"' END, CASE WHEN turn % 3 = 0 THEN '$.source_path:BIGINT=' || turn END) AS rescued
FROM conversations""")
def rescued_fields(spark, sf_dir):
    """Turns as documents of JSON in which fields have other types than documents give them."""
    turn = F.col("turn")
    quoted = F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))
    json = F.concat(
        F.lit('{"source_path":'), F.when(turn % 3 == 0, turn.cast("string")).otherwise(F.concat(F.lit('"'), "role", F.lit('"'))), F.lit(',"header":'), F.when(turn % 4 == 1, '"none"').otherwise("null"),
        F.lit(',"blocks":[{"block_type":"paragraph","source_index":'), F.when(turn % 5 == 2, quoted).otherwise(turn.cast("string")), F.lit(',"is_empty":'), F.when(turn % 2 == 0, "true").otherwise('"no"'),
        F.lit(',"text_runs":'), F.to_json(F.array(F.struct("text"))), F.lit("},"), F.when(turn % 7 == 3, '"stray"').otherwise('{"block_type":"image","width":1.5,"height":9}'), F.lit("]}"),
    )
    docs = rs.documents_of_json(table(spark, sf_dir, "conversations").select("conv_id", "turn", json.alias("json")))
    block = lambda i: F.get("blocks", i)
    told = F.sort_array(F.transform("rescued", lambda x: F.concat(x["path"], F.lit(":"), x["found"], F.lit("="), x["value"])))
    return docs.select("conv_id", "turn", "source_path", F.get(block(0)["text_runs"], 0)["text"].alias("text"), block(0)["source_index"].alias("source_index"), block(0)["is_empty"].alias("is_empty"), block(1)["height"].alias("height"), F.size("rescued").alias("n_rescued"), F.array_join(told, " ").alias("rescued"))
