"""The queries over the driver's tables, each with its DuckDB SQL.

Each is the semantic twin of a reference operator: the texts' UTF-8 bytes stand in for file content, and the
relational tables for image lists, catalogues and selections. Byte queries run as kernels that aggregate inside
each text; their SQL explodes the bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelmill.functions import palettes
from pixelmill.operators import chains, classify, decoders, edits, export, filetypes, images, median_cut, trees
from pixelmill.operators import pixels as P
from pixelmill.runtime import settled
from pixelmill.sources import disks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Bytes of all texts in SQL: doc_id, i, v.
_BYTES = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    l AS (SELECT doc_id, regexp_extract_all(x, '..') AS parts FROM h),
    k AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM l),
    b AS (SELECT doc_id, i, CAST('0x' || part AS BIGINT) AS v FROM k)
"""
#: RGB triples of all texts in SQL: doc_id, i, r, g, b.
_PIXELS = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    m AS (SELECT doc_id, regexp_extract_all(x, '......') AS parts FROM h),
    k AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM m),
    p AS (SELECT doc_id, i, CAST('0x' || part[1:2] AS BIGINT) AS r, CAST('0x' || part[3:4] AS BIGINT) AS g, CAST('0x' || part[5:6] AS BIGINT) AS b FROM k)
"""
_LUMA = "least(255, CAST(trunc(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) AS BIGINT))"


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "text")


# ---- aggregates ---------------------------------------------------------------------------------


@_query(_PIXELS + f"SELECT {_LUMA} AS bin, count(*) AS n FROM p GROUP BY 1")
def luma_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.luma_histogram(_docs(spark, d), "doc_id", P.text_blob())


@_query(_PIXELS + "SELECT channel, bin, count(*) AS n FROM (SELECT 'r' AS channel, r AS bin FROM p UNION ALL SELECT 'g', g FROM p UNION ALL SELECT 'b', b FROM p) GROUP BY 1, 2")
def channel_histograms(spark: SparkSession, d: str) -> DataFrame:
    return P.channel_histograms(_docs(spark, d), "doc_id", P.text_blob())


@_query(_PIXELS + "SELECT d.doc_id, count(DISTINCT r * 65536 + g * 256 + b) AS colors FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1")
def distinct_colors(spark: SparkSession, d: str) -> DataFrame:
    return P.distinct_colors(_docs(spark, d), "doc_id", P.text_blob())


@_query(_PIXELS + f", l AS (SELECT doc_id, {_LUMA} AS bin FROM p) SELECT doc_id, CAST(sum(bin) // count(*) AS BIGINT) AS mean, min(bin) AS low, max(bin) AS high FROM l GROUP BY 1")
def luma_mean_range(spark: SparkSession, d: str) -> DataFrame:
    return P.luma_statistics(_docs(spark, d), "doc_id", P.text_blob())


@_query(
    _PIXELS + """, c AS (SELECT doc_id, r * 65536 + g * 256 + b AS rgb, count(*) AS n FROM p GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rgb) AS rank FROM c)
    SELECT doc_id, rgb, n, rank FROM o WHERE rank <= 16"""
)
def top_colors(spark: SparkSession, d: str) -> DataFrame:
    return P.top_colors(_docs(spark, d), "doc_id", P.text_blob(), 16)


def _median_cut_sql(levels: int) -> str:
    parts = [_PIXELS.rstrip(), "colors0 AS MATERIALIZED (SELECT r * 65536 + g * 256 + b AS rgb, count(*) AS n, 0 AS box FROM p GROUP BY 1)"]
    for k in range(levels):
        parts += [
            f"bins{k} AS (SELECT box, channel, value, sum(n) AS n FROM (SELECT box, c AS channel, (rgb >> (16 - 8 * c)) & 255 AS value, n FROM colors{k}, (VALUES (0), (1), (2)) v(c)) GROUP BY ALL)",
            f"up{k} AS (SELECT *, sum(n) OVER (PARTITION BY box, channel ORDER BY value) AS up, sum(n) OVER (PARTITION BY box, channel) AS whole FROM bins{k})",
            f"""each{k} AS (SELECT box, channel, max(value) - min(value) AS length, least(min(value) FILTER (WHERE up * 2 >= whole), coalesce(max(value) FILTER (WHERE up < whole), 255)) AS last
                FROM up{k} GROUP BY box, channel)""",
            f"cut{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY length DESC, channel) AS place FROM each{k}) WHERE place = 1)",
            f"colors{k + 1} AS MATERIALIZED (SELECT rgb, n, box * 2 + CAST((rgb >> (16 - 8 * channel)) & 255 > last AS INTEGER) AS box FROM colors{k} JOIN cut{k} USING (box))",
        ]
    mean = lambda shift: f"CAST((2 * sum(n * ((rgb >> {shift}) & 255)) + sum(n)) // (2 * sum(n)) AS BIGINT)"
    return ", ".join(parts) + f" SELECT box, {mean(16)} * 65536 + {mean(8)} * 256 + {mean(0)} AS rgb, CAST(sum(n) AS BIGINT) AS n, count(*) AS colors FROM colors{levels} GROUP BY box"


@_query(_median_cut_sql(8))
def global_palette(spark: SparkSession, d: str) -> DataFrame:
    """256 colours for all pictures together."""
    return median_cut.global_palette(median_cut.color_table(_docs(spark, d), "doc_id", P.text_blob()))[0]


@_query("SELECT o_orderpriority, count(*) AS entries, count(*) FILTER (WHERE o_orderstatus <> 'P') AS files, count(*) FILTER (WHERE o_orderstatus = 'F') AS images FROM orders GROUP BY o_orderpriority")
def type_rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return disks.rollup_counts(_table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")


# ---- classifier statistics ----------------------------------------------------------------------


@_query(
    _BYTES + """, n AS (SELECT doc_id, v // 16 AS q FROM b UNION ALL SELECT doc_id, v % 16 FROM b),
    c AS (SELECT doc_id, q, count(*) AS o FROM n GROUP BY 1, 2),
    t AS (SELECT doc_id, sum(o) AS total FROM c GROUP BY 1)
    SELECT t.doc_id, round(sum(power(coalesce(o, 0) - total / 16.0, 2) / (total / 16.0)), 6) AS chi_square, count(*) FILTER (WHERE o > total / 100.0) AS frequent
    FROM t CROSS JOIN (SELECT unnest(range(16)) AS q) z LEFT JOIN c ON c.doc_id = t.doc_id AND c.q = z.q GROUP BY 1"""
)
def nibble_chi_square(spark: SparkSession, d: str) -> DataFrame:
    return P.nibble_statistics(_docs(spark, d), "doc_id", P.text_blob())


@_query(_BYTES + """, w AS (SELECT doc_id, v, lag(v, 16) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM b)
    SELECT d.doc_id, count(above) AS pairs, count(*) FILTER (WHERE abs(v - above) < 64) AS near FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY 1""")
def row_correlation(spark: SparkSession, d: str) -> DataFrame:
    return P.row_correlation(_docs(spark, d), "doc_id", P.text_blob(), 16)


@_query(
    _BYTES + """SELECT d.doc_id, CAST(coalesce(sum(bit_count(xor(v, v >> 1) & 127)), 0) AS BIGINT) AS transitions,
    CAST(coalesce(sum(CAST((v >> 6) % 4 IN (1, 2) AS INT) + CAST((v >> 4) % 4 IN (1, 2) AS INT) + CAST((v >> 2) % 4 IN (1, 2) AS INT) + CAST(v % 4 IN (1, 2) AS INT)), 0) AS BIGINT) AS mixed,
    count(*) FILTER (WHERE v IN (0, 255)) AS solid FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY 1"""
)
def bit_transitions(spark: SparkSession, d: str) -> DataFrame:
    return P.bit_statistics(_docs(spark, d), "doc_id", P.text_blob())


@_query(
    _BYTES + """, s AS (SELECT doc_id, i // 2048 AS blk, count(DISTINCT v) AS n FROM b WHERE i % 2048 < 100 GROUP BY 1, 2),
    r AS (SELECT doc_id, count(*) FILTER (WHERE n > 50) AS rich FROM s GROUP BY 1), z AS (SELECT doc_id, count(*) FILTER (WHERE i < 1024 AND v = 0) AS zeros FROM b GROUP BY 1)
    SELECT d.doc_id, coalesce(rich, 0) AS rich_blocks, coalesce(zeros, 0) AS early_zeros FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id"""
)
def block_distinct_score(spark: SparkSession, d: str) -> DataFrame:
    return P.block_scores(_docs(spark, d), "doc_id", P.text_blob())


@_query(
    """SELECT 'page' AS kind, page_id AS id, CASE WHEN lower(url) LIKE '%.png' OR lower(url) LIKE '%.jpg' THEN 'modern' WHEN url LIKE 'http://%/en/%' THEN 'english'
       WHEN length(html) BETWEEN 5000 AND 10000 THEN 'sized' WHEN substr(html, 1, 2) = '<!' THEN 'markup' ELSE 'unknown' END AS route FROM pages
       UNION ALL SELECT 'document', doc_id, CASE WHEN lang = 'de' THEN 'german' WHEN n_chars BETWEEN 1000 AND 2000 THEN 'sized' WHEN source = 'src0' THEN 'first' ELSE 'unknown' END FROM documents"""
)
def first_match_route(spark: SparkSession, d: str) -> DataFrame:
    """The classifier's ordered rules, over urls and documents."""
    url, html = F.col("url"), F.col("html")
    modern = F.lower(url).endswith(".png") | F.lower(url).endswith(".jpg")
    rules = [(modern, "modern"), (url.like("http://%/en/%"), "english"), (F.length(html).between(5000, 10000), "sized"), (F.substring(html, 1, 2) == "<!", "markup")]
    pages = _table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), classify.first_match(rules, "unknown").alias("route"))
    rules = [(F.col("lang") == "de", "german"), (F.col("n_chars").between(1000, 2000), "sized"), (F.col("source") == "src0", "first")]
    docs = _table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), classify.first_match(rules, "unknown").alias("route"))
    return edits.appended(pages, docs)


#: Made-up files out of documents: sizes that formats have, starts of contents, and ends of names.
_SIZES = [0, 128, 700, 1024, 3100, 6144, 6912, 7680, 7689, 8190, 9002, 9009, 10001, 10003, 10007, 10018, 14336, 16384, 16512, 20480, 22000, 24000, 27136, 32000, 32016, 32034, 32128, 32768, 34000, 38400, 54272]
_STARTS = ["", "BM", "FORM", "GIF8", "\n", "....\x04MAIN", "\x01\x02"]
_ENDS = ".png .sc2 .ge7 .gr5 .mode2 .BBC .pi3 .bin .pi1 .gr9 .gr7 .mic .gr3 .neo .scr .2mg .mac .pntg .xyz - #c00000 #c00001 #c00002 #c08005 #C10000 #c10002 .3201".replace("-", "").split(" ")
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@_query(
    f"""WITH m AS (SELECT doc_id, {_SIZES!r}[doc_id % {len(_SIZES)} + 1] AS size, [{", ".join(" || ".join(f"chr({ord(c)})" for c in x) or "''" for x in _STARTS)}][doc_id % {len(_STARTS)} + 1] AS start,
        'Pic' || doc_id || {_ENDS!r}[doc_id % {len(_ENDS)} + 1] AS name, regexp_replace(coalesce(text, ''), '[^ -~]', '_', 'g') AS text FROM documents),
    f AS (SELECT doc_id, name, lower(name) AS low, CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END AS ext, size, left(rpad(start || text, greatest(size, 1), '_'), size) AS body FROM m),
    b AS (SELECT *, unicode(body) AS one, unicode(substr(body, 2)) AS two FROM f)
    SELECT doc_id, size, CASE WHEN size = 0 THEN NULL WHEN ext IN {_in(classify.MODERN)} THEN 'modern'
      {" ".join(f"WHEN ext IN {_in(e)} THEN '{k}'" for k, e in classify.MSX_EXT.items())} {" ".join(f"WHEN ext IN {_in(e.split())} THEN 'bbc{k}'" for k, e in classify.BBC_EXT.items())}
      WHEN ext IN {_in(classify.COCO_EXT)} THEN CASE WHEN size = 32016 THEN '?32016' WHEN size >= 24000 THEN 'coco3_320' WHEN size IN (6144, 6145) THEN '?6144' WHEN size = 1024 THEN 'trs80' END
      WHEN ext IN ('pi1', 'pi2') THEN 'degas' {" ".join(f"WHEN ext IN {_in(e.split())} THEN '{k}'" for k, e in classify.ATARI_EXT.items())}
      WHEN ext IN {_in(classify.ATARI_CUT)} THEN CASE WHEN size = 7689 THEN 'gr10' ELSE 'gr15' END WHEN ext = 'neo' AND size = 32128 THEN 'neochrome'
      WHEN size >= 8 AND starts_with(body, 'GIF') THEN 'modern' WHEN size >= 14 AND starts_with(body, 'BM') THEN 'bmp' WHEN size >= 128 AND one = 10 THEN 'pcx'
      {" ".join(f"WHEN contains(low, '{t}') AND size >= {dict(shr=32000, shr3200=38400).get(k, 0)} THEN '{k}'" for t, k in classify.PRODOS.items())}
      WHEN contains(low, '.3201') THEN 'shr3201' WHEN substr(body, 5, 5) = chr(4) || 'MAIN' THEN 'apf' WHEN size >= 12 AND starts_with(body, 'FORM') THEN 'iff'
      WHEN size IN (10000, 10001) THEN 'plus4' WHEN size BETWEEN 10002 AND 10004 THEN 'plus4' WHEN size BETWEEN 10003 AND 10010 THEN 'koala' WHEN size = 10018 THEN 'art_studio'
      WHEN size = 9009 THEN 'c64_hires' WHEN size = 9002 THEN 'art_studio_hires' WHEN size = 6912 THEN 'zx' WHEN size BETWEEN 3060 AND 3500 THEN 'vic20'
      WHEN size = 16384 THEN CASE WHEN ext = 'scr' THEN 'cpc' WHEN ext IN ('2mg', 'po', 'dsk') THEN 'dhgr' ELSE '?16384' END WHEN size = 16512 THEN 'cpc'
      WHEN size BETWEEN 54272 AND 54279 THEN 'msx8' WHEN size BETWEEN 27136 AND 27143 THEN 'msx5' WHEN size BETWEEN 14336 AND 14343 THEN 'msx2' WHEN size IN (20480, 20736) THEN 'bbc1'
      WHEN size IN (10240, 10496) THEN 'bbc4' WHEN size = 7680 THEN 'gr8' WHEN size = 1024 THEN 'trs80' WHEN size = 6144 THEN '?6144' WHEN size = 32000 THEN 'coco3_320'
      WHEN ext IN ('mac', 'pntg') AND size >= 512 THEN 'macpaint' WHEN size IN (32034, 32066) AND one = 0 AND two <= 2 THEN 'degas' WHEN size IN (32767, 32768) THEN 'shr'
      WHEN size >= 38400 THEN 'shr3200' WHEN size BETWEEN 8184 AND 8200 THEN 'hgr' WHEN size BETWEEN 24000 AND 33000 THEN 'coco3_320' WHEN size BETWEEN 20000 AND 100000 THEN 'macpaint' END AS kernel FROM b"""
)
def classified_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts as files of many sizes, starts and names: the kernel that metadata and signatures tell, or the size whose content is to decide."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values)).cast("int"))
    text = F.concat(pick(_STARTS), F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "_"))
    files = _docs(spark, d).select("doc_id", pick(_SIZES).alias("size"), F.concat(F.lit("Pic"), "doc_id", pick(_ENDS)).alias("name"), text.alias("text"))
    files = files.withColumn("content", F.encode(F.expr("substring(rpad(text, greatest(size, 1), '_'), 1, size)"), "UTF-8"))
    return files.select("doc_id", "size", classify.kernel_of(F.col("name"), F.col("content")).alias("kernel"))


@_query(
    """SELECT e.event_type, coalesce(a.label, w.label, '$' || upper(substr(e.event_type, 1, 2))) AS label, count(*) AS n
       FROM events e LEFT JOIN (VALUES ('click', 1, 'odd click')) AS a(event_type, aux, label) ON a.event_type = e.event_type AND a.aux = e.user_id % 2
       LEFT JOIN (VALUES ('click', 'any click'), ('view', 'look')) AS w(event_type, label) ON w.event_type = e.event_type GROUP BY 1, 2"""
)
def dimension_default(spark: SparkSession, d: str) -> DataFrame:
    """A type table's exact row, else its row for any auxiliary type, else the type's code."""
    types = spark.createDataFrame([("click", 1, "odd click"), ("click", None, "any click"), ("view", None, "look")], "event_type string, aux long, text string")
    rows = _table(spark, d, "events").select("event_type", (F.col("user_id") % 2).cast("long").alias("aux"))
    code = F.concat(F.lit("$"), F.upper(F.substring("event_type", 1, 2)))
    return filetypes.looked_up(rows, types, "event_type", "aux", F.col("text"), "label", code).groupBy("event_type", "label").agg(F.count("*").alias("n"))


def _types_sql() -> str:
    lines = [line.split(" ", 4) for line in filetypes.PRODOS_TYPES.strip().splitlines()]
    q = lambda text: "'" + text.replace("'", "''") + "'"
    return ", ".join(f"({int(kind, 16)}, {'NULL' if aux == '*' else int(aux, 16)}, {q(short)}, {q(category)}, {q(text)})" for kind, aux, short, category, text in lines)


@_query(
    f"""WITH t(file_type, aux, short_name, category, description) AS (VALUES {_types_sql()}),
    e AS (SELECT o_orderkey, CAST(o_orderkey % 256 AS INTEGER) AS file_type, [0, 1, 2, 3, 16384, 16385, 32769, 32773, 8192][o_custkey % 9 + 1] AS aux FROM orders),
    n AS (SELECT *, CASE WHEN category = 'Graphics' AND file_type NOT IN ({", ".join(str(k) for k in sorted(filetypes.NOT_IMAGES))}) THEN TRUE ELSE FALSE END AS is_graphics FROM t)
    SELECT e.o_orderkey, CASE WHEN x.file_type IS NOT NULL THEN x.short_name WHEN w.file_type IS NOT NULL THEN w.short_name ELSE printf('$%02X', e.file_type) END AS short_name,
           CASE WHEN x.file_type IS NOT NULL THEN x.category WHEN w.file_type IS NOT NULL THEN w.category ELSE 'Unknown' END AS category,
           CASE WHEN x.file_type IS NOT NULL THEN x.description WHEN w.file_type IS NOT NULL THEN w.description ELSE printf('Type $%02X', e.file_type) END AS description,
           coalesce(x.is_graphics, w.is_graphics, FALSE) AS is_graphics
    FROM e LEFT JOIN n x ON x.file_type = e.file_type AND x.aux = e.aux LEFT JOIN n w ON w.file_type = e.file_type AND w.aux IS NULL"""
)
def prodos_types_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders as directory entries: what the whole ProDOS table says of their types and auxiliary types."""
    aux = F.get(F.array(*[F.lit(v) for v in (0, 1, 2, 3, 16384, 16385, 32769, 32773, 8192)]), (F.col("o_custkey") % 9).cast("int"))
    entries = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 256).cast("int").alias("file_type"), aux.alias("aux"))
    return filetypes.with_prodos_type(entries).select("o_orderkey", "type_info.*")


@_query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '.PIC' ELSE p_name END AS name, [0, 1, 2, 4, 6, 250, 252, 15, 193][p_size % 9 + 1] AS kind FROM part),
    n AS (SELECT p_partkey, name, CASE WHEN contains(name, '.') THEN name WHEN kind IN (0, 1) THEN name || '.txt' WHEN kind IN (2, 250, 252) THEN name || '.bas' WHEN kind IN (4, 6) THEN name || '.bin' ELSE name || '.dat' END AS file FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p_partkey) AS j FROM n)
    SELECT p_partkey, CASE WHEN j = 1 THEN file ELSE left(file, length(file) - 4) || ' (' || j || ')' || right(file, 4) END AS out_name FROM r"""
)
def entry_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts as catalogue entries: the file that each is written to, by its type, no two to one."""
    kind = F.get(F.array(*[F.lit(v) for v in (0, 1, 2, 4, 6, 250, 252, 15, 193)]), (F.col("p_size") % 9).cast("int"))
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(".PIC"))).otherwise(F.col("p_name"))
    files = _table(spark, d, "part").select("p_partkey", export.entry_file_name(name, kind).alias("out_name"))
    return export.unique_names(files, ["p_partkey"])


@_query("SELECT p_partkey, p_name, p_type FROM part WHERE (lower(p_name) LIKE '%1%' OR lower(p_type) LIKE '%a%') AND p_size > 10")
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    found = classify.contains_text(F.col("p_name"), "1") | classify.contains_text(F.col("p_type"), "A")
    return _table(spark, d, "part").where(found & (F.col("p_size") > 10)).select("p_partkey", "p_name", "p_type")


# ---- selection and edits ------------------------------------------------------------------------


@_query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def selection_semi(spark: SparkSession, d: str) -> DataFrame:
    chosen = _table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return edits.selected(_table(spark, d, "customer"), chosen, "c_custkey").select("c_custkey", "c_name")


@_query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def selection_anti(spark: SparkSession, d: str) -> DataFrame:
    chosen = _table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return edits.deleted(_table(spark, d, "customer"), chosen, "c_custkey").select("c_custkey", "c_name")


@_query("SELECT user_id FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) % 2 = 1")
def selection_toggle(spark: SparkSession, d: str) -> DataFrame:
    return edits.toggled(_table(spark, d, "events").where("event_type = 'click'"), "user_id")


@_query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer")
def append_union_all(spark: SparkSession, d: str) -> DataFrame:
    parts = [_table(spark, d, t).selectExpr(f"{c}_{k}key AS id", f"{c}_name AS name", f"{c}_nationkey AS nation") for t, c, k in (("supplier", "s", "supp"), ("customer", "c", "cust"))]
    return edits.appended(*parts)


@_query("SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest"))
    return edits.first_wins(docs, F.col("digest"), ["doc_id"]).drop("digest")


@_query("SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_top10(spark: SparkSession, d: str) -> DataFrame:
    return edits.recent(_table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@_query("SELECT user_id, event_id, CAST(seq AS BIGINT) AS seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS seq FROM events) WHERE seq <= 10")
def undo_window(spark: SparkSession, d: str) -> DataFrame:
    return edits.undo_log(_table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], "seq").drop("ts")


@_query(
    """SELECT user_id, max(event_id) AS restored FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
       WHERE k > 1 GROUP BY user_id"""
)
def undo_last(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "events").select("user_id", "event_id", "ts")
    return edits.undone(log, log, "user_id", ["ts", "event_id"]).groupBy("user_id").agg(F.max("event_id").alias("restored"))


@_query(
    """WITH r AS (SELECT user_id, max((ts, event_id)) AS at FROM events WHERE event_type = 'error' GROUP BY user_id)
       SELECT e.user_id, event_id, value FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type <> 'error' AND (r.at IS NULL OR (e.ts, e.event_id) > r.at)"""
)
def pending_adjustments(spark: SparkSession, d: str) -> DataFrame:
    """A user's events since the last error, which resets what was adjusted."""
    log = _table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return edits.pending(log, F.col("event_type") == "error", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


# ---- windows ------------------------------------------------------------------------------------


@_query(
    """WITH e AS (SELECT event_id, user_id, ts, event_id % 4 AS c, event_id % 16 AS v FROM events)
    SELECT event_id, coalesce(last_value(CASE WHEN c IN (0, 2) THEN v END IGNORE NULLS) OVER w, 0) AS r,
           coalesce(last_value(CASE WHEN c IN (0, 3) THEN v END IGNORE NULLS) OVER w, 0) AS g,
           coalesce(last_value(CASE WHEN c IN (0, 1) THEN v END IGNORE NULLS) OVER w, 0) AS b
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def hold_and_modify(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", "user_id", "ts")
    return P.hold_and_modify(e, "user_id", ["ts", "event_id"], F.col("event_id") % 4, F.col("event_id") % 16).select("event_id", "r", "g", "b")


@_query(
    _BYTES + """, k2 AS (SELECT doc_id, i, v, unnest(range(7)) AS j FROM b), bits AS (SELECT doc_id, i * 7 + j AS x, i // 40 AS y, v >= 128 AS high, (v >> j) % 2 AS bit FROM k2),
    n AS (SELECT *, lead(bit, 1, 0) OVER (PARTITION BY doc_id, y ORDER BY x) AS nxt FROM bits),
    c AS (SELECT doc_id, CASE WHEN bit = nxt THEN bit WHEN high THEN CASE WHEN x % 280 % 2 = bit THEN 4 ELSE 5 END ELSE CASE WHEN x % 280 % 2 = bit THEN 2 ELSE 3 END END AS color FROM n)
    SELECT doc_id, CAST(color AS BIGINT) AS color, count(*) AS n FROM c GROUP BY 1, 2"""
)
def next_bit_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Colours from each bit, the next one in its row of 40 bytes, the column's parity and the byte's high bit."""
    return P.artifact_counts(_docs(spark, d), "doc_id", P.text_blob())


@_query("SELECT p_partkey, CAST(coalesce(sum(p_size * 256) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_byte FROM part")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", export.offset_before(F.col("p_size") * 256, ["p_brand"], ["p_partkey"]).alias("first_byte"))


@_query(
    """WITH s AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key, 3 * 30 AS hold FROM orders),
       f AS (SELECT *, hold - CASE WHEN next_key IS NULL THEN 0 ELSE 15 END AS shown, CASE WHEN next_key IS NULL THEN 0 ELSE 15 END AS changing FROM s)
       SELECT o_orderkey, next_key, shown, changing, CAST(sum(shown + changing) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - shown - changing AS BIGINT) AS first_frame FROM f"""
)
def slideshow_timeline(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return export.timeline(orders, ["o_custkey"], ["o_orderkey"], 3.0, key="o_orderkey").drop("o_custkey")


@_query(
    """WITH s AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key FROM orders),
       f AS (SELECT *, 90 - CASE WHEN next_key IS NULL THEN 0 ELSE 15 END AS shown, CASE WHEN next_key IS NULL THEN 0 ELSE 15 END AS changing FROM s),
       t AS (SELECT *, CAST(sum(shown + changing) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - shown - changing AS BIGINT) AS first_frame FROM f),
       n AS (SELECT o_custkey, CAST(sum(shown + changing) AS BIGINT) AS n FROM t GROUP BY 1),
       w AS (SELECT o_custkey, unnest(range(0, n, 7)) AS frame FROM n)
    SELECT w.o_custkey, w.frame, o_orderkey, CASE WHEN w.frame - first_frame >= shown THEN next_key END AS next_key,
           CASE WHEN w.frame - first_frame >= shown THEN CAST(w.frame - first_frame - shown + 1 AS DOUBLE) / 15 ELSE 0 END AS alpha
    FROM w JOIN t ON t.o_custkey = w.o_custkey AND w.frame >= first_frame AND w.frame < first_frame + shown + changing"""
)
def movie_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh frame of each customer's slide show: the image, the next while it is blended in, and how far."""
    times = export.timeline(_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3.0, key="o_orderkey")
    return export.frames_at(export.frame_numbers(times, ["o_custkey"], 7), times, ["o_custkey"], "o_orderkey")


# ---- recursion and directories ------------------------------------------------------------------

_CELLS = """SELECT o_custkey % 8 AS disk, o_orderkey AS cell,
      CASE WHEN o_orderkey % 501 = 7 THEN first_value(o_orderkey) OVER w WHEN o_orderkey % 313 <> 5 THEN lead(o_orderkey) OVER w END AS next
    FROM orders WINDOW w AS (PARTITION BY o_custkey % 40 ORDER BY o_orderkey)"""


@_query(
    f"""WITH RECURSIVE cells AS (SELECT disk, cell, next FROM ({_CELLS})),
    linked AS (SELECT c.disk, c.cell, t.cell AS next FROM cells c LEFT JOIN cells t ON t.disk = c.disk AND t.cell = c.next),
    walk(disk, start, cell, position, path) AS (
        SELECT disk, cell, cell, 0, [cell] FROM linked c WHERE NOT EXISTS (SELECT 1 FROM linked p WHERE p.disk = c.disk AND p.next = c.cell)
        UNION ALL
        SELECT w.disk, w.start, l.next, w.position + 1, list_append(w.path, l.next) FROM walk w JOIN linked l ON l.disk = w.disk AND l.cell = w.cell
        WHERE l.next IS NOT NULL AND NOT list_contains(w.path, l.next)),
    ends AS (SELECT w.disk, w.start, l.next IS NOT NULL AS loops FROM walk w JOIN linked l ON l.disk = w.disk AND l.cell = w.cell
             WHERE l.next IS NULL OR list_contains(w.path, l.next))
    SELECT w.disk, w.start, CAST(w.position AS BIGINT) AS position, w.cell, e.loops FROM walk w JOIN ends e ON e.disk = w.disk AND e.start = w.start
    UNION ALL SELECT disk, NULL, NULL, cell, TRUE FROM linked l WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.disk = l.disk AND w.cell = l.cell)"""
)
def pointer_walk(spark: SparkSession, d: str) -> DataFrame:
    """Chains of orders as an allocation table: some end early, some lead back into another chain, some are closed circles."""
    w = Window.partitionBy(F.col("o_custkey") % 40).orderBy("o_orderkey")
    key = F.col("o_orderkey")
    to = F.when(key % 501 == 7, F.first("o_orderkey").over(w)).when(key % 313 != 5, F.lead("o_orderkey").over(w))
    cells = settled(_table(spark, d, "orders").select((F.col("o_custkey") % 8).alias("disk"), key.alias("cell"), to.alias("next")))
    found = settled(chains.followed(cells))
    circles = chains.unreached(cells, found).withColumn("loops", F.lit(True))
    return found.unionByName(circles, allowMissingColumns=True)


@_query(
    """SELECT r_name AS directory, n_name AS entry, count(c_custkey) AS files, CAST(coalesce(sum(c_custkey), 0) AS BIGINT) AS size FROM region JOIN nation ON n_regionkey = r_regionkey
       LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name
       UNION ALL SELECT r_name, '', count(c_custkey), CAST(coalesce(sum(c_custkey), 0) AS BIGINT) FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name"""
)
def dir_size_rollup(spark: SparkSession, d: str) -> DataFrame:
    tree = _table(spark, d, "region").join(_table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = tree.join(_table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return disks.directory_sizes(entries.select(F.col("r_name").alias("directory"), F.col("n_name").alias("entry"), "c_custkey"), "directory", "entry", "c_custkey", "c_custkey")


@_query(
    """WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, length(html) AS size FROM pages),
    f AS (SELECT list_slice(string_split(coalesce(path, ''), '/'), 1, len(string_split(coalesce(path, ''), '/')) - 1) AS dir, coalesce(size, 0) AS size FROM p),
    a AS (SELECT dir, size, list_slice(dir, 1, n) AS above FROM (SELECT dir, size, unnest(range(len(dir) + 1)) AS n FROM f)),
    s AS (SELECT above, count(*) FILTER (WHERE dir = above) AS own_files, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM a GROUP BY above),
    b AS (SELECT list_slice(above, 1, n) AS above, count(*) - 1 AS below FROM (SELECT above, unnest(range(len(above) + 1)) AS n FROM s) GROUP BY 1),
    r AS (SELECT s.*, below, row_number() OVER (ORDER BY s.above) AS first FROM s JOIN b ON b.above = s.above)
    SELECT array_to_string(above, '/') AS directory, len(above) AS depth, own_files, files, size, first, first + below AS last FROM r"""
)
def tree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and paths of pages as directories of any depth."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return trees.tree_sizes(_table(spark, d, "pages").select(path.alias("path"), F.length("html").alias("size")))


@_query(
    """WITH e AS (SELECT user_id, ts, event_id, event_id % 16 AS slot, event_id * 7919 % 16777216 AS rgb FROM events WHERE event_type <> 'error'),
    p AS (SELECT event_id AS picture, user_id, ts FROM events WHERE event_type = 'error')
    SELECT picture, slot, arg_max(rgb, (e.ts, e.event_id)) AS rgb FROM p JOIN e ON e.user_id = p.user_id AND e.ts <= p.ts GROUP BY picture, slot"""
)
def palette_as_of(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as edits of a palette of 16; errors are pictures that are shown with what it was by then."""
    events, i = _table(spark, d, "events"), F.col("event_id")
    log = events.where("event_type <> 'error'").select("user_id", "ts", "event_id", (i % 16).alias("slot"), (i * 7919 % 16777216).alias("rgb"))
    pictures = events.where("event_type = 'error'").select(i.alias("picture"), "user_id", "ts")
    return edits.palettes_at(pictures, log, "user_id", "picture", seq="event_id")


@_query("SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS extents, count(*) AS n FROM lineitem GROUP BY 1")
def group_extents(spark: SparkSession, d: str) -> DataFrame:
    return disks.extents(_table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


# ---- bytes and layouts --------------------------------------------------------------------------

_PLACE = "CASE i // 4 % 16 " + " ".join(f"WHEN {a} THEN {b}" for a, b in enumerate(disks.SECTOR_ORDER)) + " END"


@_query(_BYTES + f"""SELECT d.doc_id, count(i) AS bytes, CAST(coalesce(sum(v * ((i // 64 * 64 + {_PLACE} * 4 + i % 4) % 251 + 1)), 0) AS BIGINT) AS weighted
    FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.i < octet_length(encode(d.text)) // 64 * 64 GROUP BY 1""")
def permute_sectors(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of 16 sectors of 4 bytes put in file-system order; what is left of the text is dropped."""
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), lambda b: disks.permuted(b, disks.SECTOR_ORDER, 4))


@_query(
    _BYTES + """, s AS (SELECT doc_id, i // 512 AS slice, count(*) FILTER (WHERE v NOT IN (32, 101)) AS filled FROM b GROUP BY 1, 2 HAVING count(*) = 512)
    SELECT doc_id, slice * 512 AS first_byte, filled, row_number() OVER (PARTITION BY doc_id ORDER BY slice) AS number FROM s WHERE filled > 100"""
)
def tumbling_slices(spark: SparkSession, d: str) -> DataFrame:
    def kernel(b: np.ndarray) -> tuple:
        at, filled = P.filled_slices(b, 512, (32, 101), 100)
        return at, filled, np.arange(1, len(at) + 1)

    return P.per_blob(_docs(spark, d), "doc_id", P.text_blob(), kernel, "first_byte long, filled long, number long")


GRAY = palettes.gray(16)


def _recolored(spark: SparkSession, d: str, palette: np.ndarray) -> DataFrame:
    """How often each colour is shown when a text's nibbles are an index map."""

    def kernel(b: np.ndarray) -> tuple:
        shown = decoders.Picture("", "", decoders.bits(b[None], 4), GRAY[None]).colors(palette[None])[0].astype(np.int64)
        return np.unique(shown @ (1 << 16, 1 << 8, 1), return_counts=True)

    return P.per_blob(_docs(spark, d), "doc_id", P.text_blob(), kernel, "rgb long, n long")


_NIBBLES = _BYTES + ", n AS (SELECT doc_id, v // 16 AS q FROM b UNION ALL SELECT doc_id, v % 16 FROM b)"


@_query(_NIBBLES + "SELECT doc_id, q * 17 * 65793 AS rgb, count(*) AS n FROM n GROUP BY 1, 2")
def palette_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _recolored(spark, d, GRAY)


@_query(_NIBBLES + "SELECT doc_id, CASE WHEN q = 6 THEN 16711680 ELSE q * 17 * 65793 END AS rgb, count(*) AS n FROM n GROUP BY 1, 2")
def palette_recolor(spark: SparkSession, d: str) -> DataFrame:
    palette = GRAY.copy()
    palette[6] = (255, 0, 0)
    return _recolored(spark, d, palette)


@_query(
    _BYTES + """, c AS (SELECT x.doc_id, a.v AS attribute, x.v AS v FROM b x JOIN b a ON a.doc_id = x.doc_id AND a.i = x.i // 64 * 64 WHERE x.i % 64 > 0)
    SELECT doc_id, attribute, count(*) AS n, CAST(sum(CASE WHEN v >= attribute THEN attribute % 8 ELSE attribute // 8 % 8 END) AS BIGINT) AS ink FROM c GROUP BY 1, 2"""
)
def cell_attribute_join(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 64 bytes whose first is the attribute that gives the others one of two colours."""

    return P.cell_inks(_docs(spark, d), "doc_id", P.text_blob(), 64)


def _weighted(place: str, value: str = "v", where: str = "true") -> str:
    return _BYTES + f""", s AS (SELECT doc_id, length(x) // 64 AS rows FROM h), g AS (SELECT b.doc_id, i // 32 AS y, i % 32 AS x, v, rows FROM b JOIN s ON s.doc_id = b.doc_id WHERE i // 32 < rows)
    SELECT s.doc_id, count(v) AS bytes, CAST(coalesce(sum({value} * (({place}) % 251 + 1)), 0) AS BIGINT) AS weighted FROM s LEFT JOIN (SELECT * FROM g WHERE {where}) g ON g.doc_id = s.doc_id GROUP BY 1"""


# The layouts below see a text as rows of 32 bytes; what fills no row is no part of the picture.


@_query(_weighted("(31 - x) * g.rows + y"))
def geom_rotate(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), lambda b: P.rotate(P.grid(b, 32)).reshape(-1))


@_query(_weighted("y * 32 + 31 - x"))
def geom_flip(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), lambda b: P.flip(P.grid(b, 32), horizontal=True).reshape(-1))


@_query(_weighted("(y - 2) * 16 + x - 8", where="x BETWEEN 8 AND 23 AND y BETWEEN 2 AND 9"))
def geom_crop(spark: SparkSession, d: str) -> DataFrame:
    def change(b: np.ndarray) -> np.ndarray:
        part = P.crop(P.grid(b, 32), (24, 10), (8, 2))
        return np.zeros(0, np.uint8) if part is None else part.reshape(-1)

    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), change)


def _in_place(value: str) -> str:
    return _BYTES + f"SELECT d.doc_id, count(i) AS bytes, CAST(coalesce(sum({value} * (i % 251 + 1)), 0) AS BIGINT) AS weighted FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY 1"


@_query(_in_place("(255 - v)"))
def invert(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), P.invert)


@_query(_in_place("CAST(least(255, greatest(0, trunc((v - 128) * CAST(2.5 AS DOUBLE) + 128 + 255 * CAST(0.1 AS DOUBLE)))) AS BIGINT)"))
def tone_adjust(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), lambda b: P.adjust(b, 0.1, 0.5))


@_query(_BYTES + """, s AS (SELECT doc_id, length(x) // 64 AS rows FROM h), g AS (SELECT b.doc_id, i // 32 AS y, i % 32 AS x, v, rows FROM b JOIN s ON s.doc_id = b.doc_id WHERE i // 32 < rows),
    u AS (SELECT doc_id, y * 2 + dy AS y, x * 2 + dx AS x, v FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) c(dx))
    SELECT s.doc_id, count(v) AS bytes, CAST(coalesce(sum(v * ((y * 64 + x) % 251 + 1)), 0) AS BIGINT) AS weighted FROM s LEFT JOIN u ON u.doc_id = s.doc_id GROUP BY 1""")
def upscale_nn(spark: SparkSession, d: str) -> DataFrame:
    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), lambda b: P.upscale(P.grid(b, 32), 2).reshape(-1))


@_query(_BYTES + """, s AS (SELECT doc_id, length(x) // 64 AS rows FROM h),
    t AS (SELECT s.doc_id, y, x, y * rows // 19 * 32 + x * 32 // 28 AS i FROM s, (SELECT unnest(range(19)) AS y), (SELECT unnest(range(28)) AS x) WHERE rows > 0)
    SELECT s.doc_id, count(v) AS bytes, CAST(coalesce(sum(v * ((y * 28 + x) % 251 + 1)), 0) AS BIGINT) AS weighted
    FROM s LEFT JOIN (SELECT t.doc_id, y, x, v FROM t JOIN b ON b.doc_id = t.doc_id AND b.i = t.i) u ON u.doc_id = s.doc_id GROUP BY 1""")
def scale_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of 32 columns and any number of rows drawn into 28 by 19."""

    def change(b: np.ndarray) -> np.ndarray:
        image = P.grid(b, 32)
        return P.resize_nearest(image, 28, 19).reshape(-1) if len(image) else np.zeros(0, np.uint8)

    return P.checksums(_docs(spark, d), "doc_id", P.text_blob(), change)


@_query(
    """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)
    SELECT doc_id, CASE WHEN length(x) >= 8 THEN CAST('0x' || substr(x, 1, 8) AS BIGINT) ELSE 0 END AS be32,
           CASE WHEN length(x) >= 8 THEN CAST('0x' || substr(x, 5, 4) AS BIGINT) ELSE 0 END AS be16,
           CASE WHEN length(x) >= 8 THEN CAST('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS BIGINT) ELSE 0 END AS le32 FROM h"""
)
def be_le_ints(spark: SparkSession, d: str) -> DataFrame:
    from pixelmill.functions.binary import be_uint, le_uint

    blob = P.text_blob()
    return _docs(spark, d).select("doc_id", be_uint(blob, 0, 4).alias("be32"), be_uint(blob, 2, 2).alias("be16"), le_uint(blob, 0, 4).alias("le32"))


@_query(_NIBBLES + "SELECT d.doc_id, coalesce(string_agg(DISTINCT CAST(q AS VARCHAR), ',' ORDER BY CAST(q AS VARCHAR)), '') AS used FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1")
def array_pal_from_used(spark: SparkSession, d: str) -> DataFrame:
    return P.used_nibbles(_docs(spark, d), "doc_id", P.text_blob())


# ---- naming and export --------------------------------------------------------------------------


@_query(
    """SELECT p_partkey, round(p_size * least(CAST(1920 AS DOUBLE) / p_size, CAST(1080 AS DOUBLE) / (p_size + 7)), 6) AS w,
       round((p_size + 7) * least(CAST(1920 AS DOUBLE) / p_size, CAST(1080 AS DOUBLE) / (p_size + 7)), 6) AS h FROM part"""
)
def letterbox_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = export.letterbox(F.col("p_size"), F.col("p_size") + 7, 1920, 1080)
    return _table(spark, d, "part").select("p_partkey", F.round(fit["w"], 6).alias("w"), F.round(fit["h"], 6).alias("h"))


@_query("SELECT c_custkey, replace(replace('img_[n]_[name]', '[n]', CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS STRING)), '[name]', c_name) AS out_name FROM customer")
def rename_pattern(spark: SparkSession, d: str) -> DataFrame:
    images = _table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("name"))
    return export.renamed(images, "img_{n}_{name}", ["c_custkey"], ["c_nationkey"]).select("c_custkey", "out_name")


@_query("""SELECT out_name, count(*) AS copies FROM (SELECT substr(n_name, 1, 3) || '.' || f.ext AS out_name FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('png'), ('jpg'), ('gif')) AS f(ext)) GROUP BY 1""")
def export_cross_product(spark: SparkSession, d: str) -> DataFrame:
    images = edits.selected(_table(spark, d, "nation"), _table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey")
    plan = export.export_plan(images.select(F.substring("n_name", 1, 3).alias("name")), ["png", "jpg", "gif"])
    return plan.select("out_name", F.col("sharing").alias("copies")).distinct()


@_query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' (' || p_size || ').png' ELSE p_name || '.png' END AS name FROM part),
    t AS (SELECT DISTINCT p_name || '.png' AS name FROM part WHERE p_size = 3 UNION SELECT DISTINCT p_name || ' (4).png' FROM part WHERE p_size > 40),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS j FROM p),
    k AS (SELECT name, unnest(range(1, count(*) + 1 + (SELECT count(*) FROM (SELECT DISTINCT name FROM p UNION SELECT name FROM t)))) AS k FROM p GROUP BY name),
    c AS (SELECT name, k, CASE WHEN k = 1 THEN name ELSE left(name, length(name) - 4) || ' (' || k || ').png' END AS out_name FROM k),
    f AS (SELECT name, out_name, row_number() OVER (PARTITION BY name ORDER BY k) AS j FROM c
          WHERE out_name NOT IN (SELECT name FROM t) AND (k = 1 OR out_name NOT IN (SELECT name FROM p)))
    SELECT p_partkey, r.name, out_name FROM r JOIN f ON f.name = r.name AND f.j = r.j"""
)
def unique_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as files, many of one name and some that look like a copy's, next to files that are there already."""
    part, name = _table(spark, d, "part"), F.col("p_name")
    own = F.when(F.col("p_partkey") % 7 == 0, F.concat(name, F.lit(" ("), F.col("p_size"), F.lit(").png"))).otherwise(F.concat(name, F.lit(".png")))
    taken = part.where("p_size = 3").select(F.concat(name, F.lit(".png")).alias("name")).union(part.where("p_size > 40").select(F.concat(name, F.lit(" (4).png"))))
    files = part.select("p_partkey", own.alias("name")).withColumn("out_name", F.col("name"))
    return export.unique_names(files, ["p_partkey"], taken=taken)


@_query("SELECT p_partkey, printf('#%02X%02X%02X', p_size, p_size * 5, 255 - p_size) AS hex FROM part")
def hex_color(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return _table(spark, d, "part").select("p_partkey", images.hex_color(size, size * 5, 255 - size).alias("hex"))


@_query(
    """SELECT l_orderkey, max(l_partkey) * 97 AS bytes, CASE WHEN max(l_partkey) * 97 < 1024 THEN concat(max(l_partkey) * 97, ' B')
       WHEN max(l_partkey) * 97 < 1048576 THEN printf('%.1f KB', max(l_partkey) * 97 / CAST(1024 AS DOUBLE)) ELSE printf('%.1f MB', max(l_partkey) * 97 / CAST(1048576 AS DOUBLE)) END AS label
       FROM lineitem GROUP BY l_orderkey"""
)
def size_label(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.max("l_partkey") * 97).alias("bytes"))
    return sizes.withColumn("label", export.size_label(F.col("bytes")))


@_query("SELECT n_nationkey, printf('%03d_%s.png', row_number() OVER (ORDER BY n_nationkey), n_name) AS out_name FROM nation")
def screensaver_names(spark: SparkSession, d: str) -> DataFrame:
    images = _table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return export.screensaver_names(images, ["n_nationkey"]).select("n_nationkey", "out_name")
