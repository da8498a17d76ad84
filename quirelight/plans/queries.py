"""Registered queries: each applies an operator to whole tables; ORACLE_SQL has the same rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import decode, frames, geometry, layout, metrics, paragraphs, placement, status
from quirelight.plans import page_queries  # noqa: F401, registers its queries
from quirelight.plans.registry import BLOCKS, ORACLE_SQL, QUERIES, query, r6, table  # noqa: F401
from quirelight.sources import bridge, files, sinks

PAGE_WORDS = f"""{BLOCKS},
pt AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS r FROM blocks GROUP BY ALL),
both_ AS (SELECT doc_id, page, r, {bridge.degraded_sql("r", "doc_id", 17)} AS e FROM pt),
w AS (
  SELECT doc_id, page, word, CAST(sum(a) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS got FROM (
    SELECT doc_id, page, unnest(list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '')) AS word, 1 AS a, 0 AS b FROM both_
    UNION ALL SELECT doc_id, page, unnest(list_filter(regexp_split_to_array(e, '\\s+'), lambda x: x <> '')), 0, 1 FROM both_)
  GROUP BY ALL),
pairs AS (SELECT * FROM w WHERE n > 0)
"""


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.pages(spark, sf_dir)


def page_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, r (recognised text) and e (extracted text: some characters, spaces too, are lost)."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", layout.page_text(F.col("blocks")).alias("r"))
    return rows.withColumn("e", bridge.degraded(F.col("r"), F.col("doc_id"), 17))


# --- Metrics ------------------------------------------------------------------------------------

_F1 = """CASE WHEN truth = '' THEN CAST('NaN' AS DOUBLE) WHEN ov = 0 THEN 0.0 ELSE 2.0 * ov / (length(truth) + length(got)) END"""


def _f1_sql(source: str, keys: str, every: int) -> str:
    return f"""
t AS (SELECT {keys}, truth, {bridge.degraded_sql("truth", "doc_id", every)} AS got FROM ({source})),
c AS (SELECT {keys}, ch, sum(n) AS n, sum(m) AS m FROM (
    SELECT {keys}, unnest(string_split(truth, '')) AS ch, 1 AS n, 0 AS m FROM t
    UNION ALL SELECT {keys}, unnest(string_split(got, '')), 0, 1 FROM t) WHERE ch <> '' GROUP BY ALL),
o AS (SELECT {keys}, sum(least(n, m)) AS ov FROM c GROUP BY ALL),
f AS (SELECT {keys}, length(truth) AS chars, {_F1} AS char_f1 FROM t LEFT JOIN o USING ({keys}))"""


@query(f"""WITH {_f1_sql(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS truth FROM documents", "doc_id", 17)}
SELECT doc_id, chars, round(char_f1, 6) AS char_f1, CASE WHEN char_f1 >= 0.95 THEN '' WHEN char_f1 >= 0.85 THEN 'weak' ELSE 'poor' END AS flag FROM f""")
def char_f1_pairs(spark, sf_dir):
    """Character F1 of every document against its degraded copy (A1, J4, E1, F1, F9, P7): no shuffle."""
    rows = bridge.documents(spark, sf_dir).select("doc_id", tx.normalise(F.col("text")).alias("truth"))
    rows = rows.withColumn("got", bridge.degraded(F.col("truth"), F.col("doc_id"), 17))
    f1 = tx.char_f1(F.col("truth"), F.col("got"))
    return rows.select("doc_id", F.length("truth").alias("chars"), f1.alias("f")).select("doc_id", "chars", r6(F.col("f")).alias("char_f1"), metrics.rating(F.col("f")).alias("flag"))


_PAGE_TRUTH = r"SELECT doc_id, page, regexp_replace(string_agg(text, chr(10) ORDER BY ord), '\s+', '', 'g') AS truth FROM blocks GROUP BY ALL"


@query(f"""{BLOCKS}, {_f1_sql(_PAGE_TRUTH, "doc_id, page", 17)}
SELECT count(*) AS pages, round(avg(char_f1), 6) AS mean_f1, avg(char_f1) >= 0.95 AS passed FROM f WHERE chars >= 20""")
def verdict(spark, sf_dir):
    """Mean F1 over pages that are not near blank, and the gate."""
    rows = page_pair(spark, sf_dir).select("doc_id", tx.normalise(F.col("r")).alias("truth"))
    rows = rows.select(F.length("truth").alias("chars"), tx.char_f1(F.col("truth"), bridge.degraded(F.col("truth"), F.col("doc_id"), 17)).alias("char_f1"))
    return metrics.verdict(rows).select("pages", r6(F.col("mean_f1")).alias("mean_f1"), "passed")


#: Kinds of degradation in their order, and how often a character is lost.
KINDS = [("clean", 0), ("skew1", 29), ("skew2", 19), ("jpeg40", 13), ("dpi150", 11), ("noise", 7)]


def _kind_sql() -> str:
    parts = []
    for pos, (kind, every) in enumerate(KINDS):
        sql = _f1_sql(r"SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS truth FROM documents", "doc_id", every)
        parts.append(f"SELECT '{kind}' AS kind, {pos} AS pos, char_f1 FROM (WITH {sql} SELECT char_f1 FROM f WHERE chars > 0)")
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT kind, pos, avg(char_f1) AS m, min(char_f1) AS lo, max(char_f1) AS hi FROM s GROUP BY ALL)
SELECT kind, round(m, 6) AS mean_f1, round(lo, 6) AS min_f1, round(hi, 6) AS max_f1, round(m - (SELECT m FROM g WHERE kind = 'clean'), 6) AS delta,
  kind = (SELECT arg_min(kind, m * 1000000 + pos * 0.000001) FROM g) AS worst FROM g"""


@query(_kind_sql())
def degradation(spark, sf_dir):
    """F1 by kind of degradation, the change from clean, and the worst kind (A3, O9). Six rows meet in the last steps."""
    rows = bridge.documents(spark, sf_dir).select(F.col("doc_id").cast("long"), tx.normalise(F.col("text")).alias("truth"))
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in KINDS]), F.col("pos") + 1)
    scores = metrics.kept_f1(rows, [every for _, every in KINDS]).withColumnRenamed("place", "pos")
    g = scores.groupBy("pos").agg(F.avg("f").alias("m"), F.min("f").alias("lo"), F.max("f").alias("hi")).withColumn("kind", kind)
    facts = g.agg(F.max(F.when(F.col("kind") == "clean", F.col("m"))).alias("base"), F.min_by("kind", F.struct("m", "pos")).alias("least"))
    return g.join(F.broadcast(facts)).select("kind", r6(F.col("m")).alias("mean_f1"), r6(F.col("lo")).alias("min_f1"), r6(F.col("hi")).alias("max_f1"), r6(F.col("m") - F.col("base")).alias("delta"), (F.col("kind") == F.col("least")).alias("worst"))


@query(f"""{PAGE_WORDS},
tok AS (SELECT DISTINCT doc_id, page, word AS tok FROM w WHERE got > 0),
mer AS (SELECT DISTINCT p.doc_id, p.page, p.word FROM pairs p JOIN tok t ON p.doc_id = t.doc_id AND p.page = t.page AND contains(t.tok, p.word) AND t.tok <> p.word WHERE p.got < p.n),
m AS (SELECT p.*, mer.word IS NOT NULL AS merged, greatest(n - got, 0) AS lost, regexp_full_match(p.word, '[\\x00-\\x7F]*') AS plain
  FROM pairs p LEFT JOIN mer ON p.doc_id = mer.doc_id AND p.page = mer.page AND p.word = mer.word)
SELECT doc_id, page, CAST(sum(n) AS BIGINT) AS words, CAST(sum(lost) AS BIGINT) AS missing, CAST(sum(CASE WHEN merged THEN lost ELSE 0 END) AS BIGINT) AS merged, CAST(sum(CASE WHEN NOT plain THEN lost ELSE 0 END) AS BIGINT) AS non_ascii,
  round(sum(least(n, got)) / greatest(1, sum(n)), 6) AS recovery,
  round(coalesce(sum(CASE WHEN plain THEN least(n, got) END), 0) / greatest(1, coalesce(sum(CASE WHEN plain THEN n END), 0)), 6) AS ascii_recovery
FROM m GROUP BY ALL""")
def word_recovery(spark, sf_dir):
    """Round trip of words by page, and where the lost ones went."""
    rows = page_pair(spark, sf_dir).select("doc_id", "page", tx.words(F.col("r")).alias("r"), tx.words(F.col("e")).alias("e"))
    out = metrics.recovery(metrics.paired_words(rows, ["doc_id", "page"], "r", "e"), ["doc_id", "page"])
    return out.withColumns({c: r6(F.col(c)) for c in ("recovery", "ascii_recovery")})


@query(f"""{PAGE_WORDS} SELECT doc_id, page, word, n - got AS missing FROM pairs WHERE n > got""")
def missing_words(spark, sf_dir):
    """Recognised words that extraction has too few of."""
    rows = page_pair(spark, sf_dir)
    side = lambda c, n, g: rows.select("doc_id", "page", F.explode(tx.words(F.col(c))).alias("word"), F.lit(n).alias("n"), F.lit(g).alias("g"))
    sums = side("r", 1, 0).unionByName(side("e", 0, 1)).groupBy("doc_id", "page", "word").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    return sums.filter("n > g").select("doc_id", "page", "word", (F.col("n") - F.col("g")).alias("missing"))


@query(f"""{PAGE_WORDS}, d AS (SELECT doc_id, word, sum(n) AS n, sum(got) AS got FROM w GROUP BY ALL)
SELECT doc_id, round(sum(CASE WHEN n > 0 THEN least(n, got) ELSE 0 END) / greatest(1, sum(n)), 6) AS recovery, sum(got) < 1.5 * sum(n) AS single_layer FROM d GROUP BY ALL""")
def document_recovery(spark, sf_dir):
    """Round trip over a document's merged multisets, and whether its layer is single."""
    rows = page_pair(spark, sf_dir)
    side = lambda c, n, g: rows.select("doc_id", F.explode(tx.words(F.col(c))).alias("word"), F.lit(n).alias("n"), F.lit(g).alias("g"))
    sums = side("r", 1, 0).unionByName(side("e", 0, 1)).groupBy("doc_id", "word").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    return sums.groupBy("doc_id").agg(r6(F.sum(F.least("n", "g")) / F.greatest(F.lit(1), F.sum("n"))).alias("recovery"), (F.sum("g") < 1.5 * F.sum("n")).alias("single_layer"))


@query(f"""{PAGE_WORDS}, s AS (SELECT DISTINCT word FROM pairs WHERE length(word) > 1 ORDER BY word LIMIT 300)
SELECT count(*) AS sampled, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM both_ b WHERE contains(b.e, s.word)) THEN 1 ELSE 0 END) AS BIGINT) AS found FROM s""")
def search_recall(spark, sf_dir):
    """Of the first 300 words, those a search in the extracted text finds."""
    rows = page_pair(spark, sf_dir).select(tx.words(F.col("r")).alias("r"), "e")
    return metrics.search_recall(rows, "r", "e")


@query()
def sequence_deltas(spark, sf_dir):
    """Order-sensitive similarity of the raw and of the reordered blocks to the reading order, by page that counts."""
    rows = page_rows(spark, sf_dir).withColumn("gutter", layout.find_gutter(F.col("blocks")))
    rows = rows.withColumn("ordered", layout.reading_order(F.col("blocks"), F.col("gutter")))
    truth = F.array_sort(F.transform("blocks", lambda b: F.struct(b["x0"], b["y0"], b["text"].alias("text"))))
    join = lambda c: tx.normalise(layout.page_text(c))
    rows = rows.select("doc_id", "page", join(truth).alias("truth"), join(F.col("blocks")).alias("raw"), join(F.col("ordered")).alias("col"))
    rows = rows.filter(metrics.counted(F.length("truth")))
    rows = rows.withColumn("raw", metrics.sequence_ratio(F.col("truth"), F.col("raw"))).withColumn("col", metrics.sequence_ratio(F.col("truth"), F.col("col")))
    return rows.select("doc_id", "page", r6(F.col("raw")).alias("raw"), r6(F.col("col")).alias("col"), metrics.change(F.col("col") - F.col("raw")).alias("flag"))


# --- Layout -------------------------------------------------------------------------------------


@query(f"""{BLOCKS} SELECT doc_id, page, count(*) AS blocks, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  CAST(sum(CASE WHEN (y1 - y0) > (x1 - x0) * 2 AND length(text) > 1 THEN 1 ELSE 0 END) AS INTEGER) AS vertical FROM blocks GROUP BY ALL""")
def page_bounds(spark, sf_dir):
    """Bounds of a page's quads and its sideways lines."""
    quad = lambda b: F.array(*[F.array(b[x], b[y]) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    rows = page_rows(spark, sf_dir)
    every = layout.quad_bounds(F.flatten(F.transform("blocks", quad)))
    tall = F.filter("blocks", lambda b: layout.is_vertical(b["x0"], b["y0"], b["x1"], b["y1"], b["text"]))
    return rows.select("doc_id", "page", F.size("blocks").cast("long").alias("blocks"), every.alias("q"), F.size(tall).alias("vertical")).select("doc_id", "page", "blocks", "q.*", "vertical")


_GUTTER = f"""{BLOCKS},
ext AS (SELECT doc_id, page, CAST(min(x0) AS DOUBLE) AS lo, CAST(max(x1) - min(x0) AS DOUBLE) AS width, count(*) AS n FROM blocks GROUP BY ALL),
cand AS (SELECT e.*, s.step, 0.3::DOUBLE + (0.7::DOUBLE - 0.3::DOUBLE) * s.step / 39 AS frac FROM ext e, (SELECT unnest(range(1, 40)) AS step) s WHERE n >= 8 AND width > 0),
place AS (SELECT doc_id, page, n, step, frac, lo + width * frac AS x, width FROM cand),
cnt AS (SELECT p.doc_id, p.page, p.n, p.step, p.frac, p.x,
    sum(CASE WHEN (b.x1 - b.x0) < p.width * 0.6::DOUBLE AND b.x0 < p.x AND p.x < b.x1 THEN 1 ELSE 0 END) AS crossing,
    sum(CASE WHEN b.x1 <= p.x THEN 1 ELSE 0 END) AS l, sum(CASE WHEN b.x0 >= p.x THEN 1 ELSE 0 END) AS r
  FROM place p JOIN blocks b USING (doc_id, page) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY crossing, abs(frac - 0.5), step) AS k FROM cnt),
gut AS (SELECT doc_id, page, x AS gutter FROM best WHERE k = 1 AND crossing <= n * 0.05::DOUBLE AND l >= n * 0.25 AND r >= n * 0.25)
"""


@query(f"{_GUTTER} SELECT e.doc_id, e.page, round(gutter, 6) AS gutter FROM ext e LEFT JOIN gut USING (doc_id, page)")
def find_gutter(spark, sf_dir):
    """The column gutter of every page."""
    return page_rows(spark, sf_dir).select("doc_id", "page", r6(layout.find_gutter(F.col("blocks"))).alias("gutter"))


@query(f"""{_GUTTER} SELECT b.doc_id, b.page, string_agg(b.text, chr(10) ORDER BY
    CASE WHEN gutter IS NULL THEN 0 WHEN x0 < gutter AND gutter < x1 THEN 0 WHEN x1 <= gutter THEN 1 ELSE 2 END,
    CASE WHEN gutter IS NULL THEN 0 ELSE y0 END, CASE WHEN gutter IS NULL THEN 0 ELSE x0 END, ord) AS text
  FROM blocks b LEFT JOIN gut USING (doc_id, page) GROUP BY b.doc_id, b.page""")
def reading_order(spark, sf_dir):
    """Texts of pages in reading order."""
    rows = page_rows(spark, sf_dir).withColumn("gutter", layout.find_gutter(F.col("blocks")))
    return rows.select("doc_id", "page", layout.page_text(layout.reading_order(F.col("blocks"), F.col("gutter"))).alias("text"))


@query(f"""{BLOCKS}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS t FROM blocks GROUP BY ALL)
SELECT doc_id, string_agg(CASE WHEN page > 1 THEN chr(10) || chr(10) || '--- Page ' || page || ' ---' || chr(10) || chr(10) || t ELSE t END, '' ORDER BY page) AS text FROM p GROUP BY ALL""")
def document_text(spark, sf_dir):
    """Documents' texts with page separators."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", layout.page_text(F.col("blocks")).alias("t"))
    return layout.joined_pages(rows, ["doc_id"], "page", "t")


_STATS = f"""{BLOCKS}, st AS (SELECT doc_id, page, list_sort(list(greatest(y1 - y0, 1)))[count(*) // 2 + 1] AS h,
  list_sort(list(x0))[CAST(round((count(*) - 1) * 0.1) AS INTEGER) + 1] AS l, max(x1) AS r FROM blocks GROUP BY ALL)"""


@query(f"{_STATS} SELECT doc_id, page, CAST(h AS DOUBLE) AS height, CAST(l AS DOUBLE) AS left_margin, CAST(r AS DOUBLE) AS right_edge FROM st")
def line_stats(spark, sf_dir):
    """Line height, left margin and right edge of pages."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", paragraphs.line_stats(F.col("blocks")).alias("s"))
    return rows.select("doc_id", "page", F.col("s.height").cast("double").alias("height"), F.col("s.left").cast("double").alias("left_margin"), F.col("s.right").cast("double").alias("right_edge"))


@query(f"""{_STATS},
ln AS (SELECT doc_id, page, ord, trim(text, ' ' || chr(9)) AS t, x0, y0, x1, y1, h, l, r FROM blocks JOIN st USING (doc_id, page) WHERE trim(text, ' ' || chr(9)) <> ''),
pv AS (SELECT *, lag(y1) OVER w AS pb, lag(x1) OVER w AS pr, x0 - l > 1.2 * h AS ind FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
br AS (SELECT *, CASE WHEN pb IS NULL THEN 0 WHEN y0 - pb > 0.8 * h OR ind OR (r - pr > 2 * h AND x0 - l <= 0.6 * h) THEN 1 ELSE 0 END AS b FROM pv),
pa AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page ORDER BY ord) AS para FROM br)
SELECT doc_id, page, CAST(para AS INTEGER) AS para, string_agg(t, ' ' ORDER BY ord) AS text, arg_min(ind, ord) AS first_line_indent FROM pa GROUP BY doc_id, page, para""")
def page_paragraphs(spark, sf_dir):
    """Paragraphs of pages from their lines."""
    rows = page_rows(spark, sf_dir).withColumn("s", paragraphs.line_stats(F.col("blocks")))
    return rows.select("doc_id", "page", F.posexplode(paragraphs.paragraphs(F.col("blocks"), F.col("s"))).alias("para", "p")).select("doc_id", "page", "para", "p.*")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10) || chr(10)), chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM l),
g AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
p AS (SELECT doc_id, k, string_agg(t, ' ' ORDER BY i) AS text FROM g WHERE t <> '' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS para, text FROM p""")
def native_paragraphs(spark, sf_dir):
    """Paragraphs of texts parted by blank lines."""
    rows = bridge.documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return rows.select("doc_id", F.posexplode(paragraphs.native_paragraphs(F.col("text"))).alias("para", "text"))


@query(f"""{BLOCKS},
near AS (SELECT a.doc_id, a.page, a.ord, a.x1, b.x0 AS nx, b.y1 - b.y0 AS h, row_number() OVER (PARTITION BY a.doc_id, a.page, a.ord ORDER BY b.x0, b.ord) AS k
  FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.page = b.page AND b.x0 > a.x1 AND a.y0 < b.y1 - 0.01 AND a.y1 > b.y0 + 0.01)
SELECT doc_id, page, CAST(ord AS INTEGER) AS word, round((nx - x1) / CAST(h AS DOUBLE), 6) AS gap FROM near WHERE k = 1 AND h > 0.5""")
def nearest_gap(spark, sf_dir):
    """Gap to the nearest block on the right, in heights."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.inline(layout.nearest_right(F.col("blocks"))))
    return rows.select("doc_id", "page", F.col("index").alias("word"), r6(F.col("gap")).alias("gap"))


@query(f"""{BLOCKS} SELECT doc_id, page, count(*) AS boxes, round(list_sort(list((x1 - x0) * 72.0 / 200))[count(*) // 2 + 1], 6) AS median, round(max((x1 - x0) * 72.0 / 200), 6) AS widest,
  CAST(sum(CASE WHEN (x1 - x0) * 72.0 / 200 / (1700 * 72.0 / 200) > 0.15 THEN 1 ELSE 0 END) AS INTEGER) AS sticky FROM blocks GROUP BY ALL""")
def box_health(spark, sf_dir):
    """Widths of boxes in points: upper median, widest, and those over 15 % of the page."""
    points = lambda v: layout.to_points(v, F.lit(200))
    placed = F.transform("blocks", lambda b: F.struct(points(b["x0"]).alias("x0"), points(b["x1"]).alias("x1")))
    out = metrics.box_health(page_rows(spark, sf_dir).withColumn("placed", placed), ["doc_id", "page"], points(F.lit(1700)))
    return out.select("doc_id", "page", F.col("boxes").cast("long").alias("boxes"), r6(F.col("median")).alias("median"), r6(F.col("widest")).alias("widest"), "sticky")


@query(f"""{BLOCKS}, p AS (SELECT doc_id, page, sum(length(text)) AS n, count(*) AS lines FROM blocks GROUP BY ALL)
SELECT doc_id, count(*) AS pages, CAST(sum(CASE WHEN n >= 1000 THEN 0 ELSE 1 END) AS BIGINT) AS ocr, CAST(sum(CASE WHEN n >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
  CAST(sum(CASE WHEN n >= 1000 THEN 0 ELSE lines END) AS BIGINT) AS lines, sum(CASE WHEN n >= 1000 THEN 0 ELSE 1 END) = 0 AS already_searchable FROM p GROUP BY ALL""")
def document_summary(spark, sf_dir):
    """Pages by route and lines of documents (P4, A14, S14, D17); here 1000 characters make a page native."""
    rows = page_rows(spark, sf_dir).select("doc_id", F.aggregate("blocks", F.lit(0), lambda a, b: a + F.length(b["text"])).alias("n"), F.size("blocks").alias("lines"))
    ocr = frames.route((F.col("n") / 100).cast("int")) == "ocr"
    agg = rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(ocr).alias("ocr"), F.count_if(~ocr).alias("skipped"), F.sum(F.when(ocr, F.col("lines")).otherwise(0)).alias("lines"))
    return agg.withColumn("already_searchable", (F.col("ocr") == 0) & (F.col("skipped") > 0))


@query(f"""{BLOCKS}, p AS (SELECT doc_id, page, count(*) AS n, sum(length(text)) + count(*) - 1 AS c FROM blocks GROUP BY ALL)
SELECT doc_id, count(*) AS pages, CAST(sum(greatest(n, 1)) AS BIGINT) AS lines, CAST(sum(c) + sum(CASE WHEN page > 1 THEN length('--- Page ' || page || ' ---') + 4 ELSE 0 END) AS BIGINT) AS chars FROM p GROUP BY ALL""")
def text_stats(spark, sf_dir):
    """Pages, lines and code points of exported texts, separators included."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.size("blocks").alias("n"), layout.page_text(F.col("blocks")).alias("t"))
    mark = F.when(F.col("page") > 1, F.length(F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---"))) + 4).otherwise(0)
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.greatest("n", F.lit(1))).cast("long").alias("lines"), F.sum(F.length("t") + mark).cast("long").alias("chars"))


@query()
def place_words(spark, sf_dir):
    """Where every word of the invisible layer goes."""
    points = lambda v: layout.to_points(v.cast("double"), F.lit(72.0))
    none = F.expr("CAST(NULL AS array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>)")
    block = lambda b: F.struct(*[points(b[k]).alias(k) for k in ("x0", "y0", "x1", "y1")], b["text"].alias("text"), none.alias("words"))
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.transform("blocks", block).alias("blocks"), F.lit(4000.0).alias("page_height"))
    placed = placement.place_words(rows, ["doc_id", "page"])
    # the stream's length is taken before words become rows: each row would carry the page's whole stream
    placed = placed.select("doc_id", "page", "placed", F.length("content").alias("content_chars"))
    return placed.select("doc_id", "page", F.posexplode("placed").alias("word", "p"), "content_chars").select("doc_id", "page", "word", "p.*", "content_chars")


@query()
def align_words(spark, sf_dir):
    """Words of a page aligned with what extraction finds, and their drift."""
    item = lambda t: F.transform(tx.words(F.col(t)), lambda w, i: F.struct(w.alias("text"), (i * 7.0).alias("x0")))
    rows = page_pair(spark, sf_dir).select("doc_id", "page", item("r").alias("placed"), item("e").alias("found"))
    out = metrics.aligned_words(rows, ["doc_id", "page"])
    return out.groupBy("doc_id", "page").agg(F.count("*").alias("matched"), F.max("dx").alias("most"))


@query()
def row_order(spark, sf_dir):
    """Detector boxes in row order."""
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.transform("blocks", lambda b, i: F.struct(b["x0"].alias("x"), (b["y0"] + (i * 7) % 13).alias("y"))).alias("boxes"))
    return geometry.ordered_boxes(rows, ["doc_id", "page"]).select("doc_id", "page", F.array_join("position", ",").alias("position"))


@query(f"""{BLOCKS} SELECT doc_id, page, CAST(ord AS INTEGER) AS word, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
  regexp_replace(text, '[<>]', '', 'g') AS text FROM blocks""")
def bbox_words(spark, sf_dir):
    """Word boxes read back from extracted XHTML."""
    tag = lambda b: F.format_string('<word xMin="%d.0" yMin="%d.0" xMax="%d.0" yMax="%d.0">%s</word>\n', b["x0"], b["y0"], b["x1"], b["y1"], F.regexp_replace(b["text"], "[<>]", ""))
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.array_join(F.transform("blocks", tag), "").alias("xhtml"))
    return rows.select("doc_id", "page", F.posexplode(files.bbox_words(F.col("xhtml"))).alias("word", "w")).select("doc_id", "page", "word", "w.*")


@query(f"{BLOCKS} SELECT doc_id, page, CAST(ord AS INTEGER) AS block, CAST(x0 AS DOUBLE) AS x0, CAST(y1 AS DOUBLE) AS y1, text FROM blocks")
def block_json(spark, sf_dir):
    """Blocks through their JSON interchange and the NUL-parted cache."""
    quad = lambda b: F.array(*[F.array(b[x].cast("double"), b[y].cast("double")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    out = F.transform("blocks", lambda b: F.struct(quad(b).alias("box"), b["text"].alias("text"), F.lit(0.9).alias("score")))
    rows = page_rows(spark, sf_dir).select("doc_id", "page", F.concat(files.block_json(out), F.lit("\x00 \n")).alias("cache"))
    pages = rows.select("doc_id", "page", F.explode(files.cache_pages(F.col("cache"))).alias("blocks")).select("doc_id", "page", F.posexplode("blocks").alias("block", "b"))
    bounds = layout.quad_bounds(F.col("b.box"))
    return pages.select("doc_id", "page", "block", bounds["x0"].alias("x0"), bounds["y1"].alias("y1"), F.col("b.text").alias("text"))


@query()
def export_docx(spark, sf_dir):
    """Size and paragraphs of a DOCX of every document."""
    rows = page_rows(spark, sf_dir).withColumn("s", paragraphs.line_stats(F.col("blocks"))).select("doc_id", F.struct("page", paragraphs.paragraphs(F.col("blocks"), F.col("s")).alias("p")).alias("p"))
    rows = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["p"]).alias("pages"))
    made = sinks.to_docx(rows, ["doc_id"])
    return made.select("doc_id", F.length("content").alias("bytes"), F.hex(F.substring("content", 1, 2)).alias("magic"))


# --- Recogniser ---------------------------------------------------------------------------------

_ALPHABET = ["", "a", "b", "c", "d", "e", " "]


def _steps(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64")
    return rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8))).alias("steps"))


@query("""WITH s AS (SELECT vec_id, t, list_max(embedding[t * 8 + 1 : t * 8 + 8]) AS p, embedding[t * 8 + 1 : t * 8 + 8] AS v FROM embeddings, (SELECT unnest(range(0, 8)) AS t)),
c AS (SELECT vec_id, t, p, 8 - list_position(list_reverse(v), p) AS c FROM s),
l AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS b FROM c),
k AS (SELECT * FROM l WHERE c <> 0 AND (b IS NULL OR b <> c) AND c < 7),
g AS (SELECT vec_id, string_agg(['', 'a', 'b', 'c', 'd', 'e', ' '][c + 1], '' ORDER BY t) AS text, round(avg(p), 5) AS score, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) AS selection FROM k GROUP BY ALL)
SELECT e.vec_id, coalesce(g.text, '') AS text, coalesce(g.score, 0.0) AS score, coalesce(g.selection, '') AS selection FROM embeddings e LEFT JOIN g USING (vec_id)""")
def ctc_decode(spark, sf_dir):
    """Greedy decoding of score steps."""
    rows = _steps(spark, sf_dir).select("vec_id", decode.greedy_decode(F.col("steps"), F.array(*map(F.lit, _ALPHABET))).alias("d"))
    return rows.select("vec_id", "d.text", F.round("d.score", 5).alias("score"), F.array_join("d.selection", ",").alias("selection"))


@query(r"""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark),
s AS (SELECT item_id, i, c, i * 2 + (i // 7) * 3 AS col FROM c), l AS (SELECT *, col - lag(col) OVER (PARTITION BY item_id ORDER BY i) AS gap FROM s),
g AS (SELECT *, sum(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS k FROM l)
SELECT item_id, CAST(k AS INTEGER) AS grp, string_agg(c, '' ORDER BY i) AS text, CAST(min(col) AS INTEGER) AS first_col, CAST(max(col) AS INTEGER) AS last_col FROM g GROUP BY item_id, k""")
def word_groups(spark, sf_dir):
    """Characters grouped by script and column gaps."""
    chars = tx.characters(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", chars.alias("chars")).withColumn("sel", F.transform("chars", lambda c, i: i * 2 + F.floor(i / 7).cast("int") * 3))
    out = rows.select("item_id", F.posexplode(decode.word_groups(F.col("chars"), F.col("sel"))).alias("grp", "g"))
    return out.select("item_id", "grp", F.col("g.text").alias("text"), F.col("g.cols")[0].alias("first_col"), F.element_at("g.cols", -1).alias("last_col"))


@query()
def character_cells(spark, sf_dir):
    """Boxes of recognised characters along a crop."""
    chars = tx.characters(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", chars.alias("chars")).withColumn("sel", F.transform("chars", lambda c, i: i * 2 + F.floor(i / 7).cast("int") * 3))
    rows = rows.withColumn("groups", decode.word_groups(F.col("chars"), F.col("sel"))).withColumn("cols", (F.size("chars") * 4 + 8).cast("double"))
    cells = decode.character_cells(F.col("groups"), F.col("cols") * 8.0, F.col("cols"), F.size("chars"))
    return rows.select("item_id", F.posexplode(cells).alias("cell", "c")).select("item_id", "cell", "c.*")


@query(r"""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark),
g AS (SELECT *, sum(CASE WHEN c = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS k FROM c),
w AS (SELECT item_id, k, string_agg(c, '' ORDER BY i) AS text, min(i) AS a, max(i) AS b FROM g WHERE c <> ' ' GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY k) - 1 AS INTEGER) AS word, text, CAST(a * 10 AS DOUBLE) AS x0, CAST(b * 10 + 8 AS DOUBLE) AS x1 FROM w""")
def space_words(spark, sf_dir):
    """Words of characters between recognised spaces, with bounds."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", tx.characters(F.col("text")).alias("chars"))
    boxes = F.transform("chars", lambda c, i: F.struct((i * 10).alias("x0"), F.lit(0).alias("y0"), (i * 10 + 8).alias("x1"), F.lit(40).alias("y1")))
    out = rows.select("item_id", F.posexplode(decode.space_words(F.col("chars"), boxes)).alias("word", "w"))
    return out.select("item_id", "word", F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), F.col("w.x1").alias("x1"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 9 AS INTEGER) AS w, 20 + l_partkey % 30 AS h FROM lineitem),
r AS (SELECT *, CAST(w AS FLOAT) / CAST(h AS FLOAT) AS ratio FROM c),
b AS (SELECT *, CAST((row_number() OVER (PARTITION BY l_orderkey ORDER BY ratio, l_linenumber) - 1) // 6 AS INTEGER) AS batch FROM r)
SELECT l_orderkey, l_linenumber, batch, round(CAST(greatest(CAST(320.0 / 48 AS FLOAT), max(ratio) OVER (PARTITION BY l_orderkey, batch)) AS DOUBLE), 4) AS batch_ratio FROM b""")
def recognition_batches(spark, sf_dir):
    """Batches of six crops by aspect ratio, as wide as the widest."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 9).cast("int").alias("w"), (20 + F.col("l_partkey") % 30).alias("h"))
    out = decode.batches(rows, ["l_orderkey"], "w", "h", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "batch", F.round(F.col("batch_ratio").cast("double"), 4).alias("batch_ratio"))


@query("""SELECT l_orderkey, l_linenumber, exp(l_tax * 100) / (exp(l_discount * 100) + exp(l_tax * 100)) > 0.9 AS turned FROM lineitem""")
def direction(spark, sf_dir):
    """Crops that stand on their heads."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decode.turned(F.col("l_discount") * 100, F.col("l_tax") * 100).alias("turned"))


@query("""WITH k AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS c FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM k WHERE c <= 1000 AND l_quantity >= 3 AND l_discount * 10 >= 0.5 AND l_partkey % 7 >= 4 AND l_quantity * 1.5 >= 5""")
def kept_boxes(spark, sf_dir):
    """Detections that stay."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("short_side"), (F.col("l_discount") * 10).alias("score"), (F.col("l_partkey") % 7).alias("path_points"), (F.col("l_quantity") * 1.5).alias("expanded_side"), F.col("l_orderkey").alias("seed_y"), F.col("l_linenumber").alias("seed_x"))
    return frames.kept_boxes(rows, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""WITH s AS (SELECT p_partkey, CAST(p_partkey * 37 % 4000 + 10 AS DOUBLE) AS w, CAST(p_size * 61 + 5 AS DOUBLE) AS h FROM part),
a AS (SELECT *, CASE WHEN greatest(w, h) > 2000 THEN floor(w * (2000 / greatest(w, h))) ELSE w END AS w1, CASE WHEN greatest(w, h) > 2000 THEN floor(h * (2000 / greatest(w, h))) ELSE h END AS h1 FROM s),
b AS (SELECT *, CASE WHEN least(w1, h1) < 30 THEN floor(w1 * (30 / least(w1, h1))) ELSE w1 END AS w2, CASE WHEN least(w1, h1) < 30 THEN floor(h1 * (30 / least(w1, h1))) ELSE h1 END AS h2 FROM a),
c AS (SELECT *, CASE WHEN w2 / h2 > 8 OR h2 <= 30 THEN floor(abs(greatest(floor(w2 / 8), 30) * 2 - h2) / 2) ELSE 0 END AS pad FROM b)
SELECT p_partkey, CAST(w2 AS INTEGER) AS width, CAST(h2 + 2 * pad AS INTEGER) AS height, CAST(pad AS INTEGER) AS pad_top, round(w / w2, 6) AS ratio_w, round(h / h2, 6) AS ratio_h,
  CAST(least(greatest(round((100 - pad) * (h / h2)), 0), h) AS INTEGER) AS back_y, w * h > 40000000 AS too_large, CAST(round(w * 20) AS INTEGER) AS twips,
  CAST(least(greatest(round(w * 200 / 72), 32), 65000) AS INTEGER) AS raster FROM c""")
def frame_transform(spark, sf_dir):
    """Sizes, padding and the way back of page frames."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4000 + 10).cast("int").alias("w"), (F.col("p_size") * 61 + 5).cast("int").alias("h"))
    rows = rows.withColumn("n", frames.normal_size(F.col("w"), F.col("h"))).withColumn("l", frames.letterbox(F.col("n.width"), F.col("n.height")))
    back = frames.to_image(F.lit(100.0), F.col("l.pad_top"), F.col("n.ratio_h"), F.col("h"))
    return rows.select("p_partkey", F.col("n.width").alias("width"), F.col("l.height").alias("height"), F.col("l.pad_top").alias("pad_top"), r6(F.col("n.ratio_w")).alias("ratio_w"), r6(F.col("n.ratio_h")).alias("ratio_h"), back.alias("back_y"), frames.too_large(F.col("w"), F.col("h")).alias("too_large"), frames.twips(F.col("w").cast("double")).alias("twips"), frames.raster_side(F.col("w").cast("double"), F.lit(200)).alias("raster"))


@query("""WITH s AS (SELECT p_partkey, p_partkey * 37 % 1500 + 40 AS w, p_size * 61 + 40 AS h FROM part),
a AS (SELECT *, CASE WHEN least(w, h) < 736 THEN CAST(736 AS FLOAT) / CAST(least(w, h) AS FLOAT) ELSE CAST(1 AS FLOAT) END AS k FROM s),
b AS (SELECT p_partkey, floor(CAST(CAST(w AS FLOAT) * k AS FLOAT)) / 32.0::DOUBLE AS x, floor(CAST(CAST(h AS FLOAT) * k AS FLOAT)) / 32.0::DOUBLE AS y FROM a)
SELECT p_partkey, CAST(round_even(x, 0) * 32 AS INTEGER) AS width, CAST(round_even(y, 0) * 32 AS INTEGER) AS height FROM b""")
def detector_size(spark, sf_dir):
    """Input sizes of the detector."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 1500 + 40).cast("int").alias("w"), (F.col("p_size") * 61 + 40).cast("int").alias("h"))
    return rows.select("p_partkey", frames.detector_size(F.col("w"), F.col("h")).alias("d")).select("p_partkey", "d.*")


@query("""WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 17 + 1 AS DOUBLE) AS b FROM part)
SELECT p_partkey, a * b AS area, 2 * a + 2 * b AS perimeter, 1.0 AS sign, round(a * b * 1.6 / (2 * a + 2 * b), 6) AS distance FROM q""")
def quad_measures(spark, sf_dir):
    """Area, perimeter, orientation and growth of quads."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 17 + 1).cast("double").alias("b"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    quad = frames.corner_order(F.array(point(F.col("a"), F.col("b")), point(zero, zero), point(F.col("a"), zero), point(zero, F.col("b"))))
    out = rows.select("p_partkey", quad.alias("q")).select("p_partkey", frames.quad_measures(F.col("q")).alias("m")).select("p_partkey", "m.*")
    return out.withColumn("distance", r6(F.col("distance")))


@query("""SELECT s_suppkey, round((100.0 + s_suppkey % 500) * 700 + 2500, 3) AS area, ((100.0 + s_suppkey % 500) * 700 + 2500) / (612.0 * 792.0) >= 0.7 AS scan FROM supplier""")
def scan_pages(spark, sf_dir):
    """Image cover of pages from their graphics operators."""
    m = lambda *v: F.array(*[x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in v])
    none = m(1, 0, 0, 1, 0, 0)
    op = lambda name, matrix=none, image=False: F.struct(F.lit(name).alias("op"), matrix.alias("m"), F.lit(image).alias("image"))
    width = 100 + F.col("s_suppkey") % 500
    ops = F.array(op("q"), op("cm", m(width, 0, 0, 350, 5, 5)), op("cm", m(0, 2, -1, 0, 0, 0)), op("Do", none, True), op("Q"), op("Q"), op("q"), op("cm", m(50, 0, 0, 50, 0, 0)), op("Do", none, True), op("Do", none, False), op("Q"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", ops.alias("ops"))
    side = lambda d: frames.media_side(F.lit(None).cast("double"), F.lit(None).cast("double"), d)
    return rows.select("s_suppkey", F.round(frames.scan_cover(F.col("ops")), 3).alias("area"), frames.is_scan(F.col("ops"), side(612.0), side(792.0)).alias("scan"))


@query()
def detect_boxes(spark, sf_dir):
    """Text boxes from probability maps: 8 x 8 maps of vectors, each value a tile of 4 x 4."""
    import numpy as np
    import pyarrow as pa

    def grow(batches):
        for b in batches:
            maps = [np.kron((np.array(v).reshape(8, 8) > 0).astype(np.float32), np.ones((4, 4), np.float32)).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["vec_id", "prob"])

    rows = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64").select("vec_id", "embedding").mapInArrow(grow, "vec_id long, prob binary")
    rows = rows.select("vec_id", "prob", F.lit(32).alias("map_width"), F.lit(32).alias("map_height"), F.lit(640).alias("width"), F.lit(640).alias("height"))
    out = geometry.detected(rows, ["vec_id"]).select("vec_id", F.posexplode("boxes").alias("box", "b"))
    return out.select("vec_id", "box", F.to_json("b.box").alias("quad"), r6(F.col("b.score")).alias("score"))


# --- Text and files -----------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT item_id, generate_subscripts(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1) AS i, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word FROM benchmark),
c AS (SELECT item_id, i, word, unnest(string_split(word, '')) AS ch FROM w), d AS (SELECT *, unicode(ch) AS u FROM c),
s AS (SELECT item_id, i, word, sum(CASE WHEN u BETWEEN 32 AND 126 THEN WIDTHS[u - 31] ELSE 500 END) AS units FROM d GROUP BY ALL)
SELECT item_id, CAST(i - 1 AS INTEGER) AS word_no, word, CAST(units AS INTEGER) AS units, round(units / 1000.0 * 12, 6) AS width FROM s""".replace("WIDTHS", str(tx.WIDTHS)))
def text_width(spark, sf_dir):
    """Natural widths of words at 12 points."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.words(F.col("text"))).alias("word_no", "word"))
    return rows.select("item_id", "word_no", "word", tx.word_units(F.col("word")).alias("units"), r6(tx.natural_width(F.col("word"), F.lit(12.0))).alias("width"))


@query(r"""SELECT item_id, upper(string_agg(printf('%04x', unicode(c)), '' ORDER BY i)) AS codes FROM
  (SELECT item_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark) GROUP BY ALL""")
def utf16_codes(spark, sf_dir):
    """Texts as UTF-16 code units (F8)."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.utf16_hex(F.col("text")).alias("codes"))


@query(r"""SELECT DISTINCT unicode(c) AS cid FROM (SELECT unnest(string_split(regexp_replace(text, '\s+', '', 'g'), '')) AS c FROM benchmark) WHERE c <> ''""")
def used_codes(spark, sf_dir):
    """Distinct code units that the benchmark's words use."""
    chars = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(tx.characters(tx.normalise(F.col("text"))))).alias("c")).distinct()
    return chars.select(F.conv(tx.utf16_hex(F.col("c")), 16, 10).cast("int").alias("cid"))


@query(r"""WITH v AS (SELECT p_partkey, 'v' || p_size || '.' || p_partkey % 7 AS a, '25.3.' || p_partkey % 2 AS b FROM part),
s AS (SELECT *, string_split(replace(a, 'v', ''), '.') AS x, string_split(b, '.') AS y FROM v)
SELECT p_partkey, a, b, [CAST(x[1] AS INTEGER), CAST(x[2] AS INTEGER), 0] > [CAST(y[1] AS INTEGER), CAST(y[2] AS INTEGER), CAST(y[3] AS INTEGER)] AS newer FROM s""")
def version_newer(spark, sf_dir):
    """Versions compared part by part, missing parts as 0."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 7).alias("a"), F.concat(F.lit("25.3."), F.col("p_partkey") % 2).alias("b"))
    return rows.withColumn("newer", tx.version_newer(F.col("a"), F.col("b")))


@query(r"""WITH u AS (SELECT page_id, url, ['.PDF', '.png', '.html', '.jpeg', ''][page_id % 5 + 1] AS x FROM pages), p AS (SELECT page_id, url || '/scan' || x AS path FROM u)
SELECT page_id, string_split(path, '/')[-1] AS name, lower(regexp_extract(path, '\.([^.]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg') AS supported,
  regexp_replace(string_split(path, '/')[-1], '(?i)\.(pdf|png|jpe?g)$', '') || '-searchable.pdf' AS target FROM p""")
def input_files(spark, sf_dir):
    """Names, support and targets of input paths."""
    end = F.element_at(F.array(*map(F.lit, [".PDF", ".png", ".html", ".jpeg", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/scan"), end).alias("path"))
    name = tx.base_name(F.col("path"))
    return rows.select("page_id", name.alias("name"), tx.is_supported(F.col("path")).alias("supported"), F.concat(tx.strip_extension(name), F.lit("-searchable.pdf")).alias("target"))


@query("""WITH p AS (SELECT n_regionkey, n_nationkey, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '.txt' ELSE '.pdf' END AS path FROM nation)
SELECT n_regionkey, arg_min(path, n_nationkey) AS path FROM p WHERE path LIKE '%.pdf' GROUP BY ALL""")
def first_file(spark, sf_dir):
    """The first supported argument."""
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, ".txt").otherwise(".pdf")).alias("path"))
    return files.first_supported(rows, ["n_regionkey"], "path", "n_nationkey")


@query("""SELECT c_custkey, c_name AS title, CAST(c_nationkey AS INTEGER) AS pages, CAST(c_custkey % 5 AS INTEGER) AS images FROM customer""")
def info_fields(spark, sf_dir):
    """Fields of an info text and lines of an image listing."""
    text = F.concat(F.lit("Title:   "), F.col("c_name"), F.lit("\nPages: "), F.col("c_nationkey"), F.lit("\nProducer: x\n"))
    listing = F.concat(F.lit("page num\n-----\n"), F.array_join(F.array_repeat(F.lit("1 0 image\n"), (F.col("c_custkey") % 5).cast("int")), ""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), listing.alias("l"))
    return rows.select("c_custkey", files.info_field(F.col("t"), "Title").alias("title"), files.info_field(F.col("t"), "Pages").cast("int").alias("pages"), files.listed_images(F.col("l")).alias("images"))


@query("""SELECT conv_id, string_agg(CASE WHEN turn > 0 THEN chr(10) || chr(10) || '--- Page ' || (turn + 1) || ' ---' || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END, '' ORDER BY turn) AS text
FROM conversations GROUP BY ALL""")
def joined_turns(spark, sf_dir):
    """Turns of conversations joined like pages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("t"))
    return layout.joined_pages(rows, ["conv_id"], "page", "t")


@query("""WITH a AS (SELECT o_custkey % 100 AS k FROM orders), b AS (SELECT c_custkey % 70 AS k FROM customer)
SELECT 'both' AS op, k, count(*) AS n FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b) GROUP BY ALL
UNION ALL SELECT 'rest', k, count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) GROUP BY ALL
UNION ALL SELECT 'all', k, count(*) FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY ALL
UNION ALL SELECT 'set', k, 1 FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def multisets(spark, sf_dir):
    """Intersection, difference and union of multisets, from one count of both sides."""
    side = lambda t, c, m, a, b: table(spark, sf_dir, t).select((F.col(c) % m).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    n = side("orders", "o_custkey", 100, 1, 0).unionByName(side("customer", "c_custkey", 70, 0, 1)).groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    row = lambda op, v: F.struct(F.lit(op).alias("op"), v.cast("long").alias("n"))
    ops = F.array(row("both", F.least("a", "b")), row("rest", F.greatest(F.col("a") - F.col("b"), F.lit(0))), row("all", F.col("a") + F.col("b")), row("set", F.lit(1)))
    return n.select("k", F.inline(ops)).filter("n > 0").select("op", "k", "n")


@query("""WITH r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS tm, 'fp' || user_id % 3 AS fp FROM events), n AS (SELECT max(tm) AS now FROM r),
f AS (SELECT user_id, coalesce(min(CASE WHEN fp = '' OR fp = 'fp1' THEN tm END), max(now)) AS started_at FROM r, n GROUP BY ALL),
d AS (SELECT user_id, started_at, greatest(now - started_at, 0) // 86400 AS used, user_id % 11 = 0 AS lic FROM f, n)
SELECT user_id, started_at, CASE WHEN lic THEN 'licensed' WHEN used >= 7 THEN 'expired' ELSE 'trialing' END AS status, CAST(CASE WHEN NOT lic AND used < 7 THEN 7 - used END AS INTEGER) AS days_left FROM d""")
def trial_status(spark, sf_dir):
    """First event, elapsed days and status of every user."""
    events = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    now = events.agg(F.max("at").alias("now"))
    record = status.parse_record(F.concat(F.col("at"), F.lit("|fp"), F.col("user_id") % 3))
    rows = events.select("user_id", record.alias("r")).select("user_id", "r.*").join(F.broadcast(now))
    first = status.first_start(rows, ["user_id"], F.lit("fp1"), F.col("now")).join(F.broadcast(now))
    state = status.status(F.col("user_id") % 11 == 0, F.col("started_at"), F.col("now"))
    return first.select("user_id", "started_at", state.alias("s")).select("user_id", "started_at", "s.*")


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    """Events by hour: the streaming aggregate over a table."""
    from quirelight.streaming.stream import windowed_counts

    out = windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
