"""Registered queries of page joins, file sources, images and written documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import frames, geometry, images, joins, layout, metrics, status
from quirelight.plans.registry import BLOCKS, query, r6, table
from quirelight.sources import bridge, files, sinks

# --- Joins by position --------------------------------------------------------------------------

_PAGES = f"""{BLOCKS}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS t FROM blocks GROUP BY ALL),
last AS (SELECT doc_id, max(page) AS last FROM p GROUP BY ALL)"""


def _texts(spark, sf_dir) -> DataFrame:
    return bridge.pages(spark, sf_dir).select("doc_id", "page", layout.page_text(F.col("blocks")).alias("t"))


@query(f"""{_PAGES},
d AS (SELECT doc_id, coalesce(string_agg(t, chr(12) ORDER BY page) FILTER (doc_id % 3 <> 0 OR page < last), '') AS truth FROM p JOIN last USING (doc_id) GROUP BY ALL),
s AS (SELECT doc_id, unnest(string_split(truth, chr(12))) AS truth, generate_subscripts(string_split(truth, chr(12)), 1) AS page FROM d)
SELECT p.doc_id, p.page, length(p.t) AS got_chars, length(coalesce(s.truth, '')) AS truth_chars FROM p LEFT JOIN s USING (doc_id, page)""")
def padded_truth(spark, sf_dir):
    """Pages beside the truth that form feeds part, empty where it has no such page; here some truths lack their last."""
    lines = bridge.documents(spark, sf_dir).select("doc_id", bridge.lines_of(F.col("text")).alias("lines"))
    count = F.ceil(F.size("lines") / bridge.PAGE).cast("int") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    page = lambda p: F.array_join(F.slice("lines", p * bridge.PAGE + 1, bridge.PAGE), "\n")
    whole = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), page), "\f")).otherwise("")
    truth = lines.select("doc_id", whole.alias("text")).select("doc_id", F.posexplode(files.page_texts(F.col("text"))).alias("p", "truth"))
    out = joins.padded(_texts(spark, sf_dir), truth.select("doc_id", (F.col("p") + 1).alias("page"), "truth"), ["doc_id"], "page", {"truth": F.lit("")})
    return out.select("doc_id", "page", F.length("t").alias("got_chars"), F.length("truth").alias("truth_chars"))


@query(f"""{BLOCKS}, n AS (SELECT doc_id, page, count(*) AS n FROM blocks GROUP BY ALL)
SELECT doc_id, page, CASE WHEN page % 4 = 0 THEN 0 ELSE n END AS blocks FROM n""")
def padded_blocks(spark, sf_dir):
    """Pages of a file beside their recognised blocks, no blocks where there are none; here each fourth page."""
    pages = bridge.pages(spark, sf_dir)
    known = pages.filter(F.col("page") % 4 != 0).select("doc_id", "page", "blocks")
    kind = known.schema["blocks"].dataType.simpleString()
    out = joins.padded(pages.select("doc_id", "page"), known, ["doc_id"], "page", {"blocks": F.expr(f"CAST(array() AS {kind})")})
    return out.select("doc_id", "page", F.size("blocks").alias("blocks"))


@query(f"{BLOCKS} SELECT doc_id, page, CAST(ord AS INTEGER) AS line, x0, y0, length(text) AS chars FROM blocks WHERE ord < 20")
def zipped_lines(spark, sf_dir):
    """Boxes and recognised texts of a page that share a position; here the first twenty lines have texts."""
    lines = bridge.pages(spark, sf_dir).select("doc_id", "page", F.posexplode("blocks").alias("line", "b"))
    boxes = lines.select("doc_id", "page", "line", "b.x0", "b.y0")
    texts = lines.filter("line < 20").select("doc_id", "page", "line", F.length("b.text").alias("chars"))
    return joins.by_position(boxes, texts, ["doc_id", "page"], "line")


@query("""WITH w AS (SELECT l_suppkey, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_linenumber END AS page FROM lineitem),
c AS (SELECT l_suppkey, page, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT l_suppkey, count(*) AS pages FROM c GROUP BY ALL)
SELECT * FROM c JOIN d USING (l_suppkey)""")
def sidecar_pages(spark, sf_dir):
    """Words of a sidecar by page, 0 without one, and the pages it covers."""
    words = table(spark, sf_dir, "lineitem").select("l_suppkey", F.nullif(F.col("l_linenumber"), F.lit(3)).alias("page"))
    return joins.page_counts(words, ["l_suppkey"], "page").join(joins.covered(words, ["l_suppkey"], "page"), "l_suppkey")


@query("""SELECT d.doc_id, d.doc_id % 4 <> 0 AS cached, CASE WHEN d.doc_id % 4 <> 0 THEN length(coalesce(text, '')) ELSE 0 END AS chars FROM documents d""")
def cache_presence(spark, sf_dir):
    """Documents with their caches, and those without one; here each fourth."""
    docs = bridge.documents(spark, sf_dir)
    caches = docs.filter(F.col("doc_id") % 4 != 0).select("doc_id", F.length("text").alias("chars"))
    return joins.with_cache(docs.select("doc_id"), caches, ["doc_id"]).select("doc_id", "cached", F.coalesce("chars", F.lit(0)).alias("chars"))


@query("""SELECT conv_id, count(*) AS pages FROM conversations WHERE turn + 1 <= 2 GROUP BY ALL""")
def capped_pages(spark, sf_dir):
    """Pages up to a cap that the caller sets, here two."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"))
    return joins.first_pages(pages, "page", 2).groupBy("conv_id").agg(F.count("*").alias("pages"))


@query("""WITH d AS (SELECT l_suppkey, l_quantity >= 45 AS counts, l_discount - l_tax AS delta FROM lineitem)
SELECT l_suppkey, count(*) FILTER (counts) AS pages, count(*) FILTER (counts AND delta > 0.005) AS better, count(*) FILTER (counts AND delta < -0.005) AS worse,
  round(coalesce(sum(CASE WHEN counts THEN delta END), 0) / greatest(count(*) FILTER (counts), 1), 6) AS mean_delta FROM d GROUP BY ALL""")
def delta_totals(spark, sf_dir):
    """Pages that count, those better and worse, and the mean difference, 0 without pages."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") >= 45, 20).otherwise(19).alias("chars"), (F.col("l_discount") - F.col("l_tax")).alias("delta"))
    return metrics.delta_totals(rows, ["l_suppkey"]).withColumn("mean_delta", r6(F.col("mean_delta")))


# --- Predicates ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 >= 0.5")
def confident_lines(spark, sf_dir):
    """Recognised lines that stay."""
    return table(spark, sf_dir, "lineitem").filter(frames.confident(F.col("l_discount") * 10)).select("l_orderkey", "l_linenumber")


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 <> 0 AS strips,
  CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 <> 0 THEN 'BT,Tf,ET' ELSE 'BT,Tf,Tj,TJ,'',",ET' END AS ops FROM supplier""")
def stripped_operators(spark, sf_dir):
    """Graphics operators of pages, without those that show text where a page's text is replaced."""
    key = F.col("s_suppkey")
    ops = F.array(*map(F.lit, ["BT", "Tf", "Tj", "TJ", "'", '"', "ET"]))
    strips = frames.strips_text(key % 2 == 0, F.array_repeat(F.lit("b"), (key % 3).cast("int")), key % 5 != 0)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", strips.alias("strips"))
    kept = F.when(F.col("strips"), F.filter(ops, lambda o: ~frames.shows_text(o))).otherwise(ops)
    return rows.withColumn("ops", F.array_join(kept, ","))


@query("""SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS accepted, starts_with(c_name, 'Customer#00000001') OR starts_with(c_name, 'mailto:') AS allowed FROM customer""")
def accepted_codes(spark, sf_dir):
    """Codes that are accepted, by exact case, and addresses that begin as allowed."""
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", status.accepts(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("accepted"), status.allowed(F.col("c_name"), ["Customer#00000001", "mailto:"]).alias("allowed"))


# --- Files --------------------------------------------------------------------------------------


@query("""SELECT * FROM (VALUES (1, 'benchmark.parquet'), (2, 'conversations.parquet'), (3, 'customer.parquet')) AS t(place, name)""")
def first_inputs(spark, sf_dir):
    """The first three files of a folder by name, a table of several part files being one."""
    found = files.first_entries(spark, [sf_dir], "*.parquet", 3).select(tx.base_name(F.col("path")).alias("name"))
    # three rows: one array holds them in order
    return found.agg(F.array_sort(F.collect_list("name")).alias("names")).select(F.posexplode("names").alias("p", "name")).select((F.col("p") + 1).alias("place"), "name")


_HEADER = """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 5000 + 1 END AS width, CASE WHEN p_partkey % 3 < 2 THEN p_size * 61 + 5 END AS height FROM part)
SELECT *, coalesce(width * height > 40000000, FALSE) AS too_large FROM s"""


@query(_HEADER)
def image_headers(spark, sf_dir):
    """Sizes of JPEG and PNG images by their headers, none for other bytes; some have junk before a marker."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5000 + 1).cast("int").alias("w"), (F.col("p_size") * 61 + 5).cast("int").alias("h"))
    number = lambda c, n: F.lpad(F.hex(F.col(c)), n, "0")
    junk = F.when(F.col("p_partkey") % 2 == 0, "00AA").otherwise("")
    frame = F.concat(F.lit("FFC"), (F.col("p_partkey") % 3).cast("string"), F.lit("001108"), number("h", 4), number("w", 4))
    jpeg = F.concat(F.lit("FFD8FFE000040000"), junk, frame, F.lit("0301220002110103110100"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number("w", 8), number("h", 8), F.lit("0802000000"))
    kind = F.col("p_partkey") % 3
    raw = rows.select("p_partkey", F.unhex(F.when(kind == 0, jpeg).when(kind == 1, png).otherwise("255044462D312E35")).alias("content"))
    out = geometry.image_sizes(raw, ["p_partkey"])
    return out.withColumn("too_large", F.coalesce(frames.too_large(F.col("width"), F.col("height")), F.lit(False)))


# --- Images -------------------------------------------------------------------------------------


def _pixels(c: Column) -> Column:
    """Values as bytes: floor(100 (x + 1)), between 0 and 255, 0 for none."""
    value = lambda x: F.coalesce(F.least(F.greatest(F.floor((x.cast("double") + 1) * 100), F.lit(0)), F.lit(255)), F.lit(0))
    return F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(value(x)), 2, "0")), ""))


def _image(pixels: Column, width: Column, height: Column) -> Column:
    return F.struct(pixels.alias("pixels"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(1).alias("channels"))


def _rows_of_pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("size(embedding) > 0")


_PIXELS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(least(greatest(floor((CAST(x AS DOUBLE) + 1) * 100), 0), 255), 0)) AS v FROM embeddings WHERE len(embedding) > 0)"""


@query(f"""{_PIXELS}, i AS (SELECT vec_id, v, len(v) AS n, unnest(range(0, 2 * len(v))) AS i FROM e),
s AS (SELECT *, greatest(least((i + 0.5::DOUBLE) / 2 - 0.5, n - 1), 0) AS s FROM i),
p AS (SELECT vec_id, floor(v[CAST(floor(s) AS INTEGER) + 1] * (1 - (s - floor(s))) + v[CAST(least(floor(s) + 1, n - 1) AS INTEGER) + 1] * (s - floor(s)) + 0.5) AS p FROM s)
SELECT vec_id, count(*) AS bytes, round(avg((p / 255 - 0.5) / 0.5), 5) AS mean FROM p GROUP BY ALL""")
def resized_images(spark, sf_dir):
    """Images of one row at twice their width, and the mean of their tensors."""
    rows = _rows_of_pixels(spark, sf_dir).select("vec_id", _pixels(F.col("embedding")).alias("pixels"), F.size("embedding").alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"))
    out = images.resized(rows.withColumns({"to_width": F.col("width") * 2, "to_height": F.lit(1)}), ["vec_id"], "to_width", "to_height")
    return out.select("vec_id", F.length("pixels").alias("bytes"), F.round("mean", 5).alias("mean"))


@query(f"""{_PIXELS}, d AS (SELECT vec_id, unnest(v) AS a, unnest(list_reverse(v)) AS b, len(v) AS n FROM e)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 AND max(n) > 1 THEN -1.0 ELSE round(avg(abs(a - b)), 6) END AS difference FROM d GROUP BY vec_id""")
def image_differences(spark, sf_dir):
    """Mean difference of images and their mirror images, -1 where one stands upright."""
    n, mirrored = F.size("embedding"), _pixels(F.reverse("embedding"))
    upright = F.col("vec_id") % 10 == 0
    other = _image(mirrored, F.when(upright, 1).otherwise(n), F.when(upright, n).otherwise(1))
    rows = _rows_of_pixels(spark, sf_dir).select("vec_id", _image(_pixels(F.col("embedding")), n, F.lit(1)).alias("a"), other.alias("b"))
    return images.differences(rows, ["vec_id"]).withColumn("difference", r6(F.col("difference")))


@query("""WITH q AS (SELECT p_partkey, p_partkey % 30 AS x, p_size % 20 AS y, p_partkey % 7 * 5 AS w, p_size % 9 * 4 AS h FROM part)
SELECT p_partkey, CAST(CASE WHEN w = 0 OR h = 0 THEN 1 WHEN h / w >= 1.5 THEN h ELSE w END AS INTEGER) AS width,
  CAST(CASE WHEN w = 0 OR h = 0 THEN 1 WHEN h / w >= 1.5 THEN w ELSE h END AS INTEGER) AS height, w = 0 OR h = 0 AS empty, TRUE AS even FROM q""")
def crops(spark, sf_dir):
    """Crops of an image of one grey: upright, tall ones turned, one black pixel without a side."""
    x, y, w, h = F.col("p_partkey") % 30, F.col("p_size") % 20, F.col("p_partkey") % 7 * 5, F.col("p_size") % 9 * 4
    point = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    quad = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    grey = F.unhex(F.repeat(F.lit("80"), F.lit(64 * 64)))
    rows = table(spark, sf_dir, "part").select("p_partkey", grey.alias("pixels"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(1).alias("channels"), quad.alias("quad"))
    out = images.cropped(rows, ["p_partkey"])
    # values are cut, not rounded, so the grey may be one darker
    even = F.hex("pixels").rlike("^(80|7F)+$") | (F.hex("pixels") == "00")
    return out.select("p_partkey", "width", "height", (F.hex("pixels") == "00").alias("empty"), even.alias("even"))


@query("""WITH q AS (SELECT p_partkey, p_partkey % 300 AS x, p_size * 3 AS y, 20 + p_size % 10 AS h, unnest(['ab', 'c']) AS text, unnest([0, 60]) AS a, unnest([50, 90]) AS b FROM part)
SELECT p_partkey, text, format('{},{} {},{} {},{} {},{}', x + a, y, x + a, y + h, x + b, y + h, x + b, y) AS quad FROM q""")
def word_quads(spark, sf_dir):
    """Words of a crop as boxes in the image, from the corner nearest the top left; empty ones are left out."""
    x, y, h = F.col("p_partkey") % 300, F.col("p_size") * 3, 20 + F.col("p_size") % 10
    point = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    cell = lambda text, a, b: F.struct(F.lit(text).alias("text"), F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    cells = F.array(cell("ab", 0, 50), cell("", 50, 60), cell("c", 60, 90), cell("d", 95, 95))
    quad = F.array(point(x, y), point(x + 200, y), point(x + 200, y + h), point(x, y + h))
    rows = table(spark, sf_dir, "part").select("p_partkey", cells.alias("cells"), quad.alias("quad"), F.lit(200.0).alias("width"), h.cast("double").alias("height"), F.lit(False).alias("turned"))
    out = images.word_quads(rows, ["p_partkey"]).select("p_partkey", F.explode("words").alias("w"))
    return out.select("p_partkey", F.col("w.text").alias("text"), F.array_join(F.transform("w.quad", lambda p: F.array_join(p.cast("array<string>"), ",")), " ").alias("quad"))


@query()
def degraded_images(spark, sf_dir):
    """Degraded copies of images and how far they are from the clean one."""
    n = F.size("embedding")
    kinds = F.explode(F.array(*map(F.lit, ["clean", "skew1", "skew2", "dpi150", "noise"])))
    rows = _rows_of_pixels(spark, sf_dir).select("vec_id", kinds.alias("kind"), _pixels(F.flatten(F.array_repeat("embedding", 16))).alias("pixels"), n.alias("width"), F.lit(16).alias("height"), F.lit(1).alias("channels"))
    made = images.degraded(rows.withColumns({"seed": F.col("vec_id"), "clean": F.col("pixels"), "same": F.col("kind")}), ["vec_id", "kind", "clean", "width"], "same", "seed")
    pair = made.select("vec_id", "kind", _image(F.col("clean"), F.col("width"), F.lit(16)).alias("a"), _image(F.col("pixels"), F.col("width"), F.lit(16)).alias("b"))
    return images.differences(pair, ["vec_id", "kind"]).withColumn("difference", F.round("difference", 3))


# --- Written documents --------------------------------------------------------------------------


@query("""SELECT s_suppkey, '%PDF-1.5' AS head, TRUE AS jpeg_kept, printf('%.2f %.2f', (300 + s_suppkey % 100) * 0.36::DOUBLE, 400 * 0.36::DOUBLE) AS media, 8 AS objects FROM supplier""")
def image_pdfs(spark, sf_dir):
    """One-page PDF files around images: the image's bytes unchanged, a font, a page of its size at 200 dpi."""
    key = F.col("s_suppkey")
    jpeg = F.unhex(F.concat(F.lit("FFD8FFE000040000"), F.lpad(F.hex(key), 8, "0"), F.lit("FFD9")))
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(60.0).alias("y1"), F.col("s_name").alias("text"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", jpeg.alias("jpeg"), (300 + key % 100).cast("int").alias("width"), F.lit(400).alias("height"), F.lit(200.0).alias("dpi"), F.array(box).alias("blocks"))
    out = sinks.to_pdf(rows, ["s_suppkey", "jpeg"])
    text = F.decode(F.col("content"), "ISO-8859-1")
    kept = F.hex("content").contains(F.hex("jpeg"))
    media = F.regexp_extract(text, r"/MediaBox \[0 0 ([0-9.]+ [0-9.]+)\]", 1)
    return out.select("s_suppkey", F.substring(text, 1, 8).alias("head"), kept.alias("jpeg_kept"), media.alias("media"), F.regexp_count(text, F.lit(r"(?m)^[0-9]+ 0 obj$")).alias("objects"))
