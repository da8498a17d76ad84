"""Personal data: base patterns, and information-theoretic sanitisation of the terms that reveal it.

Everything is a DataFrame expression. Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
The method then asks which other terms disclose a protected entity (a base span's text). Terms are the words of a text
outside its base spans, lower-cased and without punctuation at their ends. For a term t and an entity e, the corpus gives

    PMI(t; e) = log2(p(t, e) / (p(t) p(e))),   information of e = -log2 p(e),

and t discloses e where PMI(t; e) >= DISCLOSURE * information of e, that is, where seeing t all but tells e. p counts
documents of the whole corpus; t and e stand together where one document holds both, at any distance, and they must do so
in SUPPORT different texts, so copies of a text prove nothing. Disclosing terms become spans of kind "term" at all their
places in every document that holds the entity; sanitise() generalises base spans to their kind and removes disclosing terms.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; a text that
copies repeat supports a pair once; very long texts are matched in linear time (possessive patterns, no retry inside a run); an
empty table gives no rows; columns other than doc_id and text are carried by sanitise() alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelight.llm.common import durable, text_of

#: Share of an entity's information that a term must give away.
DISCLOSURE = 0.8
#: Different texts in which a term must stand with an entity: one text cannot tell a name from its other words.
SUPPORT = 2
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that no position inside a run is tried again: the same matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
NO_SPANS = "CAST(array() AS array<struct<kind:string,first:int,last:int,value:string>>)"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.concat(F.lit("0"), F.regexp_replace(p, "^0+", ""))
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(number(p)) <= 4, number(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = digits(value)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind: matches of the pattern, their places from the lengths of the pieces between them."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), x["value"].alias("value"))
        return F.struct(last.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    spans = F.filter(spans, lambda s: valid(kind, s["value"]))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.expr(NO_SPANS))


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans by start, then kind as listed."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["first"].alias("first"), place[s["kind"]].alias("order"), s["last"].alias("last"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.array_sort(keyed)


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])))


def base_spans(docs: DataFrame) -> DataFrame:
    """The table with a column `base`: the base spans of each row's text, ordered."""
    out = docs
    for kind in KINDS:
        out = out.withColumn(f"_{kind}", kind_spans(text_of(), kind))
    out = out.withColumn("base", in_order(F.concat(*[F.col(f"_{k}") for k in KINDS]), KINDS))
    return out.drop(*[f"_{k}" for k in KINDS])


WORD = r"[^\x20\x09-\x0D]+"
#: Punctuation at the ends of a word; the look-behind keeps runs inside of it from being tried again.
ENDS = r"^[\p{P}\p{S}]++|(?<![\p{P}\p{S}])[\p{P}\p{S}]++$"


def outside(text: Column, base: Column) -> Column:
    """The text with spaces in place of its base spans, at the same places."""
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        at = F.greatest(acc["at"], s["first"])
        end = F.greatest(at, s["last"])
        parts = F.array(F.substring(text, acc["at"] + 1, at - acc["at"]), F.repeat(F.lit(" "), end - at))
        return F.struct(end.alias("at"), F.concat(acc["parts"], parts).alias("parts"))

    rest = lambda acc: F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, F.array_join(F.aggregate(base, start, step, rest), "")).otherwise(text)


def term_of(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, ENDS, ""))


def terms_of(text: Column) -> Column:
    """The different terms of a text; words of one character are none."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    return F.filter(F.array_distinct(F.transform(words, term_of)), lambda t: F.length(t) > 1)


def places(texts: DataFrame) -> DataFrame:
    """(row, term, first, last) for every word of `free`; places are running sums, in linear time for long texts."""
    hits, gaps = F.regexp_extract_all("free", F.lit(WORD), F.lit(0)), F.split("free", WORD, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("word")))
    words = texts.select("row", F.posexplode(pairs).alias("i", "w")).select("row", "i", "w.*")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    lead = F.length(F.regexp_extract("word", r"^[\p{P}\p{S}]*+", 0))
    words = words.withColumn("first", (end - F.length("word") + lead).cast("int"))
    return words.select("row", term_of(F.col("word")).alias("term"), "first", (F.col("first") + F.length(F.regexp_replace("word", ENDS, ""))).alias("last"))


def disclosing_terms(docs: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(row, term): the terms that exceed the threshold for an entity of the text; None where no entity has support.

    What is dropped before pairs are made cannot pass: a disclosing pair has df(t) <= both * (N / of_entity) ** (1 - DISCLOSURE),
    and `both` is at most the documents of e and at most the documents that hold t and any entity with support.
    """
    every = texts.select("row", "copies", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    entities = every.groupBy("entity").agg(F.sum("copies").alias("of_entity"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT)
    entities = durable(entities.select("entity", "of_entity"), "entities")
    low, high = entities.agg(F.min("of_entity"), F.max("of_entity")).first()
    if low is None:
        return None
    total = docs.count()
    members = durable(every.drop("copies").join(entities, "entity"), "members")
    words = texts.join(members.select("row").distinct(), "row").select("row", "copies", F.explode(terms_of(outside(F.col("text"), F.col("base")))).alias("term"))
    words = durable(words, "words")
    beside = words.groupBy("term").agg(F.sum("copies").alias("beside"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT)
    # document frequency over the whole corpus, counted before any join: partial counts go ahead of the shuffle
    spread = base_spans(docs).select(F.explode(terms_of(outside(text_of(), F.col("base")))).alias("term"))
    df = spread.groupBy("term").agg(F.count("*").alias("of_term"))
    ratio = lambda n: F.pow(F.lit(float(total)) / n, F.lit(1 - DISCLOSURE)) * 1.000001
    most = F.least(F.col("beside") * ratio(F.lit(low)), F.lit(high) * ratio(F.lit(high)))
    vocabulary = durable(beside.join(df, "term").filter(F.col("of_term") <= most).select("term", "beside", "of_term"), "vocabulary")
    fits = F.col("of_term") <= F.least("beside", "of_entity") * ratio(F.col("of_entity"))
    pairs = words.join(vocabulary, "term").join(members, "row").filter(fits)
    pairs = durable(pairs.select("row", "copies", "entity", "of_entity", "term", "of_term"), "pairs")
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("support"), F.first("of_entity").alias("of_entity"), F.first("of_term").alias("of_term"))
    pmi = F.log2(F.col("both") * F.lit(float(total)) / (F.col("of_term").cast("double") * F.col("of_entity")))
    information = F.log2(F.lit(float(total)) / F.col("of_entity"))
    found = counted.filter((F.col("support") >= SUPPORT) & (information > 0) & (pmi >= DISCLOSURE * information))
    found = durable(found.select("entity", "term"), "disclosing")
    return durable(pairs.select("row", "entity", "term").join(found, ["entity", "term"]).select("row", "term").distinct(), "hits")


def find(docs: DataFrame) -> DataFrame:
    """The table with `row`, `base` and `terms` (the method's spans), for every row."""
    # rows that repeat a text have the same spans and share a key
    rows = docs.withColumn("text", text_of()).withColumn("row", F.xxhash64("text"))
    with_spans = base_spans(rows)
    texts = with_spans.filter(F.size("base") > 0).groupBy("row").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("copies"))
    texts = durable(texts, "texts")
    hits = disclosing_terms(docs.select("text"), texts)
    if hits is None or not hits.take(1):
        return with_spans.withColumn("terms", F.slice("base", 1, 0))
    free = texts.join(hits.select("row").distinct(), "row").select("row", outside(F.col("text"), F.col("base")).alias("free"))
    hit = F.struct("first", F.lit(len(KINDS)).alias("order"), "last", F.lit("term").alias("kind"), F.col("term").alias("value"))
    terms = places(free).join(hits, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(hit)).alias("terms"))
    return with_spans.join(durable(terms, "terms"), "row", "left").withColumn("terms", F.coalesce("terms", F.slice("base", 1, 0)))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans for every row."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "terms"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The same table with each base span generalised to its kind in brackets and each disclosing term removed.

    Where spans overlap, the one that starts first is replaced and the others inside it go with it.
    """
    # the row's columns travel as one, so that none of them can clash with a working column
    found = find(docs.select(F.struct(*docs.columns).alias("rest"), "doc_id", "text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        fresh = s["first"] >= acc["at"]
        text = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["first"] - acc["at"]), label)
        return F.struct(F.when(fresh, s["last"]).otherwise(F.greatest(acc["at"], s["last"])).alias("at"), F.when(fresh, text).otherwise(acc["out"]).alias("out"))

    every = F.array_sort(F.concat("base", "terms"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    text = F.when(F.size(every) > 0, F.aggregate(every, start, step, rest)).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]
    out = found.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
