"""Line items of statements: labelled rows of numbers, read from page texts with windows over the lines.

A line belongs to one class, tested in this order: pair header, noise, date header, heading or label text, numbers.
Everything that depends on other lines is a window: the two-column latch runs over the document, label texts that
wait for their numbers and the look-ahead to a prior-year row run within the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora.functions import text as T

_WORDS = r"[a-zA-ZäöüÄÖÜß]"
_SEAM = r"(?U)\d\s+[A-ZÄÖÜ]"


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, n (place on the page), line: repaired, and cut where two lines were glued."""
    rows = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    rows = rows.select("doc_id", "page", "k", T.repair_numbers(F.regexp_replace("line", r"(?U)\s+$", "")).alias("line"))
    parts = F.when(F.col("line").rlike(_SEAM), T.unglue(F.col("line"))).otherwise(F.array("line"))
    rows = rows.select("doc_id", "page", "k", F.posexplode(parts).alias("sub", "line"))
    return rows.select("doc_id", "page", (F.col("k") * 100 + F.col("sub")).alias("n"), "line")


def _page_kinds(pages: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("text", F.lit("")))
    asset = F.contains(low, F.lit("buchwert")) & F.contains(low, F.lit("anschaff"))
    moves = F.contains(low, F.lit("stand")) & low.rlike("zuweisung|verwendung|verbrauch|aufloesung|auflösung")
    sheet = low.rlike(r"(?U)\baktiva\b|\bpassiva\b|gewinn-?\s*und\s*verlustrechnung")
    return pages.select("doc_id", "page", asset.alias("asset"), moves.alias("moves"), (sheet & ~asset & ~moves).alias("two"))


def _classified(pages: DataFrame, noise: tuple[str, ...]) -> DataFrame:
    line = F.col("line")
    kind = (
        F.when(T.is_pair_header(line), "pair").when(T.is_noise(line, noise), "noise").when(T.is_date_header(line), "pair").otherwise("text"))
    rows = lines(pages).join(_page_kinds(pages), ["doc_id", "page"]).withColumn("kind", kind).withColumn("ln", T.label_and_numbers(line))
    rows = rows.select("*", F.col("ln.label").alias("own"), F.col("ln.values").alias("nums")).drop("ln")
    kind = F.when(F.col("kind") != "text", F.col("kind")).when(F.size("nums") > 0, "numbers").when(F.col("own") == "", "blank").when(T.is_section_heading(F.col("own")), "heading").otherwise("label")
    return rows.withColumn("kind", kind)


def _labelled(rows: DataFrame) -> DataFrame:
    page = Window.partitionBy("doc_id", "page").orderBy("n")
    by_doc = Window.partitionBy("doc_id").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    resets = F.coalesce(F.sum(F.col("kind").isin("pair", "noise", "heading", "numbers").cast("int")).over(before), F.lit(0))
    rows = rows.select("*", (F.max((F.col("two") | (F.col("kind") == "pair")).cast("int")).over(by_doc) == 1).alias("latch"), F.lead("line").over(page).alias("next"), F.coalesce(F.lead("own").over(page), F.lit("")).alias("next_own"), F.coalesce(F.lead("nums").over(page), T.no_values()).alias("next_nums"), resets.alias("g"))
    since = Window.partitionBy("doc_id", "page", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.collect_list(F.when(F.col("kind") == "label", F.col("own"))).over(since)
    rows = rows.withColumn("waiting", waiting)
    last2 = F.when(F.size("waiting") <= 2, F.col("waiting")).otherwise(F.slice("waiting", -2, 2))
    several = F.size(F.filter(F.split("own", r"(?U)\s+"), lambda w: w.rlike(_WORDS))) >= 2
    account = F.regexp_extract("own", r"(?U)^(\d{4,5})\s+(?=[A-Za-zÄÖÜäöüß])", 1)
    rest = F.when(account != "", F.regexp_replace("own", r"(?U)^\d{4,5}\s+(?=[A-Za-zÄÖÜäöüß])", "")).otherwise(F.col("own"))
    joined = F.array_join(F.filter(F.concat(F.array(account), last2, F.array(rest)), lambda x: x != ""), " ")
    label = F.trim(F.when(several, F.col("own")).otherwise(joined))
    label = F.when(F.col("asset"), F.trim(F.regexp_replace(label, r"(?U)^\d{1,4}[.)]?\s+", ""))).otherwise(label)
    return rows.withColumn("label", F.when(F.col("kind") == "numbers", label))


def extract_items(pages: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """schemas.ITEMS in reading order, first of equal items only; restrict pages with ranges.within() before."""
    rows = _labelled(_classified(pages, noise))
    prior_line = F.trim(F.col("next")).rlike(r"(?Ui)^vorjahr\b")
    rows = rows.select(
        "*", ((F.col("kind") == "numbers") & T.is_label(F.col("label"))).alias("good"),
        F.when(prior_line, T.label_and_numbers(F.regexp_replace(F.trim("next"), r"(?Ui)^vorjahr[\s.:]*", ""))["values"]).otherwise(T.no_values()).alias("prior"))
    n = F.size("nums")
    by_prior = F.size("prior") > 0
    numeric = (F.size("next_nums") > 0) & ~F.col("next_own").rlike(_WORDS)
    by_row = ~by_prior & F.col("asset") & ~(F.col("latch") & (n == 2)) & (n < 11) & numeric & (F.size("next_nums") >= F.greatest(F.lit(1), n - 2))
    rows = rows.select("*", (F.col("good") & by_prior).alias("r1"), (F.col("good") & by_row).alias("r2"))
    # A line that takes in its successor; in a run of such lines every other one is taken in itself.
    page = Window.partitionBy("doc_id", "page").orderBy("n")
    may = F.col("r1") | F.col("r2")
    rows = rows.withColumn("run", F.sum((~may).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy("doc_id", "page", "run", may).orderBy("n"))
    rows = rows.withColumn("takes", may & (place % 2 == 1))
    rows = rows.withColumn("taken", F.coalesce(F.lag("takes").over(page), F.lit(False))).where("good and not taken")
    pair = F.col("latch") & (n >= 2) & ~F.col("asset") & ~F.col("moves")
    wide = F.col("asset") & (n >= 11)
    one = lambda i: F.array(F.element_at("nums", i))
    cur = F.when(F.col("r1"), F.col("nums")).when(F.col("r2"), F.col("next_nums")).when(pair, one(1)).when(wide, one(-1)).otherwise(F.col("nums"))
    pri = F.when(F.col("r1"), F.col("prior")).when(F.col("r2"), F.col("nums")).when(pair, one(2)).when(wide, one(-2)).otherwise(T.no_values())
    found = rows.select("doc_id", "page", F.lit(0).alias("part"), F.col("n").cast("long").alias("at"), F.left("label", F.lit(200)).alias("label"), cur.alias("current_values"), pri.alias("prior_values"), F.col("line").alias("source_line"), F.col("r2").alias("double_row"))
    found = found.unionByName(inline_pairs(pages).withColumns({"part": F.lit(1), "double_row": F.lit(False)}))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "part", "at"))
    return first_of_equal(found.select("doc_id", (order - 1).cast("long").alias("item_ord"), "label", "page", "current_values", "prior_values", "source_line", "double_row"))


def first_of_equal(items: DataFrame) -> DataFrame:
    """The first item of each key with equal rounded values."""
    cents = lambda c: F.transform(c, lambda v: v.cast("decimal(18,2)"))
    same = Window.partitionBy("doc_id", T.normalise_label(F.col("label")), cents("current_values"), cents("prior_values")).orderBy("item_ord")
    return items.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")


def inline_pairs(pages: DataFrame) -> DataFrame:
    """Pairs written in the text as "X (Vorjahr: Y)", labelled by up to six words before them."""
    number = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
    pattern = rf"(?Ui){number}(?:\s+[A-Za-zÄÖÜäöüß%]+){{0,4}}\s*\(\s*Vorjahr\s*:?\s*{number}"
    flat = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    rows = pages.select("doc_id", "page", flat.alias("t")).where(F.col("t").rlike(pattern))
    rows = rows.select("doc_id", "page", F.posexplode(F.arrays_zip(
        F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all("t", F.lit(pattern), F.lit(1)).alias("cur"), F.regexp_extract_all("t", F.lit(pattern), F.lit(2)).alias("pri"),
        F.split("t", pattern, -1).alias("gap"))).alias("k", "m"), "t")
    rows = rows.where(F.col("m.all").isNotNull())
    before = F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "m.gap", "m.all")).over(Window.partitionBy("doc_id", "page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.col("m.gap"))
    words = F.regexp_extract_all(before, F.lit(r"[A-Za-zÄÖÜäöüß\-]{2,}"), F.lit(0))
    label = F.array_join(F.when(F.size(words) <= 6, words).otherwise(F.slice(words, -6, 6)), " ")
    return rows.select(
        "doc_id", "page", F.col("k").cast("long").alias("at"), F.left(F.when(label == "", "Angabe (Vorjahr)").otherwise(label), F.lit(200)).alias("label"),
        F.array(T.parse_number(F.col("m.cur"))).alias("current_values"), F.array(T.parse_number(F.col("m.pri"))).alias("prior_values"), F.col("m.all").alias("source_line"))
