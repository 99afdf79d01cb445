"""Rule library: employees, participations, sources and their citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora.functions import text as T

#: Authorities of sources, highest first, whether their text may be stored whole, and the words of a short quote.
AUTHORITIES = (("LAW", True, None), ("COURT", True, None), ("REGULATOR", True, None), ("STANDARD", False, 100), ("COMMENTARY", False, 50), ("INTERNAL", True, None), ("OTHER", False, 50))


def employees_rule(documents: DataFrame) -> DataFrame:
    """doc_id, average, groups, prior_year, status of the disclosure on employees."""
    low = F.lower(F.coalesce("text", F.lit("")))
    topic = low.rlike("arbeitnehmer|dienstnehmer|mitarbeiter")
    average = low.rlike("durchschnitt")
    groups = sum(((low.rlike(p)).cast("int") for p in (r"(?U)\barbeiter\b", r"(?U)\bangestellte", r"(?U)\blehrlinge?\b")), F.lit(0))
    prior = low.rlike(r"vorjahr|\(vj")
    rows = documents.select("doc_id", topic.alias("topic"), average.alias("average"), groups.alias("groups"), prior.alias("prior_year"))
    full = F.col("average") & (F.col("groups") >= 2)
    status = F.when(~F.col("topic"), S.NOT_COMPLIANT).when(full & F.col("prior_year"), S.COMPLIANT).when(full | F.col("average"), S.PARTIAL).otherwise(S.NOT_ASSESSABLE)
    return rows.withColumn("status", status)


#: A run of capitalised words, taken whole: possessive, so that no repetition goes a call deeper or is tried again.
_RUN = r"(?U)[A-ZÄÖÜ][\w&.\-]*+(?:\s++[A-ZÄÖÜ&][\w&.\-]*+)*+"
#: Legal forms that end a company's name.
_FORM = r"(?Us)^(.+\s(?:GmbH|AG|KG|Ltd|Inc|SE))"


def participations(documents: DataFrame) -> DataFrame:
    """doc_id, n, name, window: each company named and the text up to the next one, at most 500 characters. A name is
    a run of capitalised words up to the last legal form in it."""
    text = F.coalesce("text", F.lit(""))
    runs = documents.select("doc_id", F.split(text, _RUN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)).alias("runs"))
    runs = runs.select("doc_id", F.posexplode(F.zip_with("runs", F.slice("gaps", F.lit(2), F.size("runs")), lambda r, g: F.struct(r.alias("run"), g.alias("gap")))).alias("at", "x"))
    name = F.regexp_extract("x.run", _FORM, 1)
    rows = runs.select("doc_id", "at", F.nullif(name, F.lit("")).alias("name"), F.left(F.concat(F.substring("x.run", F.length(name) + 1, F.length("x.run")), "x.gap"), F.lit(500)).alias("rest"))
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", (F.count("name").over(upto) - 1).cast("int")).where("n >= 0")
    # A window is at most 500 characters, and every part holds one at least, so that 500 parts are enough of it.
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("at"))).where("k <= 501")
    by = rows.groupBy("doc_id", "n").agg(F.max("name").alias("name"), F.sort_array(F.collect_list(F.struct("at", "rest"))).alias("parts"))
    return by.select("doc_id", "n", "name", F.left(F.array_join(F.transform("parts", lambda p: p["rest"]), ""), F.lit(500)).alias("window"))


def participation_elements(documents: DataFrame) -> DataFrame:
    """doc_id, n, name, element, state (PRESENT or ABSENT) of the four things to be said of each participation."""
    w = F.col("window")
    flags = {"share": w.rlike(r"\d+(,\d+)?\s*%"), "seat": w.rlike(r"(?Ui)sitz\s+in|mit sitz|,\s*[A-ZÄÖÜ]\w+"), "equity": w.rlike("(?i)eigenkapital"), "result": w.rlike("(?i)ergebnis|jahresüberschuss|jahresfehlbetrag")}
    both = F.array(*[F.struct(F.lit(k).alias("element"), F.when(v, "PRESENT").otherwise("ABSENT").alias("state")) for k, v in flags.items()])
    return participations(documents).select("doc_id", "n", "name", F.explode(both).alias("e")).select("doc_id", "n", "name", "e.element", "e.state")


def participation_rule(documents: DataFrame) -> DataFrame:
    """doc_id, status: compliant if all elements of all participations are there; a protective clause excuses."""
    els = participation_elements(documents).groupBy("doc_id").agg(F.bool_and(F.col("state") == "PRESENT").alias("all"), F.bool_or(F.col("state") == "PRESENT").alias("some"))
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = documents.select("doc_id", low.rlike("schutzklausel|nachteil zuzufügen").alias("clause")).join(els, "doc_id", "left")
    status = F.when(F.isnull("all"), S.NOT_ASSESSABLE).when(F.col("all") | F.col("clause"), S.COMPLIANT).when(F.col("some"), S.PARTIAL).otherwise(S.NOT_COMPLIANT)
    return rows.select("doc_id", status.alias("status"))


def storage_allowed(authority: Column, words: Column) -> Column:
    out = F.lit(False)
    for name, whole, most in reversed(AUTHORITIES):
        out = F.when(authority == name, F.lit(True) if whole else words <= most).otherwise(out)
    return out


def authority_rank(authority: Column) -> Column:
    out = F.lit(len(AUTHORITIES))
    for k, (name, _, _) in enumerate(AUTHORITIES):
        out = F.when(authority == name, k).otherwise(out)
    return out


def metadata_issues() -> Column:
    """What is missing in a source's record (authority, title, citation, url, retrieved)."""
    need = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", c + " missing") for c in ("title", "citation")]
    need.append(F.when(F.isnull("authority") | ~F.col("authority").isin(*[a for a, _, _ in AUTHORITIES]), "authority unknown"))
    need.append(F.when(F.isnull("url") & (F.col("authority") != "INTERNAL"), "url missing"))
    return F.filter(F.array(*need), lambda x: x.isNotNull())


def latest_links(links: DataFrame) -> DataFrame:
    """Rule-source links, the last of each (rule, source, component)."""
    w = Window.partitionBy("rule_id", "source_id", "component").orderBy(F.desc("ord"))
    return links.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def audit_trail(links: DataFrame, sources: DataFrame) -> DataFrame:
    """rule_id, authority, citations: sources by authority, the highest first."""
    rows = latest_links(links).join(sources, "source_id").groupBy("rule_id", "authority").agg(F.sort_array(F.collect_set("citation")).alias("citations"))
    return rows.withColumn("rank", authority_rank(F.col("authority")))


def intact(content: Column, stored_hash: Column) -> Column:
    return T.content_hash(content) == stored_hash


#: What must be said of a source's standing, by authority.
CAVEATS = {"LAW": "", "COURT": "", "REGULATOR": "not binding on courts", "STANDARD": "professional standard, no law", "COMMENTARY": "opinion of an author", "INTERNAL": "internal reading", "OTHER": "unverified source"}


def citation() -> Column:
    """citation, title and place of a source, with the caveat of its authority in brackets."""
    caveat = F.try_element_at(F.create_map(*[F.lit(x) for kv in CAVEATS.items() for x in kv]), F.coalesce("authority", F.lit("OTHER")))
    text = F.concat_ws(", ", F.nullif("citation", F.lit("")), F.nullif("title", F.lit("")), "place")
    return F.when(F.coalesce(caveat, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(" ["), caveat, F.lit("]")))


def combined_caveat(sources: DataFrame) -> DataFrame:
    """rule_id, caveat: that of the highest authority among a rule's sources."""
    best = sources.groupBy("rule_id").agg(F.min_by("authority", authority_rank(F.col("authority"))).alias("authority"))
    return best.select("rule_id", F.try_element_at(F.create_map(*[F.lit(x) for kv in CAVEATS.items() for x in kv]), F.col("authority")).alias("caveat"))


def adequately_sourced(rules_: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """rule_id, adequate: a rule needs a law, court or regulator among its latest links."""
    have = latest_links(links).join(sources, "source_id").groupBy("rule_id").agg(F.max(authority_rank(F.col("authority")) <= 2).alias("adequate"))
    return rules_.join(have, "rule_id", "left").select("rule_id", F.coalesce("adequate", F.lit(False)).alias("adequate"))
