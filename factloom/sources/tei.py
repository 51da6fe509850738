"""TEI documents as columns, by XPath over the XML text; names are matched without their namespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(*steps: str) -> str:
    return "".join("//" + f"*[local-name()='{s}']" if s[0] != "/" else f"/*[local-name()='{s[1:]}']" for s in steps)


def _text(x: Column, path: str) -> Column:
    return F.trim(F.xpath_string(x, F.lit(f"normalize-space({path})")))


def title(x: Column) -> Column:
    return F.coalesce(_text(x, _q("titleStmt", "title")), F.lit(""))


def _all(x: Column, path: str) -> Column:
    return F.filter(F.transform(F.xpath(x, F.lit(f"{path}/text()")), lambda t: F.trim(t)), lambda t: t != "")


def authors(x: Column) -> Column:
    """Array of (first, last, full); full only where both are there."""
    base = _q("sourceDesc", "author", "persName")
    count = F.xpath_int(x, F.lit(f"count({base})"))
    part = lambda name: F.xpath(x, F.lit(f"{base}/*[local-name()='{name}'][1]/text()"))
    pairs = F.arrays_zip(part("forename").alias("first"), part("surname").alias("last"))
    full = F.transform(pairs, lambda p: F.struct(p["first"].alias("first"), p["last"].alias("last"), F.when(p["first"].isNotNull() & p["last"].isNotNull(), F.concat_ws(" ", p["first"], p["last"])).alias("full")))
    return F.when(count > 0, F.filter(full, lambda p: p["first"].isNotNull() | p["last"].isNotNull())).otherwise(F.array().cast("array<struct<first:string,last:string,full:string>>"))


def abstract(x: Column) -> Column:
    """Paragraphs of the abstract joined by spaces, else its own text."""
    paragraphs = _all(x, _q("abstract", "p"))
    return F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, " ")).otherwise(F.coalesce(_text(x, _q("abstract")), F.lit("")))


def body_text(x: Column, compat: bool = False) -> Column:
    """Paragraphs and headings of the body in document order; compat keeps only the text before an element's first child."""
    which = "//*[local-name()='body']//*[substring(local-name(), string-length(local-name())) = 'p' or substring(local-name(), string-length(local-name()) - 3) = 'head'{}]"
    own = F.xpath(x, F.lit(which.format("") + "/text()[not(preceding-sibling::*)]"))
    every = F.xpath(x, F.lit(which.format(" or local-name() = 'cell'") + "//text()"))
    return F.array_join(F.filter(F.transform(own if compat else every, lambda t: F.trim(t)), lambda t: t != ""), "\n\n")


def full_text(x: Column, include_abstract: bool = True) -> Column:
    a, b = abstract(x), body_text(x)
    parts = [F.when(a != "", F.concat(F.lit("ABSTRACT:\n"), a))] if include_abstract else []
    return F.concat_ws("\n\n", *parts, F.when(b != "", F.concat(F.lit("BODY:\n"), b)))


def year(x: Column) -> Column:
    date = F.xpath_string(x, F.lit("//*[local-name()='date'][@type='published']/@when"))
    return F.nullif(F.substring(date, 1, 4), F.lit(""))


def references(x: Column) -> Column:
    """Array of reference titles; see reference_rows for whole references."""
    return _all(x, _q("listBibl", "biblStruct") + "//*[local-name()='title'][1]")


def reference_rows(spark, path: str) -> DataFrame:
    """title, authors, year of each reference entry, by the XML source."""
    df = spark.read.format("xml").option("rowTag", "biblStruct").option("ignoreNamespace", True).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def document(df: DataFrame, xml: str = "text") -> DataFrame:
    """df with title, authors, abstract, body, year and reference_count of an XML column; malformed XML gives ``_error``."""
    x = F.col(xml)
    out = df.withColumn("_error", F.when(~F.regexp_like(x, F.lit(r"(?s)^\s*(<\?xml.*?\?>)?\s*<.*>\s*$")), "not XML"))
    good = lambda c: F.when(F.col("_error").isNull(), c)
    return out.withColumns({"title": good(title(x)), "authors": good(authors(x)), "abstract": good(abstract(x)), "body": good(body_text(x)), "year": good(year(x)), "reference_count": good(F.xpath_int(x, F.lit(f"count({_q('listBibl', 'biblStruct')})")))})
