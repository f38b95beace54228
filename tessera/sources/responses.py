"""Recorded responses of services, as tables of bodies; nothing here asks a network.

Each reader takes (request_key, body) with the body as text, and gives flat rows; a body that is missing or does not
parse gives none, and `failures` tells which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import grant_active
from ..functions.text import finding_role, scrub_contact, strip_tags


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of <key>.body and <key>.json files -> request_key, url, retrieved_at, sha256, body, intact."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    key = F.regexp_extract("path", r"([0-9a-f]{64})\.(?:body|json)$", 1)
    bodies = files.filter("path like '%.body'").select(key.alias("request_key"), "content")
    meta = files.filter("path like '%.json'").select(key.alias("request_key"), F.from_json(F.col("content").cast("string"), "url string, retrieved_at string, sha256 string").alias("m"))
    met = bodies.join(meta, "request_key", "left")
    return met.select("request_key", "m.url", "m.retrieved_at", "m.sha256", F.col("content").cast("string").alias("body"), (F.sha2("content", 256) == F.col("m.sha256")).alias("intact"))


def failures(responses: DataFrame, schema: str) -> DataFrame:
    """Keys whose body is missing or no such JSON."""
    return responses.filter(F.col("body").isNull() | F.from_json("body", schema).isNull()).select("request_key")


def pubmed_search(responses: DataFrame) -> DataFrame:
    """request_key, count, ids."""
    parsed = F.from_json("body", "esearchresult struct<count:string,idlist:array<string>>")
    return responses.select("request_key", parsed.alias("r")).select("request_key", F.col("r.esearchresult.count").cast("long").alias("count"), F.col("r.esearchresult.idlist").alias("ids"))


def pubmed_records(responses: DataFrame) -> DataFrame:
    """pmid, title, abstract, year, journal, authors, affiliations, publication_types of each article of an XML body.

    Parts of an abstract are joined by line ends; the year is that of the date, or the first four characters of a free one.
    """
    article = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)(<PubmedArticle>.*?</PubmedArticle>)"), F.lit(1))).alias("a")
    rows = responses.select("request_key", article)

    def one(tag: str) -> Column:
        return F.nullif(strip_tags(F.regexp_extract("a", rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))

    def many(tag: str) -> Column:
        return F.regexp_extract_all("a", F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1))

    date = F.regexp_extract("a", r"(?s)<PubDate>(.*?)</PubDate>", 1)
    year = F.coalesce(F.nullif(F.regexp_extract(date, r"<Year>(\d{4})</Year>", 1), F.lit("")), F.substring(F.regexp_extract(date, r"<MedlineDate>(.*?)</MedlineDate>", 1), 1, 4))
    plain = lambda xs: F.transform(xs, lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    authors = F.transform(many("Author"), lambda x: F.concat_ws(" ", F.nullif(F.regexp_extract(x, r"<ForeName>(.*?)</ForeName>", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"<LastName>(.*?)</LastName>", 1), F.lit(""))))
    return rows.select(
        F.regexp_extract("a", r"<PMID[^>]*>(\d+)</PMID>", 1).alias("pmid"),
        one("ArticleTitle").alias("title"),
        F.array_join(plain(many("AbstractText")), "\n").alias("abstract"),
        year.try_cast("int").alias("year"),
        one("ISOAbbreviation").alias("journal"),
        authors.alias("authors"),
        F.array_distinct(F.transform(plain(many("Affiliation")), scrub_contact)).alias("affiliations"),
        plain(many("PublicationType")).alias("publication_types"),
    )


def full_text(responses: DataFrame) -> DataFrame:
    """request_key and the body's text without tags; a body that is missing gives null."""
    return responses.select("request_key", strip_tags(F.col("body")).alias("text"))


def text_annotations(responses: DataFrame) -> DataFrame:
    """pmid, type, exact, sentence, sections, role of each annotation; the longer of the joined sentence and the exact text counts."""
    parsed = F.from_json("body", "array<struct<extId:string,annotations:array<struct<type:string,exact:string,prefix:string,postfix:string,section:string>>>>")
    rows = responses.select(F.explode(parsed).alias("d")).select(F.col("d.extId").alias("pmid"), F.explode("d.annotations").alias("n"))
    joined = F.concat(F.coalesce("n.prefix", F.lit("")), F.coalesce("n.exact", F.lit("")), F.coalesce("n.postfix", F.lit("")))
    rows = rows.select("pmid", "n.type", F.substring("n.exact", 1, 400).alias("exact"), F.substring(F.when(F.length(joined) >= F.length("n.exact"), joined).otherwise(F.col("n.exact")), 1, 600).alias("sentence"), "n.section")
    return rows.groupBy("pmid", "type", "exact", "sentence").agg(F.array_sort(F.collect_set("section")).alias("sections")).withColumn("role", finding_role(F.col("sentence")))


def protein_names(responses: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols (symbol, request_key) -> accession and names of the first entry (the search asks for reviewed ones), in the order
    recommended, short, alternative and their short ones; without an entry, or a body that can be read, the symbol itself."""
    name = "struct<fullName:struct<value:string>,shortNames:array<struct<value:string>>>"
    schema = f"results array<struct<primaryAccession:string,proteinDescription:struct<recommendedName:{name},alternativeNames:array<{name}>>>>"
    met = symbols.join(responses, "request_key", "left").withColumn("h", F.get(F.from_json("body", schema)["results"], F.lit(0)))
    none = F.array().cast("array<string>")
    values = lambda n: F.concat(F.array(n["fullName"]["value"]), F.coalesce(F.transform(n["shortNames"], lambda x: x["value"]), none))
    other = F.coalesce(F.flatten(F.transform("h.proteinDescription.alternativeNames", values)), F.array().cast("array<string>"))
    names = F.concat(values(F.col("h.proteinDescription.recommendedName")), other)
    return met.select("symbol", F.col("h.primaryAccession").alias("accession"), F.when(F.col("h").isNull(), F.array("symbol")).otherwise(F.array_compact(names)).alias("names"))


def protein_features(responses: DataFrame) -> DataFrame:
    """accession, kind, begin, end, description of features whose bounds are whole numbers."""
    schema = "primaryAccession string, features array<struct<type:string,description:string,location:struct<start:struct<value:int>,end:struct<value:int>>>>"
    rows = responses.select(F.from_json("body", schema).alias("r")).select(F.col("r.primaryAccession").alias("accession"), F.explode("r.features").alias("f"))
    out = rows.select("accession", F.col("f.type").alias("kind"), F.col("f.location.start.value").alias("begin"), F.col("f.location.end.value").alias("end"), F.col("f.description").alias("description"))
    return out.filter("begin is not null and end is not null")


def grants(responses: DataFrame, as_of: str) -> DataFrame:
    """Grants with an id; one is active if it ends on or after the given day."""
    schema = "results array<struct<project_num:string,project_title:string,organization:struct<org_name:string>,principal_investigators:array<struct<full_name:string>>,project_end_date:string,abstract_text:string>>"
    rows = responses.select(F.explode(F.from_json("body", schema)["results"]).alias("g")).filter("g.project_num is not null")
    return rows.select(
        F.col("g.project_num").alias("grant_id"), F.col("g.project_title").alias("title"), F.col("g.organization.org_name").alias("organization"),
        F.transform("g.principal_investigators", lambda p: p["full_name"]).alias("investigators"), F.col("g.abstract_text").alias("abstract"), grant_active(F.substring("g.project_end_date", 1, 10), as_of).alias("active"),
    )


def trials(responses: DataFrame) -> DataFrame:
    """Studies with their conditions and sponsors, the lead one first."""
    schema = "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string>,conditionsModule:struct<conditions:array<string>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>,collaborators:array<struct<name:string>>>>>>"
    rows = responses.select(F.explode(F.from_json("body", schema)["studies"]).alias("s")).select("s.protocolSection.*")
    partners = F.coalesce(F.transform("sponsorCollaboratorsModule.collaborators", lambda c: c["name"]), F.array().cast("array<string>"))
    return rows.select(
        F.col("identificationModule.nctId").alias("trial_id"), F.col("identificationModule.briefTitle").alias("title"), F.col("statusModule.overallStatus").alias("status"), F.col("conditionsModule.conditions").alias("conditions"),
        F.array_compact(F.concat(F.array("sponsorCollaboratorsModule.leadSponsor.name"), partners)).alias("sponsors"),
    )


def web_assets(responses: DataFrame) -> DataFrame:
    """url, host (lower-case), text and its hash of crawled pages, a list or under data or results; ones without url or text are dropped."""
    page = "struct<url:string,raw_text:string,text:string,content:string>"
    as_list, under = F.from_json("body", f"array<{page}>"), F.from_json("body", f"struct<data:array<{page}>,results:array<{page}>>")
    pages = F.when(F.startswith(F.trim("body"), F.lit("[")), as_list).otherwise(F.coalesce(under["data"], under["results"]))
    rows = responses.select(F.explode(pages).alias("p")).select("p.url", F.coalesce("p.raw_text", "p.text", "p.content").alias("text"))
    return rows.filter("url is not null and coalesce(text, '') <> ''").select("url", F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), "text", F.sha2("text", 256).alias("sha256"))
