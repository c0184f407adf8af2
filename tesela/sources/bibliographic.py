"""Readers of bibliographic exports into one record schema, and their sniffers and router."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.functions.text import country_of_affiliation, inverted_index_text, year_of

FIELDS = ("id", "title", "year", "journal", "abstract", "doi", "cited_by", "authors", "keywords", "affiliations", "references")
_ARRAYS = ("authors", "keywords", "affiliations", "references")


def _records(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The record schema: absent texts null, absent lists empty, countries from affiliations."""
    out = []
    for f in FIELDS:
        c = columns.get(f)
        if f in _ARRAYS:
            clean = F.array().cast("array<string>") if c is None else F.coalesce(F.filter(F.transform(c, F.trim), lambda x: x != ""), F.array().cast("array<string>"))
            out.append(clean.alias(f))
        elif f in ("year", "cited_by"):
            out.append((F.lit(None) if c is None else c).cast("int").alias(f))
        else:
            out.append((F.lit(None).cast("string") if c is None else c).alias(f))
    rows = df.select(*out)
    return rows.withColumn("countries", F.array_distinct(F.filter(F.transform("affiliations", country_of_affiliation), lambda x: x.isNotNull())))


def _tagged(df: DataFrame, line: str, joined: str) -> DataFrame:
    """Tag -> values of text records: every match of ``line`` (tag, value); continuation lines are joined first."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), joined, " ")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("v"))
    return df.select("value", pairs.alias("pairs")).where(F.size("pairs") > 0)


def _all(*tags: str) -> Column:
    return F.transform(F.filter("pairs", lambda p: p["t"].isin(*tags)), lambda p: F.trim(p["v"]))


def _one(*tags: str) -> Column:
    """First value of the first tag that has one."""
    return F.coalesce(*[F.get(_all(t), F.lit(0)) for t in tags])


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS records (``XX  - value``, closed by ER); files are split at the ER lines, so one file may be read by many tasks."""
    df = _tagged(spark.read.text(path, lineSep="\nER  -"), r"(?m)^\s*([A-Z][A-Z0-9])  - (.*)$", r"\n {6,}")
    return _records(df, {"id": _one("ID", "AN"), "title": _one("TI", "T1"), "year": year_of(_one("PY", "Y1")), "journal": _one("JO", "T2", "JF"), "abstract": _one("AB", "N2"), "doi": _one("DO"), "cited_by": _one("TC").try_cast("int"), "authors": _all("AU", "A1"), "keywords": _all("KW"), "affiliations": _all("AD"), "references": _all("CR")})


def read_wos(spark: SparkSession, path: str) -> DataFrame:
    """Two-letter tagged records with three-space continuation lines; lists stand one per line or after semicolons."""
    df = spark.read.text(path, lineSep="\nER")
    pairs = F.arrays_zip(F.regexp_extract_all(F.regexp_replace("value", "\r", ""), F.lit(r"(?m)^([A-Z][A-Z0-9]) (.*(?:\n   .*)*)"), F.lit(1)).alias("t"), F.regexp_extract_all(F.regexp_replace("value", "\r", ""), F.lit(r"(?m)^([A-Z][A-Z0-9]) (.*(?:\n   .*)*)"), F.lit(2)).alias("v"))
    df = df.select(pairs.alias("pairs")).where(F.size("pairs") > 0)
    lines = lambda tag: F.split(_one(tag), r"\n   ")
    flat = lambda tag: F.regexp_replace(_one(tag), r"\n   ", " ")
    return _records(df, {"id": _one("UT"), "title": flat("TI"), "year": year_of(_one("PY")), "journal": flat("SO"), "abstract": flat("AB"), "doi": _one("DI"), "cited_by": _one("TC").try_cast("int"), "authors": lines("AU"), "keywords": F.split(F.concat_ws("; ", flat("DE"), flat("ID")), r";\s*"), "affiliations": lines("C1"), "references": lines("CR")})


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """Medline records (``TAG - value``, six-space continuation), one per blank line."""
    df = _tagged(spark.read.text(path, lineSep="\n\n"), r"(?m)^([A-Z]{2,4})\s*- (.*)$", r"\n {6}")
    return _records(df, {"id": _one("PMID"), "title": _one("TI"), "year": year_of(_one("DP")), "journal": _one("JT", "TA"), "abstract": _one("AB"), "doi": F.regexp_extract(_one("LID", "AID"), r"(10\.\S+)", 1), "authors": _all("FAU", "AU"), "keywords": _all("MH", "OT"), "affiliations": _all("AD")})


def read_proquest(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``Name: value`` lines between rules of underscores."""
    df = _tagged(spark.read.text(path, lineSep="____________________________________________________________"), r"(?m)^([A-Z][A-Za-z /]+): (.*)$", r"\n {4,}")
    return _records(df, {"id": _one("ProQuest document ID"), "title": _one("Title"), "year": year_of(_one("Publication year")), "journal": _one("Publication title"), "abstract": _one("Abstract"), "authors": F.split(_one("Author"), r";\s*"), "keywords": F.split(_one("Subject"), r";\s*")})


#: Header names of delimited exports per record field, the first that a file has counts.
ALIASES = {
    "id": ("EID", "Lens ID", "Publication ID", "id", "openalex_id", "ID"), "title": ("Title", "title", "Título", "Titulo", "display_name"), "year": ("Year", "Publication Year", "PubYear", "publication_year", "Año", "Ano"),
    "journal": ("Source title", "Source Title", "journal", "journal_name", "Revista"), "abstract": ("Abstract", "abstract", "Resumen"), "doi": ("DOI", "doi"), "cited_by": ("Cited by", "Times cited", "Citing Works Count", "cited_by_count", "Citas"),
    "authors": ("Authors", "Author/s", "authors", "author_names", "Autores"), "affiliations": ("Affiliations", "Authors Affiliations", "affiliations", "Research Organizations - standardized"), "references": ("References", "references", "referenced_works"),
    "keywords": ("Author Keywords", "Keywords", "keywords", "MeSH terms", "Fields of Research (ANZSRC 2020)", "MeSH Terms", "Index Keywords", "Fields of Study", "Palabras clave"),
}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", skip_preface: bool = False) -> DataFrame:
    """CSV exports of citation databases: all strings, header aliases in several languages, lists by ``;`` or ``|``.

    All keyword columns that a file has are united. ``skip_preface`` drops lines before the header.
    """
    if skip_preface:
        lines = spark.read.text(path).where(F.col("value").contains(sep) & ~F.col("value").startswith('"About'))
        head = lines.limit(1).collect()
        names = re.split(re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)', head[0][0]) if head else []
        names = [n.strip('"﻿ ') for n in names]
        parsed = lines.where(F.col("value") != (head[0][0] if head else "")).select(F.from_csv("value", ", ".join(f"`c{i}` string" for i in range(len(names))), {"sep": sep}).alias("r"))
        df = parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    else:
        df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8")
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    columns: dict[str, Column] = {}
    for field, names in ALIASES.items():
        have = [F.col(f"`{n}`") for n in names if n in df.columns]
        if not have:
            continue
        if field == "keywords":
            columns[field] = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.split(c, r"\s*[;|]\s*"), F.array().cast("array<string>")) for c in have])))
        elif field in _ARRAYS:
            columns[field] = F.split(have[0], r"\s*[;|]\s*")
        elif field == "year":
            columns[field] = year_of(have[0])
        elif field == "cited_by":
            columns[field] = have[0].try_cast("int")
        else:
            columns[field] = have[0]
    return _records(df, columns)


_WORK = "id string, doi string, title string, display_name string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>,countries:array<string>>>, keywords array<struct<display_name:string>>, concepts array<struct<display_name:string,score:double>>, primary_location struct<source:struct<display_name:string>>, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"


def read_works_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Works as JSON lines, or as one array or ``{"results": [...]}``; abstracts from inverted index, concepts over 0.25 as keywords."""
    if lines:
        df = spark.read.schema(_WORK).json(path)
    else:
        raw = spark.read.text(path, wholetext=True)
        both = F.coalesce(F.from_json("value", f"struct<results:array<struct<{_WORK.replace(' string', ':string').replace(' int,', ':int,').replace(' array<', ':array<').replace(' struct<', ':struct<').replace(' map<', ':map<')}>>>").getField("results"), F.array())
        df = raw.select(F.explode(both).alias("w")).select("w.*")
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    places = F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"])))
    words = F.array_union(F.coalesce(F.transform("keywords", lambda k: k["display_name"]), F.array().cast("array<string>")), F.coalesce(F.transform(F.filter("concepts", lambda c: c["score"] > 0.25), lambda c: c["display_name"]), F.array().cast("array<string>")))
    return _records(df, {"id": F.regexp_extract("id", r"([A-Z]\d+)$", 1), "title": F.coalesce("title", "display_name"), "year": F.col("publication_year"), "journal": F.col("primary_location.source.display_name"), "abstract": inverted_index_text(F.col("abstract_inverted_index")), "doi": F.col("doi"), "cited_by": F.col("cited_by_count"), "authors": names, "keywords": words, "affiliations": places, "references": F.col("referenced_works")})


def read_network_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and links of a network JSON file."""
    schema = "network struct<items:array<struct<id:int,label:string,x:double,y:double,cluster:int>>,links:array<struct<source_id:int,target_id:int,strength:double>>>"
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(F.explode("network.items").alias("i")).select("i.*"), df.select(F.explode("network.links").alias("l")).select("l.*")


def read_grants(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Grant tables: program, investigators, institution, year and amount by header aliases."""
    df = spark.read.csv(path, header=True, sep=sep)
    pick = lambda *n: F.coalesce(*[F.col(f"`{c}`") for c in n if c in df.columns], F.lit(None).cast("string"))
    return df.select(pick("AwardNumber", "ApplicationID", "id", "Grant Number").alias("id"), pick("AwardTitle", "ApplicationTitle", "title").alias("title"), F.split(pick("Investigator", "Name-Nom", "investigators"), r";\s*").alias("investigators"), pick("Institution", "Institution-Établissement", "institution").alias("institution"), year_of(pick("Year", "FiscalYear-Exercice financier", "year")).alias("year"), F.regexp_replace(pick("AwardAmount", "AwardAmount", "amount"), "[$,]", "").try_cast("double").alias("amount"))


def sniff(first_lines: str) -> str:
    """Format of a file by its first lines, in the order in which they exclude each other."""
    t = first_lines.lstrip("﻿").lstrip()
    if t.startswith("{") and '"network"' in t:
        return "network_json"
    if t.startswith(("{", "[")):
        return "works_json"
    if re.search(r"(?m)^TY  - ", t):
        return "ris"
    if re.search(r"(?m)^PMID\s*- ", t):
        return "medline"
    if re.search(r"(?m)^(FN |PT [A-Z]\b)", t):
        return "wos"
    if t.startswith("____"):
        return "proquest"
    head = t.split("\n", 1)[0]
    if "EID" in head and "Authors" in head:
        return "scopus_csv"
    if "Lens ID" in head:
        return "lens_csv"
    if "About the data" in head or "Publication ID" in t.split("\n", 2)[0]:
        return "dimensions_csv"
    return "works_csv"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file of any known format."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())
    kind = sniff(head)
    readers = {"ris": read_ris, "wos": read_wos, "medline": read_medline, "proquest": read_proquest}
    if kind in readers:
        return readers[kind](spark, path)
    if kind == "works_json":
        return read_works_json(spark, path, lines=not head.lstrip().startswith("[") and '"results"' not in head)
    if kind == "network_json":
        return read_network_json(spark, path)[0]
    sep = max(",;\t", key=head.split("\n", 1)[0].count)
    return read_delimited(spark, path, sep, kind == "dimensions_csv")
