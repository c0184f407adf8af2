"""Tags of bibliographic records: names, kinds and the processors of their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesela.functions.text import month_number, year_of

# Record tags, their long names, and how their values are stored.
TAGS = {
    "PT": ("pubType", "text"), "AU": ("authorsShort", "lines"), "AF": ("authorsFull", "lines"), "BA": ("bookAuthor", "lines"), "CA": ("group", "lines"), "BE": ("editors", "lines"), "TI": ("title", "joined"), "SO": ("journal", "joined"), "SE": ("seriesTitle", "joined"),
    "LA": ("language", "text"), "DT": ("docType", "text"), "CT": ("confTitle", "joined"), "CY": ("confDate", "text"), "CL": ("confLocation", "text"), "SP": ("confSponsors", "joined"), "HO": ("confHost", "text"), "DE": ("keywords", "semicolons"), "ID": ("keywordsPlus", "semicolons"),
    "AB": ("abstract", "joined"), "C1": ("authAddress", "lines"), "RP": ("reprintAddress", "joined"), "EM": ("email", "semicolons"), "RI": ("ResearcherID", "semicolons"), "OI": ("ORCID", "semicolons"), "FU": ("funding", "semicolons"), "FX": ("fundingText", "joined"), "CR": ("citations", "lines"),
    "NR": ("citedRefsCount", "integer"), "TC": ("wosTimesCited", "integer"), "Z9": ("totalTimesCited", "integer"), "PU": ("publisher", "joined"), "PI": ("publisherCity", "text"), "PA": ("publisherAddress", "joined"), "SN": ("ISSN", "text"), "EI": ("eISSN", "text"), "BN": ("ISBN", "text"),
    "J9": ("j9", "joined"), "JI": ("isoAbbreviation", "joined"), "PD": ("month", "month"), "PY": ("year", "year"), "VL": ("volume", "text"), "IS": ("issue", "text"), "PN": ("partNumber", "text"), "SU": ("supplement", "text"), "SI": ("special", "text"), "BP": ("beginningPage", "text"), "EP": ("endingPage", "text"),
    "AR": ("articleNumber", "text"), "DI": ("DOI", "text"), "D2": ("bookDOI", "text"), "PG": ("pageCount", "integer"), "WC": ("subjects", "semicolons"), "SC": ("subjectCategory", "semicolons"), "GA": ("documentDeliveryNumber", "text"), "UT": ("id", "text"), "PM": ("pubMedID", "text"),
}
# The same for Medline records; tags that are not listed hold one text.
MEDLINE = {
    "PMID": ("id", "text"), "TI": ("title", "joined"), "AB": ("abstract", "joined"), "AU": ("authorsShort", "lines"), "FAU": ("authorsFull", "lines"), "AD": ("authAddress", "lines"), "DP": ("year", "year"), "DA": ("dateCreated", "text"), "JT": ("journal", "joined"), "TA": ("j9", "joined"), "VI": ("volume", "text"),
    "IP": ("issue", "text"), "PG": ("pages", "text"), "LID": ("DOI", "doi"), "AID": ("articleId", "doi"), "MH": ("meshTerms", "lines"), "OT": ("keywords", "lines"), "PT": ("pubType", "lines"), "LA": ("language", "lines"), "GR": ("grants", "lines"), "IS": ("ISSN", "text"), "PL": ("publisherCity", "text"),
}
LONG = {long: tag for tag, (long, _) in TAGS.items()}


def tag_of(name: str) -> str | None:
    """Tag of a long name or tag in any case."""
    up = name.upper()
    return up if up in TAGS else next((t for long, t in LONG.items() if long.lower() == name.lower()), None)


def synonyms(name: str) -> list[str]:
    tag = tag_of(name)
    return [tag, TAGS[tag][0]] if tag else [name]


def process(kind: str, lines: Column) -> Column:
    """Value of a tag from its lines as an array of texts: joined, one per line, split at semicolons, integer, year, month or DOI."""
    joined = F.trim(F.array_join(lines, " "))
    one = {
        "text": F.array(F.trim(F.get(lines, F.lit(0)))), "joined": F.array(joined), "lines": F.transform(lines, F.trim), "semicolons": F.filter(F.transform(F.split(joined, ";"), F.trim), lambda x: x != ""), "integer": F.array(joined.try_cast("int").cast("string")),
        "year": F.array(year_of(joined).cast("string")), "month": F.array(month_number(joined).cast("string")), "doi": F.array(F.nullif(F.regexp_extract(joined, r"(10\.\d{4,9}/\S+)", 1), F.lit(""))),
    }
    return one[kind]


def processed(df, tag: str, lines: str, table: dict[str, tuple[str, str]] = TAGS):
    """``df`` with ``name`` and ``values`` of rows (tag, lines): every tag by its own processor, unknown ones as text."""
    out = process("text", F.col(lines))
    name = F.col(tag)
    for t, (long, kind) in table.items():
        out = F.when(F.col(tag) == t, process(kind, F.col(lines))).otherwise(out)
        name = F.when(F.col(tag) == t, long).otherwise(name)
    return df.withColumn("name", name).withColumn("values", F.filter(out, lambda x: x.isNotNull()))


#: A full citation: author, year, journal, volume, page, DOI in the order in which they are written.
CITATION = r"^(?:([^,]+?),\s*)?(?:(\d{4}),\s*)?([^,]+?)?(?:,\s*V([\w.-]+))?(?:,\s*[PC]([\w.-]+))?(?:,\s*(?:DOI\s+)?(10\.\d{4,9}/\S+))?(?:,\s*(.+))?$"


def parse_citation(c: Column) -> Column:
    """``author, year, journal, volume, page, doi, misc, bad``; bad where neither year nor journal is there."""
    g = lambda i: F.nullif(F.trim(F.regexp_extract(c, CITATION, i)), F.lit(""))
    return F.struct(g(1).alias("author"), g(2).cast("int").alias("year"), g(3).alias("journal"), g(4).alias("volume"), g(5).alias("page"), g(6).alias("doi"), g(7).alias("misc"), (g(2).isNull() | g(3).isNull()).alias("bad"))


def golden_hue(index: int) -> str:
    """Colour of a category: hues a golden angle apart."""
    return f"hsl({(index * 137.508) % 360:.1f}, 65%, 50%)"
