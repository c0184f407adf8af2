"""Word tables and text helpers of the bibliographic operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gender of common given names of the region.
GENDERS = {n: "female" for n in "andrea beatriz catalina cecilia concepción daniela dolores elizabeth gabriela graciela hortensia isabel julia leticia lucía margarita mercedes patricia pilar raquel rosario teresa verónica victoria ximena yolanda zenaida".split()} | {
    n: "male" for n in "alberto alejandro antonio benjamín eduardo emilio enrique fernando francisco gerardo guillermo héctor ignacio javier jesús jorge josé manuel martín nicolás óscar rafael ramón roberto sergio tomás ulises wilfrido".split()
}

# Letters with their plain form, for keys that ignore accents.
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
# Months and seasons as they are abbreviated in bibliographic records.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "win": 1, "spr": 4, "sum": 7, "fal": 10}
# Texts that stand for a missing value.
SENTINELS = ("", "none", "nan", "<na>", "null")


def entity_key(c: Column) -> Column:
    """Lower case without accents and the punctuation ``,`` and ``.``; hyphens become blanks, runs of blanks one."""
    folded = F.lower(F.translate(c, ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded, "[,.]", ""), "-", " "), r"\s+", " "))


def slug(c: Column) -> Column:
    """Word characters joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9_\s-]", ""), r"[\s-]+", "_")


def clean_number(c: Column) -> Column:
    """A number written with ``%`` and thousands commas; null if it is none."""
    return F.regexp_replace(c, "[%,]", "").try_cast("double")


def year_of(c: Column) -> Column:
    """First year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")


def reference_key(c: Column) -> Column:
    """Normal key of a reference: ``doi:...``, ``W`` and digits, or the collapsed lower text."""
    doi = F.lower(F.regexp_extract(c, r"(10\.\d{4,9}/[^\s;,]+)", 1))
    work = F.regexp_extract(F.upper(c), r"(W\d{8,11})\b", 1)
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).when(work != "", work).otherwise(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))


def valid(c: Column) -> Column:
    """Whether a text is a value and not a sentinel for a missing one."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*SENTINELS), F.lit(False))


def country_of_affiliation(c: Column) -> Column:
    """Last comma part of an affiliation if it is longer than two letters and no number."""
    last = F.trim(F.element_at(F.split(c, ","), -1))
    return F.when((F.length(last) > 2) & ~last.rlike(r"^\d+$"), last)


def clean_text(c: Column) -> Column:
    """Text without tags, white space of any script collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))


def month_number(c: Column) -> Column:
    """Number of the month or season a text begins with; null if none."""
    out = None
    head = F.lower(F.substr(F.trim(c), F.lit(1), F.lit(3)))
    for name, number in MONTHS.items():
        out = F.when(head == name, number) if out is None else out.when(head == name, number)
    return out


def parse_wos_reference(c: Column) -> Column:
    """``author, year, journal`` of a comma-separated cited reference."""
    p = F.split(c, r",\s*")
    has_year = F.coalesce(F.get(p, F.lit(1)).rlike(r"^\d{4}$"), F.lit(False))
    return F.struct(F.get(p, F.lit(0)).alias("author"), F.when(has_year, F.get(p, F.lit(1)).cast("int")).alias("year"), F.when(has_year, F.get(p, F.lit(2))).alias("journal"))


def parse_apa_reference(c: Column) -> Column:
    """``author, year, rest`` of a reference whose year stands in parentheses; a leading ``in:`` drops."""
    rest = F.regexp_replace(F.trim(F.regexp_extract(c, r"\(\d{4}\)[.,]?\s*(.*)$", 1)), r"(?i)^in:\s*", "")
    return F.struct(F.trim(F.regexp_extract(c, r"^(.*?)\s*\(\d{4}\)", 1)).alias("author"), F.nullif(F.regexp_extract(c, r"\((\d{4})\)", 1), F.lit("")).cast("int").alias("year"), rest.alias("rest"))


def name_permutations(c: Column) -> Column:
    """Orders in which a name of two to four words may be written (surnames first or last, with and without comma)."""
    w = F.filter(F.split(F.trim(F.regexp_replace(c, r"[\s,]+", " ")), " "), lambda x: x != "")
    j = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    two = F.array(j(1, 2), F.concat(j(2, 1), F.lit(" "), j(1, 1)), F.concat(j(2, 1), F.lit(", "), j(1, 1)))
    three = F.array(j(1, 3), F.concat(j(2, 2), F.lit(" "), j(1, 1)), F.concat(j(2, 2), F.lit(", "), j(1, 1)), F.concat(j(3, 1), F.lit(", "), j(1, 2)), F.concat(j(1, 1), F.lit(" "), j(2, 1)))
    four = F.array(j(1, 4), F.concat(j(3, 2), F.lit(" "), j(1, 2)), F.concat(j(3, 2), F.lit(", "), j(1, 2)), F.concat(j(1, 1), F.lit(" "), j(3, 1)), F.concat(j(1, 1), F.lit(" "), j(3, 2)), F.concat(j(3, 1), F.lit(", "), j(1, 2)))
    return F.when(F.size(w) == 2, two).when(F.size(w) == 3, three).when(F.size(w) == 4, four).otherwise(F.array(c))


def author_ids(c: Column) -> Column:
    """Canonical author ids (``A`` and digits) in a list, CSV or URL text, first occurrences in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.upper(c), F.lit(r"(A\d{4,})"), F.lit(1)), lambda x: x))


def copyright_split(c: Column) -> Column:
    """``text, notice``: an abstract and the copyright notice at its end.

    A notice fills the last line, follows the end of a sentence there or begins with its year; signs
    within sentences or words (as in damaged texts) are none.
    """
    pattern = r"(?i)(?:^|(?<=[.!?\n])|\s(?=(?:©|\(c\)|copyright)[\s©]*\d{4}))\s*((?:©|\(c\)|copyright)(?:\s|(?<=©)\d).*)\s*$"
    return F.struct(F.regexp_replace(c, pattern, "").alias("text"), F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("notice"))


def inverted_index_text(c: Column) -> Column:
    """Text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
