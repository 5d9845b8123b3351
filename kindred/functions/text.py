"""Urls, file names, query ids and label lines as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.constants import CLASS_NAMES, KOREAN_TO_ENGLISH

# Characters that count as white space at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c"


def lookup(key: Column, table: dict) -> Column:
    """Value of key in a small literal table, null when absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def category_from_url(url: Column) -> Column:
    """Second folder of the url through the Korean table; null when there is none or it is not Korean."""
    folders = F.split(F.btrim(url, F.lit("/")), "/")
    return lookup(F.get(folders, F.lit(1)), KOREAN_TO_ENGLISH)


def url_to_english(url: Column) -> Column:
    """Every Korean category name in the url replaced by the English one."""
    for korean, english in KOREAN_TO_ENGLISH.items():
        url = F.replace(url, F.lit(korean), F.lit(english))
    return url


def resolve_path(url: Column, root: str) -> Column:
    """File path below root: upload markers removed, no leading slash, English folders."""
    relative = F.ltrim(F.replace(url, F.lit("/upload/"), F.lit("")), F.lit("/"))
    return F.concat(F.lit(root if root.endswith("/") else root + "/"), url_to_english(relative))


def category_from_query_id(query_id: Column) -> Column:
    """Longest category name that prefixes the id before an underscore, else null."""
    longest_first = sorted(CLASS_NAMES, key=len, reverse=True)
    return F.coalesce(
        *[F.when(F.startswith(query_id, F.lit(name + "_")), F.lit(name)) for name in longest_first]
    )


def class_id_from_file_name(file_name: Column) -> Column:
    """Class id of a leading [name] in Korean, null when missing or unmapped."""
    inner = F.regexp_extract(file_name, r"^\[([^\]]*)\]", 1)
    return lookup(
        F.btrim(inner, F.lit(BLANKS)),
        {korean: CLASS_NAMES.index(english) for korean, english in KOREAN_TO_ENGLISH.items()},
    )


def class_name(class_id: Column, fallback: str | None = None) -> Column:
    """Name of a class index; the fallback when it is out of range."""
    name = F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), class_id)
    return name if fallback is None else F.coalesce(name, F.lit(fallback))


def category_position(category: Column) -> Column:
    """Place of a category in the fixed order, null for others."""
    return lookup(category, {name: i for i, name in enumerate(CLASS_NAMES)})


def safe_name(category: Column, stem: Column) -> Column:
    """Output file stem: class and the part after the last '] ', odd characters as underscores."""
    raw = F.concat(category, F.lit("_"), F.substring_index(stem, "] ", -1))
    return F.regexp_replace(raw, r"[^\p{L}\p{N}_-]", "_")


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)


def query_id(category: Column, ordinal: Column) -> Column:
    """Category and ordinal, the latter with at least two digits."""
    return F.concat(category, F.when(ordinal < 10, "_0").otherwise("_"), ordinal.cast("string"))


def similarity_percent(similarity: Column) -> Column:
    return F.format_string("%.1f%%", similarity * 100)


def iso_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
