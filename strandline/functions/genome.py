"""Coordinates inside identifiers, browser links and name clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifiers' formats and the browser's address.
COORDINATES = r"(chr[\dXYM]+):(\d+)-(\d+)"
STRANDED = r"^[^+-]+([+-])(chr\w+):(\d+)-(\d+)"
BROWSER = "https://genome.ucsc.edu/cgi-bin/hgTracks?db="
POSITION_PARAMETER, USER_PARAMETERS, SESSION_PARAMETER = "&position=", "&hgS_doOtherUser=submit&hgS_otherUserName=", "&hgS_otherUserSessionName="
WRAPPED_LINK, LINK_POSITION, PLAIN_COORDINATES = r'=HYPERLINK\("([^"]+)"', r"position=([^&]+)", r"^chr[^:]*:\d+-\d+$"


def coordinates(text: Column) -> Column:
    """``chrom``, ``start``, ``end`` of the first coordinates in a text; null without."""
    part = lambda i: F.regexp_extract(text, COORDINATES, i)
    return F.when(text.rlike(COORDINATES), F.struct(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def stranded_coordinates(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, STRANDED, i)
    return F.when(text.rlike(STRANDED), F.struct(part(1).alias("strand"), part(2).alias("chrom"), part(3).cast("long").alias("start"), part(4).cast("long").alias("end")))


def biological_start(strand: Column, start: Column, end: Column) -> Column:
    return F.when(strand == "+", start).otherwise(end)


def browser_link(text: Column, db: str = "hg38") -> Column:
    """A spreadsheet link to the first coordinates in a text; empty without."""
    c = coordinates(text)
    position = F.concat(c["chrom"], F.lit(":"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))
    return F.coalesce(F.concat(F.lit(f'=HYPERLINK("{BROWSER}{db}{POSITION_PARAMETER}'), position, F.lit('", "'), position, F.lit('")')), F.lit(""))


def plain_link(link: Column) -> Column:
    """The address inside a spreadsheet link, or the link itself if it is one."""
    return F.when(link.rlike(WRAPPED_LINK), F.regexp_extract(link, WRAPPED_LINK, 1)).when(link.startswith("http"), link)


def session_link(link: Column, user: str, session: str, db: str = "hg38") -> Column:
    """A link to a saved session at the link's position."""
    at = F.regexp_extract(link, LINK_POSITION, 1)
    name = F.replace(F.url_encode(F.lit(session)), F.lit("+"), F.lit("%20"))
    base = F.concat(F.lit(f"{BROWSER}{db}{USER_PARAMETERS}{user}{SESSION_PARAMETER}"), name)
    return F.when(link.isNull(), F.lit(None)).when(at != "", F.concat(base, F.lit(POSITION_PARAMETER), at)).otherwise(base)


def link_or_coordinates(link: Column, *fallbacks: Column, db: str = "hg38") -> Column:
    """The plain link, else one from the first non-null coordinates that begin with ``chr``."""
    at = F.coalesce(*fallbacks)
    return F.coalesce(plain_link(link), F.when(at.rlike(PLAIN_COORDINATES), F.concat(F.lit(f"{BROWSER}{db}{POSITION_PARAMETER}"), at)))


def without_isoform(name: Column) -> Column:
    return F.regexp_replace(name, "-.*$", "")


def without_version(name: Column) -> Column:
    return F.regexp_replace(name, r"\..*$", "")


def padded_channel(name: Column) -> Column:
    """``b1.x`` as ``b01.x``."""
    return F.regexp_replace(name, r"^b(\d)\.", "b0$1.")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_")
