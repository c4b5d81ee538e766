"""Columns of addresses and identities of videos and channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = "[a-zA-Z0-9_-]{11}"
#: Tabs of a channel page that its address may end with.
TABS = "videos|shorts|featured|community|about|channels|playlists|streams|live"


def _part(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def video_id_from_url(text: Column) -> Column:
    """The 11 characters of a video's address in any of its forms; other input comes back as it is."""
    s = F.trim(text)
    return F.coalesce(
        F.when(s.rlike(f"^{_ID}$"), s),
        _part(s, rf"[?&]v=({_ID})(?:[&#]|$)"),
        _part(s, rf"youtu\.be/({_ID})(?:[/?&#]|$)"),
        _part(s, rf"/(?:shorts|embed|live|v)/({_ID})(?:[/?&#]|$)"),
        _part(s, rf"(?:v=|/)({_ID})(?:[&?]|$)"),
        s,
    )


def local_id(path: Column) -> Column:
    return F.concat(F.lit("loc_"), F.substring(F.md5(path), 1, 7))


def channel_url_norm(text: Column) -> Column:
    """The canonical address of a channel's videos, for a handle, an id, a name or an address."""
    s = F.trim(text)
    s = F.when(s.rlike(r"(?i)^(?:www\.|m\.)?youtube\.com"), F.concat(F.lit("https://"), s)).otherwise(s)
    path = F.regexp_replace(F.regexp_extract(s, r"^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    path = F.regexp_replace(path, f"/(?:{TABS})$", "")
    base = F.lit("https://www.youtube.com")
    tail = F.lit("/videos")
    return (
        F.when(s == "", "")
        .when(s.rlike("^https?://"), F.concat(base, path, tail))
        .when(s.startswith("@"), F.concat(base, F.lit("/"), s, tail))
        .when(s.startswith("UC") & (F.length(s) >= 20), F.concat(base, F.lit("/channel/"), s, tail))
        .otherwise(F.concat(base, F.lit("/@"), s, tail))
    )


def channel_tokens(*values: Column) -> Column:
    """Ids (as written), handles and slugs (lower case) that the values name, sorted."""
    parts = []
    for value in values:
        s = F.trim(F.coalesce(value, F.lit("")))
        url = F.lower(s).rlike("^https?://")
        cid = s.rlike(r"^UC[A-Za-z0-9_\-]{20,}$")
        handle = F.lower(F.regexp_extract(s, r"^@?([A-Za-z0-9._\-]{3,40})$", 1))
        every = lambda p, lower: F.transform(F.regexp_extract_all(s, F.lit(p), F.lit(1)), F.lower if lower else (lambda x: x))  # noqa: B023, E731
        found = F.concat(
            every(r"(?i)youtube\.com/@([^/?#]+)", True), every(r"(?i)youtube\.com/channel/(UC[A-Za-z0-9_\-]+)", False), every(r"(?i)youtube\.com/(?:c|user)/([^/?#]+)", True)
        )
        parts.append(F.when(url, found).when(cid, F.array(s)).when(handle != "", F.array(handle)).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def is_identifiable_channel(text: Column) -> Column:
    s = F.trim(F.coalesce(text, F.lit("")))
    return F.lower(s).rlike("^https?://") | s.startswith("@") | s.rlike(r"^UC[A-Za-z0-9_\-]{20,}$")


def channel_match(wanted: Column, *found: Column) -> Column:
    """Whether both sides name a common identity; an empty side matches nothing."""
    return F.coalesce(F.arrays_overlap(channel_tokens(wanted), channel_tokens(*found)), F.lit(False))


def clip_name(video: Column, rank: Column, start_seconds: Column) -> Column:
    return F.format_string("%s_clip_%d_%ds", video.cast("string"), rank.cast("long"), start_seconds.cast("long"))


def mask_secret(text: Column) -> Column:
    """First and last four characters, stars between; all stars up to eight characters."""
    n = F.length(text)
    return F.when(n > 8, F.concat(F.substring(text, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(text, -4, 4))).otherwise(F.repeat(F.lit("*"), n))
