"""Small expressions: times, keys, lists, names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, spaced

#: A lifetime is this many seconds at least.
LEAST_SECONDS = 60


def expires(at: Column, seconds: Column) -> Column:
    """When something touched at this time ends, in microseconds since 1970."""
    return F.unix_micros(at.cast("timestamp")) + F.greatest(seconds.cast("long"), F.lit(LEAST_SECONDS)) * 1_000_000


def utc_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time, which is UTC where it names no offset; null if it is none."""
    named = F.regexp_like(text, F.lit(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    return F.unix_micros(F.when(named, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def iso_millis(at: Column) -> Column:
    """An ISO text with milliseconds and the offset of UTC, from a time without a zone."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def elapsed_millis(since: Column, until: Column) -> Column:
    """Whole milliseconds between two times, halves to even, 0 at least."""
    seconds = (F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(1e6)
    return F.bround(F.greatest(F.lit(0.0), seconds) * 1000.0).cast("long")


def limiter_key(api_key: Column, provider: Column, url: Column, model: Column, requests: Column, tokens: Column) -> Column:
    """The canonical JSON by which callers share a limiter: sorted keys, the secret as a short hash; null without a limit."""

    def quoted(value: Column) -> Column:
        text = F.lower(F.coalesce(clean(value), F.lit("")))
        return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    def number(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("null"))

    secret = F.left(F.sha1(F.coalesce(api_key, F.lit("")).cast("binary")), F.lit(12))
    parts = [F.lit('{"api_key_hash": "'), secret, F.lit('", "base_url": '), quoted(url), F.lit(', "model": '), quoted(model), F.lit(', "provider": '), quoted(provider), F.lit(', "rpm": '), number(requests), F.lit(', "tpm": '), number(tokens), F.lit("}")]
    return F.when(requests.isNotNull() | tokens.isNotNull(), F.concat(*parts))


def or_empty(values: Column) -> Column:
    """The list; null is empty."""
    return F.coalesce(values, F.array().cast("array<string>"))


def suffix_of_first(values: Column, prefix: str) -> Column:
    """What follows the prefix in the first text that begins with it; null if none does."""
    found = F.try_element_at(F.filter(values, lambda v: F.startswith(v, F.lit(prefix))), F.lit(1))
    return F.substring(found, len(prefix) + 1, 1 << 30)


def for_match(text: Column) -> Column:
    """Lower case; letters, digits and underscores alone."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


#: Fonts that slides replace.
FONTS = {"Helvetica": "Arial", "Times-Roman": "Times New Roman", "Courier": "Courier New"}


def font(name: Column) -> Column:
    """The slide font for a page font: a known replacement or the name itself; blank is null."""
    out = clean(name)
    table = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, out), out)


def missing(wanted: Column, available: Column) -> Column:
    """The wanted names that are not available, whatever their case, in their own order."""
    there = F.transform(available, lambda a: F.lower(a))
    return F.filter(wanted, lambda w: ~F.array_contains(there, F.lower(w)))


def distinct_texts(values: Column) -> Column:
    """Trimmed texts in order of their first occurrence, without blanks."""
    return F.array_distinct(F.filter(F.transform(values, clean), lambda v: v.isNotNull()))


def page_numbers(values: Column) -> Column:
    """Distinct numbers of 0 or more in ascending order, from texts that may be none."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    good = F.filter(numbers, lambda n: n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < F.lit(float("inf"))))
    return F.array_sort(F.array_distinct(good))


def signal(text: Column) -> Column:
    """A token of lower-case letters, digits and .+_- with single hyphens for everything else."""
    out = F.regexp_replace(F.lower(F.coalesce(clean(text), F.lit(""))), spaced(r"[\s/]+"), "-")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9.+_-]+", "-"), "-{2,}", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


#: The uploads that count as images.
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")


def upload_kind(name: Column, content_type: Column, types: Sequence[str] = IMAGE_TYPES, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> Column:
    """``image`` or ``pdf`` by the content type, else by the file's suffix; null if it is neither."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]\.([^./]+)$", 1))
    return F.when(kind.isin(*types), "image").when(kind == "application/pdf", "pdf").when(suffix.isin(*suffixes), "image").when(suffix == "pdf", "pdf")


#: Hosts that are this machine, and how names and addresses of private networks begin or end.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1")
PRIVATE = r"\.local$|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])(\.|$)"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and brackets; empty if there is none."""
    place = F.regexp_extract(F.lower(F.coalesce(clean(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(place, "^.*@", "")
    return F.when(F.startswith(bare, F.lit("[")), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, ":.*$", ""))


def private_host(url: Column) -> Column:
    """Whether a URL leads to this machine or a private network."""
    name = host(url)
    return name.isin(*LOCAL_HOSTS) | F.regexp_like(name, F.lit(PRIVATE))


def inside(path: Column) -> Column:
    """Whether a relative path stays below its folder: it is not absolute and no part of it leads up."""
    return F.coalesce((path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))
