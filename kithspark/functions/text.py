"""Column functions over names, paths and values to show."""

from __future__ import annotations

import os
import string

from pyspark.sql import Column, functions as F

from kithspark.schemas import DEVICE_NAMES, GALLERY_LENGTH, NAME_LENGTH

_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def name_key(name: Column) -> Column:
    """Key of names that differ in the case of ASCII letters only; null stays null."""
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(_BLANK))


def _is_device(name: Column) -> Column:
    return F.upper(name).isin(*DEVICE_NAMES)


def folder_name(name: Column) -> Column:
    """Folder for a typed name, null if it names nobody.

    Characters that a file system refuses become ``_``; the length is limited,
    trailing dots and blanks go, and names of devices get a leading ``_``.
    """
    s = stripped(name)
    cleaned = F.rtrim(F.substring(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, NAME_LENGTH), F.lit(". "))
    safe = F.when(_is_device(cleaned), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)
    return F.when(F.lower(s).isin("", "skip", "unknown") | (cleaned == ""), F.lit(None)).otherwise(safe)


def gallery_name(name: Column) -> Column:
    """Folder of a person in a gallery, before collisions are resolved; never null."""
    s = stripped(F.coalesce(name, F.lit("")))
    cleaned = F.rtrim(F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
    named = F.when(cleaned.rlike(r"^[. ]*$"), F.lit("unnamed")).otherwise(cleaned)
    return F.substring(F.when(_is_device(named), F.concat(named, F.lit("_"))).otherwise(named), 1, GALLERY_LENGTH)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """The last dot of the base name and what follows, '' without one; a leading dot begins no suffix."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    base = basename(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(suffix(path)))


def resolved_path(path: Column, root: Column) -> Column:
    """An absolute path as it is, a relative one under ``root``."""
    absolute = path.rlike(r"^(/|[A-Za-z]:[\\/])")
    return F.when(absolute, path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def index_list(text: Column) -> Column:
    """'1,3 5' as sorted distinct numbers from 1 up; null if any part is none or there is none."""
    part = F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: x != "")
    number = F.transform(part, lambda x: F.when(x.rlike(r"^[+-]?\d{1,9}$"), x.cast("int")))
    good = (F.size(part) > 0) & F.forall(number, lambda x: F.coalesce(x >= 1, F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(number)))


def command(text: Column, known: list[str]) -> Column:
    """The first word, in lower case, if it is a known command, else null."""
    first = F.lower(F.element_at(F.split(stripped(text), r"\s+"), 1))
    return F.when(first.isin(*known), first)


def name_list(text: Column) -> Column:
    """A comma-separated list as trimmed names; of names that differ in case only, the first.

    Sorted by name and place, a name's repeats follow its first, so a long list
    takes a sort and not a comparison of each name with all before it.
    """
    part = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x, i: F.struct(F.lower(stripped(x)).alias("key"), i.alias("place"), stripped(x).alias("name")))
    names = F.array_sort(F.filter(part, lambda x: x["key"] != ""))
    first = F.zip_with(names, F.concat(F.array(F.lit(None)), names), lambda x, before: F.when(x["key"] != F.coalesce(before["key"], F.lit("")), F.struct(x["place"], x["name"])))
    return F.transform(F.array_sort(F.array_compact(first)), lambda x: x["name"])


def first_by(values: Column, key) -> Column:
    """An array without the elements whose ``key`` came before, in its order."""
    return F.filter(values, lambda x, i: ~F.exists(F.slice(values, F.lit(1), i), lambda y: key(y) == key(x)))


def decoded_list(text: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def merged_samples(old: Column, new: Column, most: int) -> Column:
    """Old paths, then new ones that differ from all before in more than case; at most ``most``."""
    none = F.array().cast("array<string>")
    return F.slice(F.concat(F.coalesce(old, none), _unseen(F.coalesce(old, none), F.coalesce(new, none))), 1, most)


def _unseen(old: Column, new: Column) -> Column:
    fresh = F.filter(new, lambda x: ~F.exists(old, lambda y: F.lower(y) == F.lower(x)))
    return first_by(fresh, F.lower)


def iso_seconds(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def when_text(at: Column, now: Column) -> Column:
    """How long ago: just now, minutes, hours, days, and the date after a week."""
    s = F.round(F.unix_micros(now) / 1e6 - F.unix_micros(at) / 1e6)
    ago = lambda unit, name: F.concat(F.floor(s / unit + 0.5).cast("string"), F.lit(f" {name} ago"))
    return F.when(at.isNull(), "").when(s < 45, "just now").when(s < 3600, ago(60, "min")).when(s < 86400, ago(3600, "h")).when(s < 604800, ago(86400, "d")).otherwise(F.date_format(at, "MMM d"))


def bytes_text(n: Column) -> Column:
    """A size with its unit; one decimal below ten."""
    n = F.coalesce(n, F.lit(0))
    out = F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / F.lit(float(1024**power))
        text = F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v))
        out = out.when(v < 1024, F.concat(text, F.lit(f" {unit}"))) if unit != "TB" else out.otherwise(F.concat(text, F.lit(f" {unit}")))
    return out


def duration_text(seconds: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes."""
    n = F.coalesce(seconds.cast("double"), F.lit(0.0))
    minutes, rest = F.floor(n / 60), F.floor(F.pmod(n, F.lit(60.0)) + 0.5)
    short = F.when(n < 10, F.format_string("%.1fs", n)).otherwise(F.format_string("%.0fs", n))
    middle = F.when(rest == 0, F.format_string("%dm", minutes)).otherwise(F.format_string("%dm %ds", minutes, rest))
    return F.when(n < 60, short).when(minutes < 60, middle).otherwise(F.format_string("%dh %dm", F.floor(minutes / 60), F.pmod(minutes, F.lit(60))))


def plural(count: Column, word: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(F.coalesce(count, F.lit(0)), 0), F.lit(" "), F.when(count == 1, F.lit(word)).otherwise(F.lit(many or f"{word}s")))


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def throughput(count: Column, seconds: Column) -> Column:
    """Per second, 0 where no time passed."""
    return F.coalesce(F.when(seconds > 0, count / seconds), F.lit(0.0))


def workers(wanted, cores: int | None = None) -> int:
    """Parallel tasks for a wish: none or 0 gives half the cores, four at most; else between 1 and the cores."""
    cores = cores or os.cpu_count() or 1
    try:
        n = int(wanted)
    except (TypeError, ValueError):
        n = 0
    return max(1, min(cores // 2, 4)) if n <= 0 else max(1, min(n, cores))


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cast_or(text: Column, kind: str, default) -> Column:
    """``text`` as ``kind``, or the default if it is none."""
    return F.coalesce(text.try_cast(kind), F.lit(default).cast(kind))
