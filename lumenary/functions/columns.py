"""Parsers, lookups and path functions as Catalyst expressions: Column in, Column out, no Python on executors.

Errors are values: a bad input gives a null result and a text in `error`, never an exception in a task.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import fixed

SPACE = r"[\t-\r \x{85}\x{A0}]"
INTEGER = r"^[+-]?[0-9]+\z"


def lookup(table: dict, key: Column, default=None) -> Column:
    """A literal map's value for the key; null keys and misses give the default."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), F.coalesce(key, F.lit("\0")))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")


def _integer(s: Column) -> Column:
    """A signed decimal integer of 64 bits, or null."""
    s = stripped(s)
    return F.when(s.rlike(INTEGER), s.try_cast("bigint"))


def size(s: Column) -> Column:
    """A size text -> struct(width, height, error): a preset, else WxH, else W,H."""
    t = F.lower(stripped(F.coalesce(s, F.lit(""))))
    width = lookup({k: w for k, (w, _) in fixed.SIZES.items()}, t)
    height = lookup({k: h for k, (_, h) in fixed.SIZES.items()}, t)
    by = F.when(F.size(F.split(t, "x")) == 2, F.split(t, "x")).when(F.size(F.split(t, ",")) == 2, F.split(t, ","))
    first, second = _integer(by[0]), _integer(by[1])
    error = (
        F.when(width.isNotNull(), F.lit(None))
        .when(by.isNull(), F.concat(F.lit("invalid size: "), t))
        .when(first.isNull(), F.concat(F.lit("invalid width: "), by[0]))
        .when(second.isNull(), F.concat(F.lit("invalid height: "), by[1]))
    )
    ok = first.isNotNull() & second.isNotNull()
    return F.struct(F.coalesce(width.cast("bigint"), F.when(ok, first)).alias("width"), F.coalesce(height.cast("bigint"), F.when(ok, second)).alias("height"), error.alias("error"))


def filter_name(s: Column) -> Column:
    """The canonical name of a filter's spelling (case matters), or null."""
    return lookup({x: name for name, xs in fixed.FILTERS.items() for x in xs}, s)


def filter_label(s: Column) -> Column:
    """The name of a filter, `unknown` for what is none."""
    return F.coalesce(filter_name(s), F.lit("unknown"))


def colour(s: Column) -> Column:
    """A colour text -> struct(r, g, b, a, error): a name, #hex or hex of 3, 6 or 8 digits."""
    t = stripped(F.coalesce(s, F.lit("")))
    name = F.lower(t)
    digits = F.regexp_replace(t, r"^#", "")
    hex_ = F.when(digits.rlike(r"^[0-9a-fA-F]{3}\z"), F.concat(F.regexp_replace(digits, "(.)", "$1$1"), F.lit("ff"))).when(digits.rlike(r"^[0-9a-fA-F]{6}\z"), F.concat(digits, F.lit("ff"))).when(digits.rlike(r"^[0-9a-fA-F]{8}\z"), digits)
    parts = []
    for k, channel in enumerate("rgb"):
        named = lookup({n: c[k] for n, c in fixed.COLOURS.items()}, name)
        parts.append(F.coalesce(named, F.conv(F.substring(hex_, 2 * k + 1, 2), 16, 10).cast("int")).alias(channel))
    known = lookup(dict.fromkeys(fixed.COLOURS, 255), name)
    parts.append(F.coalesce(known, F.conv(F.substring(hex_, 7, 2), 16, 10).cast("int")).alias("a"))
    error = F.when(known.isNull() & hex_.isNull(), F.concat(F.lit("invalid color: "), t))
    return F.struct(*parts, error.alias("error"))


def extension(path: Column) -> Column:
    """The last dot and what follows it in the last path element, or ''."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def content_type(name: Column) -> Column:
    return lookup(fixed.CONTENT_TYPES, F.lower(extension(name)), fixed.OCTETS)


def image_format(path: Column) -> Column:
    """The format that an image's extension names, or null."""
    return lookup(fixed.IMAGE_FORMATS, F.lower(extension(path)))


def log_level(s: Column) -> Column:
    """The level; anything unknown, and null, is `error`."""
    return lookup(fixed.LOG_LEVELS, F.lower(s), "error")


def clean_path(path: Column) -> Column:
    """The shortest equal path: no empty or '.' elements, '..' resolved; '.' if nothing is left."""
    rooted = F.startswith(path, F.lit("/"))
    start = F.array().cast("array<string>")

    def last(done: Column) -> Column:
        return F.try_element_at(done, F.lit(-1))

    def step(done: Column, x: Column) -> Column:
        up = F.when(F.coalesce(last(done), F.lit("..")) != "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(F.lit(".."))))
        return F.when(x.isin("", "."), done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def output_path(path: Column, folder: Column | None = None) -> Column:
    """struct(path, error): the next version's name, as .jpg, in the folder or where the input is."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    ext = extension(name)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    versioned = base.rlike(r"^.+_v[0-9]+\z")
    number = F.regexp_extract(base, r"_v([0-9]+)\z", 1).try_cast("bigint")
    next_ = F.try_add(number, F.lit(1).cast("bigint"))
    stem = F.when(versioned, F.concat(F.regexp_extract(base, r"^(.+)_v[0-9]+\z", 1), F.lit("_v"), next_.cast("string"))).otherwise(F.concat(base, F.lit("_v0")))
    own = F.regexp_extract(path, r"^(.*/)?[^/]*/*\z", 1)
    where = own if folder is None else F.when(F.coalesce(folder, F.lit("")) == "", own).otherwise(F.concat(folder, F.lit("/")))
    error = F.when(versioned & next_.isNull(), F.concat(F.lit("version out of range: "), base))
    return F.struct(clean_path(F.concat(where, stem, F.lit(".jpg"))).alias("path"), error.alias("error"))


def zone_id(s: Column) -> Column:
    return F.regexp_replace(s, r"^/hostedzone/", "")


def zone_name(s: Column) -> Column:
    return F.regexp_replace(s, r"\.\z", "")


def headline(sidecar: Column) -> Column:
    """The first headline that a sidecar text states, or null."""
    return F.nullif(F.regexp_extract(sidecar, r'contentHeadline[\t\n\f\r ]*=[\t\n\f\r ]*"([^"]*)"', 1), F.lit(""))


def bare_etag(s: Column) -> Column:
    return F.regexp_replace(s, r'^"+|"+\z', "")


def object_key(path: Column, root: str) -> Column:
    """The path below a root folder."""
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def random_id(data: Column) -> Column:
    """Eight letters from the first eight bytes: letter number byte mod 36."""
    letters = F.lit(fixed.ID_LETTERS)
    digits = F.hex(data)
    return F.concat(*[F.substring(letters, (F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int") % 36) + 1, F.lit(1)) for k in range(8)])


def is_missing_stack(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit(fixed.NOT_THERE)), F.lit(False))


def is_no_update(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit(fixed.NO_CHANGE)), F.lit(False))


def stack_name(tool: str, subdomain: Column) -> Column:
    return F.concat(F.lit(f"{tool}-"), subdomain)


def bucket_name(tool: str, subdomain: Column, account: Column) -> Column:
    return F.concat_ws("-", F.lit(tool), subdomain, account)


def site_name(subdomain: Column, domain: Column) -> Column:
    return F.concat(subdomain, F.lit("."), domain)


def site_url(subdomain: Column, domain: Column) -> Column:
    return F.concat(F.lit("https://"), site_name(subdomain, domain))


def font_name(font: Column, points: Column) -> Column:
    return F.concat_ws(" ", font, points.cast("string"))
