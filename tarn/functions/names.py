"""Package names, install names and platforms: validation and parsing as columns."""

from __future__ import annotations

import platform as host_platform

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 191
ALLOWED = r"^[A-Za-z0-9+\-._?=]*$"
#: What a platform is made of.
ARCHES, DARWIN, LINUX = ("i686", "x86_64"), "darwin", {"gnu": "linux-gnu", "musl": "linux-musl"}


def name_error(name: Column) -> Column:
    """Why a package name is not valid, first reason first; null for a valid one (and for null)."""
    return (
        F.when(F.length(name) == 0, "a package name must not be empty")
        .when(F.octet_length(name) > MOST_BYTES, f"a package name has at most {MOST_BYTES} bytes")
        .when(name.startswith("."), "a package name must not begin with a period")
        .when(~name.rlike(ALLOWED), "a package name has letters, digits and + - . _ ? = only")
    )


def is_name(name: Column) -> Column:
    return name.isNotNull() & name_error(name).isNull()


def parse_name(name: Column) -> Column:
    """The name; an error for one that is not valid."""
    return F.when(name_error(name).isNull(), name).otherwise(F.raise_error(F.concat(name_error(name), F.lit(": "), name)).cast("string"))


def install_name(name: Column, id_: Column) -> Column:
    return F.concat_ws("-", name, id_)


def install_parts(text: Column) -> tuple[Column, Column]:
    """Name and id of an install name, which is cut at its last hyphen."""
    return F.regexp_extract(text, r"(?s)^(.*)-([^-]*)$", 1), F.regexp_extract(text, r"(?s)^(.*)-([^-]*)$", 2)


def package_name(name: Column, version: Column) -> Column:
    """What a spec's package is called."""
    return F.concat_ws("-", name, version)


def platform_parts(text: Column) -> Column:
    """struct(arch, os, env), null for text that is no platform. What follows darwin- is ignored."""
    parts = F.split(text, "-", 3)
    arch, os, env = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    linux = (os == "linux") & F.coalesce(env.isin(*LINUX), F.lit(False))
    ok = arch.isin(*ARCHES) & ((os == DARWIN) | linux)
    return F.when(ok, F.struct(arch.alias("arch"), os.alias("os"), F.when(os == "linux", env).alias("env")))


def platform(text: Column) -> Column:
    """The canonical text of a platform; null for text that is none."""
    parts = platform_parts(text)
    return F.when(parts.isNotNull(), F.concat_ws("-", parts["arch"], parts["os"], parts["env"]))


def host() -> str:
    """The platform of this machine."""
    machine = host_platform.machine().lower()
    arch = "x86_64" if machine in ("x86_64", "amd64") else "i686"
    if host_platform.system() == "Darwin":
        return f"{arch}-{DARWIN}"
    return f"{arch}-{LINUX['musl' if 'musl' in host_platform.libc_ver()[0] else 'gnu']}"


def version_parts(version: Column) -> Column:
    """struct(major, minor, patch, pre, build) of a semantic version; null for text that is none."""
    number, tag = r"(0|[1-9]\d*)", r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
    form = rf"^{number}\.{number}\.{number}(?:-({tag}))?(?:\+({tag}))?$"
    part = lambda i: F.regexp_extract(version, form, i)
    whole = [part(i + 1).cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))]
    tags = [F.when(part(i) != "", part(i)).alias(n) for i, n in ((4, "pre"), (5, "build"))]
    return F.when(version.rlike(form), F.struct(*whole, *tags))


def file_kind(content: Column) -> Column:
    """elf, macho or other, by the first bytes."""
    magic = F.lower(F.hex(F.substring(content, 1, 4)))
    return F.when(magic == "7f454c46", "elf").when(magic.isin("feedface", "feedfacf", "cefaedfe", "cffaedfe", "cafebabe"), "macho").otherwise("other")
