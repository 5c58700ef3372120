"""Canonical JSON of trees, packages and specs: fixed field order, sorted keys, no white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.ids import is_id
from tarn.functions.names import name_error, platform, platform_parts, version_parts

#: Schema of an entry of a tree; a symbolic link has a target, the others an id.
ENTRY = "struct<type:string,id:string,target:string>"
TREE = "entries map<string,struct<type:string,id:string,target:string>>"
PACKAGE = "name string, system string, references array<string>, self_references map<string,array<bigint>>, tree string"
SPEC = "name string, version string, description string, license string, target string, dependencies array<string>, build_dependencies array<string>, builder string"


def _escapes(json: Column) -> Column:
    """Control characters as lower-case escapes. Spark writes them in upper case; a backslash that is itself escaped is left."""
    for code in range(0x20):
        upper = f"{code:04X}"
        if upper != upper.lower():
            json = F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*)\\u{upper}", rf"$1\\u{upper.lower()}")
    return json


def sorted_map(entries: Column) -> Column:
    """A map with its keys in order (array_sort compares by the key first, and keys are unique)."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def tree_json(entries: Column) -> Column:
    """entries: map of name to ENTRY. Absent fields of an entry are left out."""
    pairs = F.array_sort(F.map_entries(entries))
    one = F.transform(pairs, lambda p: _pair(p["key"], p["value"]))
    return F.when(entries.isNotNull(), _escapes(F.concat(F.lit('{"entries":{'), F.concat_ws(",", one), F.lit("}}"))))


def entry_json(name: Column, entry: Column) -> Column:
    """What tree_json() writes for one entry."""
    return _escapes(_pair(name, entry))


def _pair(name: Column, entry: Column) -> Column:
    return F.concat(_name(name), F.lit(":"), F.to_json(entry))


def _name(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def package_json(row: dict[str, Column]) -> Column:
    fields = [
        row["name"].alias("name"),
        row["system"].alias("system"),
        F.array_sort(F.array_distinct(row["references"])).alias("references"),
        sorted_map(row["self_references"]).alias("self_references"),
        row["tree"].alias("tree"),
    ]
    return _escapes(F.to_json(F.struct(*fields)))


def spec_json(row: dict[str, Column]) -> Column:
    """Absent optional fields are null, not left out."""
    names = [f.split()[0] for f in SPEC.split(", ")]
    fields = [(F.array_sort(F.array_distinct(row[n])) if n.endswith("dependencies") else row[n]).alias(n) for n in names]
    return _escapes(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def parse(kind: str, json: Column) -> Column:
    """The fields of a tree, package or spec; an error for JSON that does not parse."""
    return F.from_json(json, {"tree": TREE, "pkg": PACKAGE, "spec": SPEC}[kind], {"mode": "FAILFAST"})


def fault(kind: str, f: Column) -> Column:
    """What is wrong with parsed fields: a required one is missing, or a name, platform, version or id is not valid. Null for nothing."""
    bad = lambda what, wrong, shown=None: F.when(wrong, F.concat(F.lit(f"{what}: "), F.coalesce(shown, F.lit("null"))) if shown is not None else F.lit(what))
    none_id = lambda ids: F.coalesce(F.exists(ids, lambda i: ~is_id(i)), F.lit(True))
    if kind == "tree":
        entries = F.map_values(f["entries"])
        wrong = F.exists(entries, lambda e: F.when(e["type"].isin("Tree", "Blob"), ~is_id(e["id"])).when(e["type"] == "Symlink", e["target"].isNull()).otherwise(True))
        return F.coalesce(bad("a tree without entries", f["entries"].isNull()), bad("a tree entry without a valid id, target or type", wrong))
    no_name = lambda c: c.isNull() | name_error(c).isNotNull()
    if kind == "pkg":
        return F.coalesce(
            bad("not a package name", no_name(f["name"]), f["name"]),
            bad("not a platform", platform_parts(f["system"]).isNull(), f["system"]),
            bad("a reference that is no object id", none_id(f["references"])),
            bad("a self-reference that is no object id", none_id(F.map_keys(f["self_references"]))),
            bad("not an object id", ~is_id(f["tree"]), f["tree"]),
        )
    return F.coalesce(
        bad("not a package name", no_name(f["name"]), f["name"]),
        bad("not a version", version_parts(f["version"]).isNull(), f["version"]),
        bad("not a platform", f["target"].isNotNull() & platform_parts(f["target"]).isNull(), f["target"]),
        bad("a dependency that is no object id", none_id(f["dependencies"]) | none_id(f["build_dependencies"])),
        bad("a spec without a builder", f["builder"].isNull()),
    )


def decode(kind: str, json: Column) -> Column:
    """parse(), and an error for fields that are not valid. Platforms come in their canonical form."""
    f = parse(kind, json)
    wrong = fault(kind, f)
    # the error is chosen inside a field, so that asking for one field is enough to raise it
    first = {"tree": "entries", "pkg": "name", "spec": "name"}[kind]
    kind_of = {"tree": TREE.split(" ", 1)[1], "pkg": "string", "spec": "string"}[kind]
    checked = F.when(wrong.isNull(), f[first]).otherwise(F.raise_error(F.concat(F.lit(f"not a valid {kind}: "), wrong)).cast(kind_of))
    f = f.withField(first, checked)
    system = {"pkg": "system", "spec": "target"}.get(kind)
    return F.when(json.isNotNull(), f if system is None else f.withField(system, platform(f[system])))
