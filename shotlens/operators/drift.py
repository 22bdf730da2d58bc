"""Records whose fields change from file to file, read into one typed table.

Each payload is parsed once, inside the JVM, into a variant.  A field is known by its class: its name without case and
separators, or the class to which the alias table ties that name.  ``ingest`` enforces the target schema and keeps every
field that it does not know or cannot cast as JSON in ``rescued``, and beside the typed columns, in ``delivered``, the name and
kind under which each of their fields came; ``promote`` turns approved unknown fields into typed
columns; ``replay`` tries rescued values of known fields again with looser rules (an object's ``value``, the only element
of an array).  ``field_changes`` reads the ingested table, its ``delivered`` and ``rescued`` columns, and compares the fields of each
file with those of its feed's file before it: one reading of the payloads serves the table and the report.

Defined results: a payload that is null, empty, no JSON or no object is no record; repeated records stay in the table; of
several names or types of one class in a file the most frequent counts, by name in a tie, nulls aside; a field that is
null throughout a file has no type there, so no change of type; a file without any record is passed over; files of the
same number follow each other by file_id; a feed's first file changes nothing; empty tables give empty results; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlens.session import cut
from shotlens.sources.tables import require_columns

#: The alias table is fixed and small; beyond this many rows it is refused rather than put into the plan.
MOST_ALIASES = 10_000
FILE = ["feed_id", "file_id", "file_no"]


def plain(name: Column) -> Column:
    """A name without case and separators."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def alias_classes(aliases: DataFrame) -> dict[str, str]:
    """Plain name -> class for every name in the alias table; ties are followed through."""
    rows = aliases.select(plain(F.col("alias_name")).alias("a"), plain(F.col("current_name")).alias("b")).dropna().distinct().limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    to = {r.a: r.b for r in sorted(rows) if r.a != r.b}

    def end(x: str) -> str:
        seen = {x}
        while to.get(x, x) not in seen:
            seen.add(x := to[x])
        return x

    return {x: end(x) for x in {*to, *to.values()}}


def field_class(name: Column, classes: dict[str, str]) -> Column:
    return _class_of(plain(name), classes)


def _class_of(p: Column, classes: dict[str, str]) -> Column:
    if not classes:
        return p
    known = F.create_map(*[F.lit(x) for pair in sorted(classes.items()) for x in pair])
    return F.coalesce(known[p], p)


def records(raw: DataFrame) -> DataFrame:
    """The payloads that are JSON objects, as variants."""
    require_columns(raw, *FILE, "record_no", "payload")
    v = raw.select(*FILE, "record_no", F.try_parse_json("payload").alias("v")).where(F.col("v").isNotNull())
    return v.where(F.schema_of_variant("v").startswith("OBJECT"))


#: The kinds of the types that variants have; all other types are numbers.
KINDS = {"VOID": "null", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array"}


def _kind(value: Column) -> Column:
    """The kind of a variant, "null" for a JSON null; the type is asked for once."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(known[F.substring_index(F.schema_of_variant(value), "<", 1)], F.lit("number"))


def fields(table: DataFrame) -> DataFrame:
    """(file, name, kind, n): the top-level fields of an ingested table and in how many records of a file each stands; kind is null for a JSON null."""
    entries = F.map_entries(F.expr("cast(try_parse_json(rescued) as map<string, variant>)"))
    rescued = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), _kind(e["value"]).alias("kind")))
    names = F.when(F.col("rescued").isNull(), F.col("delivered")).otherwise(F.concat("delivered", rescued))
    # the records of a file mostly have the same fields, so they are counted before they are taken apart
    alike = table.select(*FILE, names.alias("names")).groupBy(*FILE, "names").agg(F.count("*").alias("n"))
    return alike.select(*FILE, F.explode("names").alias("f"), "n").select(*FILE, "f.name", F.nullif("f.kind", F.lit("null")).alias("kind"), "n")


def file_fields(cells: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(file, class, name, kind): how each file spells and types each field."""
    per = cells.groupBy(*FILE, "name", "kind").agg(F.sum("n").alias("n")).withColumn("class", field_class(F.col("name"), classes))
    names = per.groupBy(*FILE, "class", "name").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("k"), "kind"))).alias("kinds"))
    return names.groupBy(*FILE, "class").agg(
        F.min(F.struct((-F.col("n")).alias("k"), "name")).alias("top"), F.array_min(F.flatten(F.collect_list("kinds"))).alias("most")
    ).select(*FILE, "class", F.col("top.name").alias("name"), F.col("most.kind").alias("kind"))


def field_changes(table: DataFrame, aliases: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind, old_name) for each file of an ingested table but the first of its feed."""
    require_columns(table, *FILE, "delivered", "rescued")
    # written first: an inventory in one plan with the reading of the payloads would read each of them many times
    now = file_fields(fields(cut(table.select(*FILE, "delivered", "rescued"))), alias_classes(aliases))
    order = Window.partitionBy("feed_id").orderBy("file_no", "file_id")  # as many rows as files
    files = now.select(*FILE).distinct().withColumn("next", F.lead("file_id").over(order)).withColumn("first", F.row_number().over(order) == 1)
    before = now.join(files.where("next is not null").select("feed_id", "file_id", "file_no", "next"), FILE).select(F.col("next").alias("file_id"), "class", F.col("name").alias("old"), F.col("kind").alias("old_kind"))
    after = now.join(files.where("not first").select(*FILE), FILE).select("file_id", "class", "name", "kind")
    both = after.join(before, ["file_id", "class"], "full")
    name, old = F.col("name"), F.col("old")

    def change(when: Column, field: Column, kind: str, former: Column) -> Column:
        return F.when(when, F.struct(field.alias("field_name"), F.lit(kind).alias("change_kind"), former.alias("old_name")))

    none = F.lit("")
    changes = F.filter(
        F.array(
            change(old.isNull(), name, "added", none),
            change(name.isNull(), old, "removed", none),
            change(name != old, name, "renamed", old),
            change(name.isNotNull() & (F.col("kind") != F.col("old_kind")), name, "type", none),
        ),
        lambda c: c.isNotNull(),
    )
    return both.select("file_id", F.explode(changes).alias("c")).select("file_id", "c.*").distinct()


def _entries(recs: DataFrame, classes: dict[str, str]) -> DataFrame:
    """recs with _e, the fields of v as (key, kind, value), and _c, their classes."""
    m = F.map_entries(F.expr("cast(v as map<string, variant>)"))
    e = recs.withColumn("_e", F.transform(m, lambda e: F.struct(e["key"].alias("key"), _kind(e["value"]).alias("kind"), e["value"].alias("value"))))
    return e.withColumn("_c", F.transform(F.transform("_e", lambda e: plain(e["key"])), lambda p: _class_of(p, classes)))


def _places(x: DataFrame, classes: dict[str, str]) -> DataFrame:
    """x with _at_NAME for each column: where the first entry of its class stands, from 1; 0 where there is none."""
    return x.withColumns({f"_at_{n}": F.coalesce(F.array_position("_c", F.lit(c)).cast("int"), F.lit(0)) for n, c in classes.items()})


def _first(name: str) -> Column:
    return F.get("_e", F.col(f"_at_{name}") - 1)


def _taken(took: dict[str, Column]) -> Column:
    """The places of the entries that went into columns: found once for each record, so that telling an entry is one look-up."""
    return F.array(*[F.when(t, F.col(f"_at_{name}")).otherwise(0) for name, t in took.items()])


def _cast(entry: Column, kind: str) -> Column:
    """The value as kind, or null; objects and arrays are no text."""
    got = F.try_variant_get(entry["value"], "$", kind)
    return F.when(~entry["kind"].isin("object", "array"), got) if kind == "string" else got


def _as_json(entries: Column) -> Column:
    key = lambda e: F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^.(.*).$", 1)
    pairs = F.transform(entries, lambda e: F.concat(key(e), F.lit(":"), F.to_json(e["value"])))
    return F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def ingest(raw: DataFrame, aliases: DataFrame, target: dict[str, str]) -> DataFrame:
    """One row per record: file, record_no, each target column with its type, rescued (JSON under the names as delivered, or null), delivered.

    rescued: fields of no target column, those that can't be cast, and second spellings of a field within one record.
    delivered: name and kind of the fields that went into target columns, and of those that are null.
    """
    classes = alias_classes(aliases)
    of = {name: classes.get(k, k) for name in target for k in ["".join(c for c in name.lower() if c.isalnum())]}
    x = _places(_entries(records(raw), classes), of)
    x = x.withColumns({name: _cast(_first(name), kind) for name, kind in target.items()})
    x = x.withColumn("_k", _taken({name: F.col(name).isNotNull() for name in target}))
    stays = lambda e, i: (e["kind"] != "null") & ~F.array_contains("_k", i + 1)
    taken = F.transform(F.filter("_e", lambda e, i: ~stays(e, i)), lambda e: F.struct(e["key"].alias("name"), e["kind"].alias("kind")))
    return x.select(*FILE, "record_no", *target, _as_json(F.filter("_e", stays)).alias("rescued"), taken.alias("delivered"))


def promote(table: DataFrame, aliases: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Approved fields move from rescued into typed columns; values that can't be cast stay rescued."""
    return _move(table, aliases, approved, _cast)


def replay(table: DataFrame, aliases: DataFrame, target: dict[str, str]) -> DataFrame:
    """Rescued values of target columns once more: an object counts as its value, an array of one element as that element."""

    def loose(entry: Column, kind: str) -> Column:
        value = entry["value"]
        one = F.when(F.size(F.try_variant_get(value, "$", "array<variant>")) == 1, F.try_variant_get(value, "$[0]", kind))
        return F.coalesce(_cast(entry, kind), F.try_variant_get(value, "$.value", kind), one)

    return _move(table, aliases, target, loose)


def _move(table: DataFrame, aliases: DataFrame, columns: dict[str, str], cast) -> DataFrame:
    classes = alias_classes(aliases)
    of = {name: classes.get(k, k) for name in columns for k in ["".join(c for c in name.lower() if c.isalnum())]}
    x = _entries(table.withColumn("v", F.try_parse_json("rescued")), classes).withColumn("_e", F.coalesce("_e", F.expr("cast(array() as array<struct<key: string, kind: string, value: variant>>)")))
    x = x.withColumn("_c", F.coalesce("_c", F.expr("cast(array() as array<string>)")))
    x = _places(x, of)
    new = {}
    for name, kind in columns.items():
        fresh = cast(_first(name), kind)
        new[name] = F.coalesce(F.col(name), fresh) if name in table.columns else fresh
        new[f"_took_{name}"] = fresh.isNotNull() & (F.col(name).isNull() if name in table.columns else F.lit(True))
    x = x.withColumns({k: v for k, v in new.items() if k.startswith("_took_")} | {f"_new_{k}": v for k, v in new.items() if not k.startswith("_took_")})
    x = x.withColumn("_k", _taken({name: F.col(f"_took_{name}") for name in columns}))
    rest = F.filter("_e", lambda e, i: ~F.array_contains("_k", i + 1))
    keep = [c for c in table.columns if c not in columns and c != "rescued"]
    return x.select(*keep, *[F.col(f"_new_{c}").alias(c) for c in columns], _as_json(rest).alias("rescued"))


def rescue_report(table: DataFrame) -> DataFrame:
    """Which fields of which feed are still rescued, and in how many records."""
    x = table.where(F.col("rescued").isNotNull()).select("feed_id", "file_id", F.explode(F.json_object_keys("rescued")).alias("name"))
    return x.groupBy("feed_id", "name").agg(F.count("*").alias("n_records"), F.countDistinct("file_id").alias("n_files"))
