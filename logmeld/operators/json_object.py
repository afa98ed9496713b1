"""JSON object lines: members, flattening and vendor rules.

Members are typed as variants, so a nested object is told apart from a string that merely looks
like one, and each value is rendered only when it is used.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmeld import vocab
from logmeld.functions.entries import entry, last_wins, no_entries
from logmeld.operators.detect import json_document


def _as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """Plain text for scalars, JSON text for lists and objects, null for JSON null."""
    return v.cast("string")


def error(document: Column) -> Column:
    return F.when(document.isNull(), F.lit("ValueError: Parsed JSON is not a key-value object"))


def member_entries(document: Column) -> Column:
    """Top-level members as entries; nested objects have no value of their own."""
    flat = F.filter(F.map_entries(document), lambda e: _as_object(e["value"]).isNull())
    return F.transform(flat, lambda e: entry(e["key"], _text(e["value"])))


def flat_entries(document: Column, text: Column, depth: int | None = None) -> Column:
    """Members with dotted keys: ``a.b`` for objects, ``a`` and ``a.0`` for lists, however deep.

    ``text``: the document's JSON text. Its opening brackets bound the levels that a row goes through. With ``depth`` objects
    further down stay whole, as JSON text under their own key.
    """
    item = lambda key, value, final: F.struct(
        key.alias("key"), value.alias("value"), final.alias("final")
    )
    dotted = lambda a, b: F.concat(a, F.lit("."), b)

    def expand(e):
        members = F.transform(
            F.map_entries(_as_object(e["value"])),
            lambda m: item(dotted(e["key"], m["key"]), m["value"], F.lit(False)),
        )
        # A list inside a list is kept whole.
        elements = F.transform(
            _as_list(e["value"]),
            lambda x, i: item(dotted(e["key"], i.cast("string")), x, _as_list(x).isNotNull()),
        )
        whole = item(e["key"], e["value"], F.lit(True))
        return (
            F.when(e["final"], F.array(whole))
            .when(_as_object(e["value"]).isNotNull(), members)
            .when(_as_list(e["value"]).isNotNull(), F.concat(F.array(whole), elements))
            .otherwise(F.array(whole))
        )

    level = F.transform(
        F.map_entries(document), lambda m: item(m["key"], m["value"], F.lit(False))
    )
    if depth is not None:
        for _ in range(depth):
            level = F.flatten(F.transform(level, expand))
    else:
        open_ = F.lit(0)
        for bracket in "{[":
            open_ = open_ + F.length(text) - F.length(F.replace(text, F.lit(bracket), F.lit("")))
        rounds = F.sequence(F.lit(1), F.greatest(open_, F.lit(1)))
        more = lambda level: F.exists(level, lambda e: ~e["final"] & (
            _as_object(e["value"]).isNotNull() | _as_list(e["value"]).isNotNull()))
        level = F.aggregate(rounds, level, lambda now, _: F.when(more(now), F.flatten(F.transform(now, expand))).otherwise(now))
    return F.transform(level, lambda e: entry(e["key"], _text(e["value"])))


# ---- vendor rules -----------------------------------------------------------------------

def _path(document: Column, top: str, path: str) -> Column:
    return F.try_variant_get(document[top], path, "string")


def is_suricata(document: Column) -> Column:
    return F.map_contains_key(document, "event_type") | F.map_contains_key(document, "alert")


def _origin(document: Column) -> Column:
    return F.coalesce(_path(document, "id", "$.orig_h"), _text(document["id.orig_h"]))


def is_zeek(document: Column) -> Column:
    return F.map_contains_key(document, "uid") & _origin(document).isNotNull()


def _present(*pairs: Column) -> Column:
    return F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())


def suricata_entries(document: Column) -> Column:
    return _present(
        entry("event_name", _path(document, "alert", "$.signature")),
        entry("category", _path(document, "alert", "$.category")),
        entry("severity", _path(document, "alert", "$.severity")),
    )


def zeek_entries(document: Column) -> Column:
    either = lambda key: F.coalesce(
        _path(document, "id", f"$.{key}"), _text(document[f"id.{key}"])
    )
    return _present(
        entry("src_ip", either("orig_h")),
        entry("dst_ip", either("resp_h")),
        entry("sport", either("orig_p")),
        entry("dport", either("resp_p")),
        entry("protocol", _text(document["proto"])),
    )


def vendor_entries(document: Column) -> Column:
    """Fields a recognised vendor's layout adds; they override same-named members."""
    return (
        F.when(is_suricata(document), suricata_entries(document))
        .when(is_zeek(document), zeek_entries(document))
        .otherwise(no_entries())
    )


def _signature_hit(lower: Column, keywords: list[str]) -> Column:
    hits = reduce(lambda a, b: a + b, [lower.contains(k).cast("int") for k in keywords])
    return hits >= min(2, len(keywords))


def _by_signature(lower: Column, at: int) -> Column:
    chain = F.lit(None).cast("string")
    for keywords, *labels in reversed(vocab.JSON_VENDOR_SIGNATURES):
        chain = F.when(_signature_hit(lower, keywords), F.lit(labels[at])).otherwise(chain)
    return chain


def keyword_vendor(lower: Column) -> Column:
    return _by_signature(lower, 0)


def keyword_device(lower: Column) -> Column:
    return _by_signature(lower, 1)


def fallback_device(document: Column) -> Column:
    # A nested object has no key of its own once flattened.
    flat = F.transform(
        F.filter(F.map_entries(document), lambda e: _as_object(e["value"]).isNull()),
        lambda e: F.lower(e["key"]),
    )
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return F.when(F.arrays_overlap(flat, words("firewall", "fw_action", "rule_name")), "firewall").when(
        F.arrays_overlap(flat, words("vpn", "tunnel")), "vpn"
    )


def vendor(document: Column, lower: Column) -> Column:
    return (
        F.when(is_suricata(document), "Suricata")
        .when(is_zeek(document), "Zeek")
        .otherwise(keyword_vendor(lower))
    )


def device_type(document: Column, lower: Column) -> Column:
    return F.when(is_suricata(document) | is_zeek(document), "ids").otherwise(
        F.coalesce(keyword_device(lower), fallback_device(document))
    )


def fields(document: Column, text: Column | None = None) -> Column:
    """Top-level members plus vendor fields: all that normalisation reads.

    With the document's ``text`` nested members come along under dotted keys.
    """
    members = member_entries(document) if text is None else flat_entries(document, text)
    return F.when(
        document.isNotNull(),
        last_wins(F.concat(members, vendor_entries(document))),
    )


# ---- operators --------------------------------------------------------------------------

def _with_document(df: DataFrame, col: str) -> DataFrame:
    return df if "document" in df.columns else df.withColumn("document", json_document(F.col(col)))


def parse_json(df: DataFrame, col: str = "line") -> DataFrame:
    """L -> L + fields (top-level members as text; nested values as JSON text) and error."""
    doc = F.col("document")
    members = F.map_from_entries(
        F.transform(F.map_entries(doc), lambda e: entry(e["key"], _text(e["value"])))
    )
    return _with_document(df, col).withColumns({"fields": members, "error": error(doc)}).drop("document")


def flatten_json(df: DataFrame, col: str = "line", depth: int | None = None) -> DataFrame:
    """L -> L + fields, every member under its dotted key."""
    return (
        _with_document(df, col)
        .withColumn("fields", last_wins(flat_entries(F.col("document"), F.col(col), depth)))
        .drop("document")
    )


def _with_vendor_fields(df: DataFrame, col: str, rule, extra, name: str) -> DataFrame:
    doc, f = F.col("document"), F.col("fields")
    staged = _with_document(df, col)
    hit = F.coalesce(rule(doc), F.lit(False))
    old = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return staged.withColumns({
        "fields": F.when(hit, last_wins(F.concat(F.map_entries(f), extra(doc)))).otherwise(f),
        "vendor": F.when(hit, F.lit(name)).otherwise(old("vendor")),
        "device_type": F.when(hit, F.lit("ids")).otherwise(old("device_type")),
    }).drop("document")


def suricata_fields(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F with Suricata's alert fields under their standard names."""
    return _with_vendor_fields(df, col, is_suricata, suricata_entries, "Suricata")


def zeek_fields(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F with Zeek's connection fields under their standard names."""
    return _with_vendor_fields(
        df, col, lambda d: ~is_suricata(d) & is_zeek(d), zeek_entries, "Zeek"
    )


def json_vendor(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F + vendor, device_type by keywords of the whole document."""
    lower = F.lower(F.col(col))
    return df.withColumns({"vendor": keyword_vendor(lower), "device_type": keyword_device(lower)})


def json_device_fallback(df: DataFrame, col: str = "line") -> DataFrame:
    """F -> F with a device type by member names where no vendor rule gave one."""
    return (
        _with_document(df, col)
        .withColumn("device_type", F.coalesce(F.col("device_type"), fallback_device(F.col("document"))))
        .drop("document")
    )
