"""Key-value entries: ordered arrays of (key, value) that become one map per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmeld.functions.text import let

ENTRIES = "array<struct<key:string,value:string>>"


def entry(key, value: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(key.alias("key"), value.alias("value"))


def entries(named: dict[str, Column]) -> Column:
    """One array of entries; entries whose value is null are left out."""
    rows = F.array(*[entry(k, v.cast("string")) for k, v in named.items()])
    return F.filter(rows, lambda e: e["value"].isNotNull())


def no_entries() -> Column:
    return F.array().cast(ENTRIES)


def _last_of_each_key(e: Column) -> Column:
    # Sort by (key, position): the last row of each run of equal keys is the one to keep.
    ranked = F.array_sort(
        F.transform(e, lambda x, i: F.struct(x["key"].alias("key"), i.alias("pos"), x["value"].alias("value")))
    )
    return let(
        ranked,
        lambda t: F.transform(
            F.filter(
                t,
                lambda x, i: F.coalesce(F.try_element_at(t, i + 2)["key"] != x["key"], F.lit(True)),
            ),
            lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")),
        ),
    )


def last_wins(e: Column) -> Column:
    """Entries to a map; a repeated key keeps its last value.

    The session's map key policy is not relied on. Rows without repeated keys, nearly all of
    them, skip the sort.
    """

    def build(x):
        keys = F.transform(x, lambda p: p["key"])
        return F.when(
            F.size(F.array_distinct(keys)) == F.size(x), F.map_from_entries(x)
        ).otherwise(F.map_from_entries(_last_of_each_key(x)))

    return let(e, build)
