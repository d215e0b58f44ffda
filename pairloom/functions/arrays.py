"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def front(items: Column, position: Column) -> Column:
    """The element at ``position`` (from 0) first, then the others in order."""
    return F.concat(F.array(F.get(items, position)), F.filter(items, lambda x, i: i != position))


def by_parity(items: Column, index: Column) -> Column:
    """The items for an even index, in reverse order for an odd one."""
    return F.when(index % 2 == 0, items).otherwise(F.reverse(items))


def parity_label(index: Column, even: str, odd: str) -> Column:
    return F.when(index % 2 == 0, even).otherwise(odd)


def occurs_once(items: Column, value: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == value)) == 1


def first_match(items: Column, test) -> Column:
    """The first element that passes, or null."""
    return F.try_element_at(F.filter(items, test), F.lit(1))


def ragged(items: Column, sizes: Column) -> Column:
    """Consecutive parts of an array with the given sizes."""
    ends = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b.cast("int")))
    return F.transform(sizes, lambda n, i: F.slice(items, ends[i] - n + 1, n))


def lookup(map_: Column, *keys: Column) -> Column:
    """The value of the first key that the map has."""
    return F.coalesce(*[F.try_element_at(map_, k) for k in keys])


def article_lookup(map_: Column, name: Column) -> Column:
    """The value of a name, else of the name with ``a``, else with ``an``."""
    return lookup(map_, name, F.concat(F.lit("a "), name), F.concat(F.lit("an "), name))


def regrouped(outputs: Column, batch: int, repeats: int, sequences: int) -> Column:
    """Flat outputs ordered by repeat, item, sequence as one array per item."""
    item = lambda i: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.slice(outputs, i * sequences + r * (batch * sequences) + 1, sequences)))
    return F.transform(F.sequence(F.lit(0), F.lit(batch - 1)), item)


def fixed_stride(items: Column, size: int) -> Column:
    """Consecutive parts of ``size`` elements, the last one with the rest."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def transposed(rows: Column) -> Column:
    """Rows and columns of a rectangular nested array exchanged; no rows give no rows."""
    width = F.size(F.get(rows, F.lit(0)))
    return F.when(F.size(rows) == 0, rows).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.transform(rows, lambda r: F.get(r, i))))


def inverted(map_: Column) -> Column:
    """Values to keys; of keys with the same value the last one counts."""
    entries = F.map_entries(map_)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def merged(old: Column, new: Column) -> Column:
    """Both maps' entries; the new one's value counts where both have a key."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
