"""Integrity report in one pass over each table.

Checks are declared per table; the planner turns each table's rows into small
records, all checks of all tables alike, and counts them together:

* a record under the table's primary key, with the outcome of its row rules;
* a record under each foreign key, with a bit for the edge (the parent's own
  key sets the lowest bit), the day it is dated and whatever is counted there.

All records meet in one aggregate by (kind, key, day), combined before the
shuffle, and references in one window per key over its distinct days: duplicate keys are
rows less groups, an orphan is a key whose bits lack the parent's, and running
sums along a user's days give open terms and what comes after the last cancel.
No table is read for one check alone, and a key that holds a third of all rows
is one record per day.  A table that refers by columns of its own key, and has
no dated records, is counted by key, and its keys by what they refer to, first:
where it is dealt by such a column that needs no shuffle, and records are made
per reference, not per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType

#: what may be counted per key and day
COUNTED = ("starts", "ends", "usage", "tickets", "reactivated", "reactivations")
RULES = 3


@dataclass(frozen=True)
class Checked:
    """A table and its checks.

    keys: primary key columns; refs: column -> parent table, whose primary key
    is that one column; rules: check name -> condition that every row must
    meet, at most three (a null outcome is a violation); rate: (check name,
    flag, target, tolerance); dated: extra records under the first reference,
    each (day, counted columns), with the day of the last cancel as ``cancel``.
    """

    name: str
    df: DataFrame
    keys: Sequence[str]
    refs: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, Column | str] = field(default_factory=dict)
    rate: tuple[str, str, float, float] | None = None
    dated: Sequence[Mapping[str, Column | str]] = ()


def _slots(df: DataFrame, names: Sequence[str]) -> tuple[Column, Column, Column]:
    """The key as (long, string, date); columns that have no slot left are written out as text."""
    found: dict[str, Column] = {}
    for n in names:
        kind = df.schema[n].dataType
        slot = "l" if isinstance(kind, IntegralType) else "d" if isinstance(kind, DateType) else "s"
        if slot in found or (slot == "s" and not isinstance(kind, StringType)):
            found = {"s": F.to_json(F.struct(*[F.col(x) for x in names]), {"ignoreNullFields": "false"})}
            break
        found[slot] = F.col(n)
    null = lambda t: F.lit(None).cast(t)
    return found.get("l", null("long")).cast("long"), found.get("s", null("string")), found.get("d", null("date"))


def _records(table: Checked, tables: Sequence[Checked], edges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The records of one table: one scan, some records per row."""
    df = table.df
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("date")

    def record(kind, key, day=None, n=zero, keys=zero, bits=0, cancel=none, rules=(), **counted):
        values = [F.lit(kind).alias("kind"), key[0].alias("kl"), key[1].alias("ks"), (key[2] if day is None else day).alias("kd")]
        values += [n.alias("n"), keys.alias("counted"), F.lit(bits).cast("long").alias("bits"), cancel.alias("cancel")]
        values += [(rules[i] if i < len(rules) else zero).alias(f"r{i}") for i in range(RULES)]
        as_count = lambda c: F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("long"), zero)
        values += [(as_count(counted[c]) if c in counted else zero).alias(c) for c in COUNTED]
        return F.struct(*values)

    rules = [F.expr(r) if isinstance(r, str) else r for r in table.rules.values()]
    failed = [(~F.coalesce(r, F.lit(False))).cast("long") for r in rules]
    if table.rate:
        failed.append(F.col(table.rate[1]).cast("long"))
    if len(failed) > RULES:
        raise ValueError(f"{table.name}: more than {RULES} rules")
    own = _slots(df, table.keys)
    if set(table.refs) <= set(table.keys) and table.refs and not table.dated:
        sums = [F.sum(f).alias(f"_r{i}") for i, f in enumerate(failed)]
        by_key = df.groupBy(*table.keys).agg(F.count(F.lit(1)).alias("_n"), *sums)
        df = by_key.groupBy(*table.refs).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_keys"), *[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(len(failed))])
        no_key = (F.lit(None).cast("long"), F.lit(None).cast("string"), none)
        found = [F.coalesce(F.col(f"_r{i}"), zero) for i in range(len(failed))]
        records = [record(f"pk:{table.name}", no_key, n=F.col("_n"), keys=F.col("_keys"), rules=found)]
    else:
        records = [record(f"pk:{table.name}", own, n=F.lit(1).cast("long"), rules=failed)]
    if any(parent == table.name for _, _, parent in edges):
        records.append(record(f"fk:{table.name}", own, bits=1))
    for column, parent in table.refs.items():
        bit = 1 << 1 + [e for e in edges if e[2] == parent].index((table.name, column, parent))
        key = _slots(df, [column])
        plain = record(f"fk:{parent}", key, bits=bit)
        dated = []
        if parent == next(iter(table.refs.values())):
            for counted in table.dated:
                counted = {k: F.expr(c) if isinstance(c, str) else c for k, c in counted.items()}
                dated.append(record(f"fk:{parent}", key, day=counted.pop("day").cast("date"), bits=bit, cancel=counted.pop("cancel", none), **counted))
        # the first dated record stands for the reference as well
        records += [F.when(F.col(column).isNotNull(), r) for r in (dated or [plain])]
    # a missing record is a row of nulls; a filter of the array would not be compiled
    return df.select(F.inline(F.array(*records))).where("kind IS NOT NULL")


def integrity_report(tables: Sequence[Checked], max_reactivations: int = 1, users: str = "users") -> DataFrame:
    """Q11: (check_name, bad, total, ok), a line per check of ``tables``.

    Lines: each foreign key edge (distinct keys without a parent row, of all
    distinct ones; null keys refer to nothing), each primary key (rows beyond
    the first of their key, of all), each rule (rows that break it, of all),
    each rate (bad 1 where it is off its target), and, of what ``dated``
    records count per user and day: usage after the last cancel of users
    without a reactivation, tickets outside all terms (both days inclusive),
    reactivated touches against reactivation terms, and users beyond
    ``max_reactivations``.
    """
    edges = [(t.name, column, parent) for t in tables for column, parent in t.refs.items()]
    records = None
    for t in tables:
        r = _records(t, tables, edges)
        records = r if records is None else records.unionByName(r)
    sums = ["n", "counted", *[f"r{i}" for i in range(RULES)], *COUNTED]
    groups = records.groupBy("kind", "kl", "ks", "kd").agg(*[F.sum(c).alias(c) for c in sums], F.bit_or("bits").alias("bits"), F.max("cancel").alias("cancel"))
    # primary keys are only counted: their groups become one row per table before anything is sorted
    is_ref = F.col("kind").startswith("fk:")
    groups = groups.groupBy("kind", *[F.when(is_ref, F.col(c)).alias(c) for c in ("kl", "ks", "kd")]).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum(F.when(F.col("counted") > 0, F.col("counted")).otherwise(1)).alias("keys"), F.bit_or("bits").alias("bits"), F.max("cancel").alias("cancel")
    )

    key = Window.partitionBy("kind", "kl", "ks")
    along = key.orderBy("kd")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    wide = groups.withColumns(
        {
            "first": (F.row_number().over(along) == 1).cast("long"),
            "all_bits": F.bit_or("bits").over(key),
            "last_cancel": F.max("cancel").over(key),
            "came_back": F.sum("reactivations").over(key) > 0,
            "all_reactivated": F.sum("reactivated").over(key),
            "open": F.coalesce(F.sum(F.col("starts") - F.col("ends")).over(before), F.lit(0)) + F.col("starts"),
        }
    )
    is_user = F.col("kind") == f"fk:{users}"
    left = is_user & F.col("last_cancel").isNotNull() & ~F.col("came_back")
    measures = {c: F.sum(c) for c in ("n", "keys", *[f"r{i}" for i in range(RULES)])}
    by_parent: dict[str, list[tuple[str, str, str]]] = {}
    for e in edges:
        by_parent.setdefault(e[2], []).append(e)
    for i in range(max(map(len, by_parent.values()), default=0)):
        held = (F.col("first") == 1) & (F.col("all_bits").bitwiseAND(F.lit(2 << i)) != 0)
        measures[f"child{i}"] = F.count_if(held)
        measures[f"orphan{i}"] = F.count_if(held & (F.col("all_bits").bitwiseAND(F.lit(1)) == 0))
    measures["after_cancel"] = F.sum(F.when(left & (F.col("kd") > F.col("last_cancel")), F.col("usage")).otherwise(0))
    measures["of_canceled"] = F.sum(F.when(left, F.col("usage")).otherwise(0))
    measures["outside"] = F.sum(F.when(is_user & (F.col("open") <= 0), F.col("tickets")).otherwise(0))
    measures["tickets"] = F.sum("tickets")
    measures["touch_returns"], measures["term_returns"] = F.sum("reactivated"), F.sum("reactivations")
    measures["over_cap"] = F.count_if((F.col("first") == 1) & (F.col("all_reactivated") > max_reactivations))
    measures["returned"] = F.count_if((F.col("first") == 1) & (F.col("all_reactivated") > 0))
    totals = wide.groupBy("kind").agg(*[c.alias(n) for n, c in measures.items()])

    def line(name, bad, total):
        return F.struct(F.lit(name).alias("check_name"), bad.cast("long").alias("bad"), total.cast("long").alias("total"))

    lines: dict[str, list[Column]] = {}
    for parent, own in by_parent.items():
        keys = next(t.keys for t in tables if t.name == parent)
        lines[f"fk:{parent}"] = [line(f"fk {t}.{c} -> {parent}.{keys[0]}", F.col(f"orphan{i}"), F.col(f"child{i}")) for i, (t, c, _) in enumerate(own)]
    for t in tables:
        own = [line(f"pk {t.name}({', '.join(t.keys)})", F.col("n") - F.col("keys"), F.col("n"))]
        own += [line(name, F.col(f"r{i}"), F.col("n")) for i, name in enumerate(t.rules)]
        if t.rate:
            name, _, target, tolerance = t.rate
            rate = F.try_divide(F.col(f"r{len(t.rules)}").cast("double"), F.col("n"))
            own.append(line(name, F.coalesce(F.abs(rate - target) > tolerance, F.lit(False)), F.col("n")))
        lines[f"pk:{t.name}"] = own
    if any(t.dated for t in tables):
        lines[f"fk:{users}"] = lines.get(f"fk:{users}", []) + [
            line("usage after the last cancel", F.col("after_cancel"), F.col("of_canceled")),
            line("tickets inside a term", F.col("outside"), F.col("tickets")),
            line("reactivated touches = reactivation terms", F.abs(F.col("touch_returns") - F.col("term_returns")), F.col("touch_returns")),
            line(f"reactivations per user <= {max_reactivations}", F.col("over_cap"), F.col("returned")),
        ]
    picked = F.coalesce(*[F.when(F.col("kind") == k, F.array(*own)) for k, own in lines.items()])
    return totals.select(F.inline(picked)).withColumn("ok", F.col("bad") == 0)
