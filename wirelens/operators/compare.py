"""Before/after comparison, gate rules, and the client allow-list."""

from __future__ import annotations

import ipaddress
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .analytics import drop_tx_control, template_metrics

_COMPARED = ["count", "total_duration_ms", "avg_duration_ms", "error_count", "slow_count", "n_plus_1_count"]


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Template figures of two runs side by side, with the change of each."""
    def side(events: DataFrame, suffix: str) -> DataFrame:
        rows = template_metrics(drop_tx_control(events), distinct=False)
        return rows.select(F.col("normalized_query").alias("query"), *[F.col(c).alias(f"{c}_{suffix}") for c in _COMPARED])

    joined = side(before, "before").join(side(after, "after"), "query", "full")
    filled = joined.withColumns({
        f"{c}_{s}": F.coalesce(f"{c}_{s}", F.lit(0)) for c in _COMPARED for s in ("before", "after")})
    return filled.withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in _COMPARED})


def violations(before: DataFrame, after: DataFrame, max_growth: float = 0.0, forbidden: Column | None = None) -> DataFrame:
    """Rows that should fail a run: new N+1 or slow statements, growth, forbidden text."""
    rows = compare_runs(before, after)
    grown = (F.col("count_before") > 0) & (F.col("count_after") > F.col("count_before") * (1 + max_growth))
    rules = [
        F.when(F.col("n_plus_1_count_after") > 0, "n_plus_1"), F.when(F.col("slow_count_after") > 0, "slow"),
        F.when(grown, "count_growth"),
    ]
    if forbidden is not None:
        rules.append(F.when(forbidden & (F.col("count_after") > 0), "forbidden"))
    return rows.select(
        "query", "count_before", "count_after", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def _ipv4(host: Column) -> Column:
    """Four decimal parts without leading zeros -> number; null otherwise."""
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    pattern = r"^" + r"\.".join([part] * 4) + r"$"
    numbers = [F.regexp_extract(host, pattern, i).try_cast("bigint") for i in range(1, 5)]
    return ((numbers[0] * 256 + numbers[1]) * 256 + numbers[2]) * 256 + numbers[3]


def _ipv6(host: Column) -> Column:
    """IPv6 text -> 32 hex digits; null otherwise. Fixed length, so text order is address order."""
    lower = F.lower(host)
    dotted = F.regexp_extract(lower, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 2)
    tail = F.lpad(F.hex(_ipv4(dotted)), 8, "0")
    plain = F.when(dotted == "", lower).otherwise(F.concat(
        F.regexp_extract(lower, r"^(.*:)(\d+\.\d+\.\d+\.\d+)$", 1), F.lower(F.left(tail, F.lit(4))), F.lit(":"),
        F.lower(F.right(tail, F.lit(4)))))
    halves = F.split(plain, "::", -1)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    left = groups(F.get(halves, F.lit(0)))
    right = groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.when((F.size(halves) == 1) & (F.size(left) == 8), left).when(
        (F.size(halves) == 2) & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), missing), right))
    valid = F.forall(full, lambda g: g.rlike(r"^[0-9a-f]{1,4}$"))
    return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def is_client_allowed(host: Column, cidrs: str) -> Column:
    """Is the address in one of the networks? An empty list allows all; bad addresses fail.

    The list is a setting, so its merged ranges become one predicate: no join,
    and the scan that reads the log evaluates it in place.
    """
    networks = [ipaddress.ip_network(entry.strip(), strict=False) for entry in cidrs.split(",") if entry.strip()]
    if not networks:
        return F.lit(True)
    address = F.substring_index(host, "%", 1)
    tests = []
    for network in ipaddress.collapse_addresses([n for n in networks if n.version == 4]):
        tests.append(_ipv4(address).between(int(network[0]), int(network[-1])))
    for network in ipaddress.collapse_addresses([n for n in networks if n.version == 6]):
        tests.append(_ipv6(address).between(f"{int(network[0]):032x}", f"{int(network[-1]):032x}"))
    return F.coalesce(reduce(operator.or_, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def allow_clients(log: DataFrame, cidrs: str, keep: bool = True, host: str = "client_host") -> DataFrame:
    allowed = is_client_allowed(F.col(host), cidrs)
    return log.where(allowed if keep else ~allowed)
