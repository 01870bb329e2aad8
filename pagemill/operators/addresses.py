"""Host and address checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import REFUSED_IPV4, host_of, ip_kind, ipv4_to_long, is_private_address
from pagemill.options import MSG_NO_ADDRESS, MSG_PRIVATE_LITERAL, MSG_PRIVATE_RESOLVED, MSG_UNRESOLVED


def refused_ranges_df(spark) -> DataFrame:
    """The refused IPv4 ranges as a 7-row table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(REFUSED_IPV4, "cidr string, lo bigint, hi bigint")


def flag_private(addresses: DataFrame, ranges: DataFrame, n_col: str = "n") -> DataFrame:
    """Range join of IPv4 numbers against refused ranges (broadcast: 7 fixed rows)."""
    a = addresses.alias("a")
    r = F.broadcast(ranges.alias("r"))
    j = a.join(r, (F.col(f"a.{n_col}") >= F.col("r.lo")) & (F.col(f"a.{n_col}") <= F.col("r.hi")), "left")
    return j.select("a.*", F.col("r.cidr").alias("cidr"), F.col("r.cidr").isNotNull().alias("refused"))


def host_verdicts(hosts: DataFrame, dns: DataFrame, compat: bool = False) -> DataFrame:
    """C1 + D2: one verdict per host: NULL (public) or the refusal/resolution error text.

    IP-literal hosts are judged directly; names are left-joined to their DNS answers; a host is
    refused if ANY answer is private, naming the first offending answer (by ``seq``)."""
    h = hosts.select(F.col("host")).where(F.col("host").isNotNull()).distinct()
    kind = ip_kind(F.col("host"))
    lit = h.where(kind != 0).select(
        "host", F.when(is_private_address(F.col("host"), compat), F.format_string(MSG_PRIVATE_LITERAL.replace("{}", "%s"), F.col("host"))).alias("verdict"))
    names = h.where(kind == 0)
    ans = dns.select("host", "seq", "address")
    j = names.join(ans, "host", "left")
    priv = is_private_address(F.col("address"), compat)
    g = j.groupBy("host").agg(
        F.count("seq").alias("n_rows"),
        F.count(F.when(F.col("address").isNotNull() & (F.col("address") != ""), 1)).alias("n_addr"),
        F.min_by("address", F.when(F.col("address").isNotNull() & priv, F.col("seq"))).alias("bad"),
    )
    verdict = (
        F.when(F.col("n_rows") == 0, F.format_string(MSG_UNRESOLVED.replace("{}", "%s"), F.col("host")))
        .when(F.col("n_addr") == 0, F.format_string(MSG_NO_ADDRESS.replace("{}", "%s"), F.col("host")))
        .when(F.col("bad").isNotNull(), F.format_string(MSG_PRIVATE_RESOLVED.replace("{}", "%s"), F.col("host"), F.col("bad")))
    )
    return lit.unionByName(g.select("host", verdict.alias("verdict")))


__all__ = ["refused_ranges_df", "flag_private", "host_verdicts", "host_of", "ipv4_to_long"]
