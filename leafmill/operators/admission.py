"""URL admission, public-address classification and the resource-request audit."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import (
    ALLOWED_RESOURCE_TYPES,
    LOCAL_SUFFIXES,
    SPECIAL_IPV4,
    SPECIAL_IPV6,
    WARN_RESOURCE_BLOCKED,
    WARN_RESOURCE_FAILED,
)
from ..functions.text import let
from ..functions.urls import PLAIN_URL, build_url, parse_url


def _hex_v4(address: Column) -> Column:
    """Eight hex digits of a dotted IPv4 address, NULL when malformed."""
    octets = F.transform(F.split(address, r"\."), lambda o: o.try_cast("int"))
    ok = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda o: o <= 255)
    return F.when(ok, F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), ""))


def _hex_v6(address: Column) -> Column:
    """32 hex digits of an IPv6 address, NULL when malformed."""
    plain = F.lower(address)
    dotted = F.regexp_extract(plain, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail = _hex_v4(dotted)
    text = F.when(
        dotted != "",
        F.concat(
            F.regexp_replace(plain, r"\d+\.\d+\.\d+\.\d+$", ""),
            F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4),
        ),
    ).otherwise(plain)

    def expand(t: Column) -> Column:
        def groups(part: Column) -> Column:
            return F.filter(F.split(part, ":"), lambda g: g != "")

        left, right = groups(F.substring_index(t, "::", 1)), groups(F.substring_index(t, "::", -1))
        middle = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        every = F.when(t.contains("::"), F.concat(left, middle, right)).otherwise(groups(t))
        ok = t.rlike(r"^[0-9a-f:]+$") & ~t.rlike(r":::|::.*::") & (F.size(every) == 8) & F.forall(
            every, lambda g: F.length(g) <= 4
        )
        return F.when(ok, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(plain.contains(":"), let(text, expand))


def address_key(address: Column) -> Column:
    """Comparable form of an address; IPv4-mapped IPv6 counts as IPv4."""
    return let(
        _hex_v6(address),
        lambda six: F.coalesce(
            F.when(six.startswith("00000000000000000000ffff"), F.concat(F.lit("4:"), F.substring(six, 25, 8))),
            F.concat(F.lit("6:"), six),
            F.concat(F.lit("4:"), _hex_v4(address)),
        ),
    )


def _ranges() -> list[tuple[str, str]]:
    out = []
    for cidr in SPECIAL_IPV4 + SPECIAL_IPV6:
        net = ipaddress.ip_network(cidr)
        width = 8 if net.version == 4 else 32
        out.append(
            tuple(f"{net.version}:{int(a):0{width}x}" for a in (net.network_address, net.broadcast_address))
        )
    return out


def is_public(address: Column) -> Column:
    """True for plain unicast addresses; malformed ones are not public.

    The special blocks are a short fixed list, so the range test is one expression, not a join.
    """
    return let(
        address_key(address),
        lambda k: k.isNotNull() & ~reduce(lambda a, b: a | b, [k.between(lo, hi) for lo, hi in _ranges()]),
    )


def classify_addresses(resolved: DataFrame, host: str = "host", address: str = "address") -> DataFrame:
    """One row per host: it is public only if all of its addresses are."""
    return resolved.groupBy(host).agg(
        F.count(F.lit(1)).alias("addresses"),
        F.coalesce(F.every(is_public(F.col(address))), F.lit(False)).alias("public"),
    )


def _verdict(url: Column) -> Column:
    """STRUCT(url_norm, reject_reason)."""

    def judged(x: Column) -> Column:
        url, p = x["url"], x["parts"]
        host = F.regexp_replace(p["host"], r"^\[|\]$", "")
        literal = p["host"].startswith("[") | host.rlike(r"^\d+(\.\d+){3}$")
        reason = (
            F.when(url.isNull() | ~url.rlike(r"^[\x00-\x20]*[a-zA-Z][a-zA-Z0-9+.\-]*:"), "not an absolute URL")
            .when(~url.rlike(r"(?i)^[\x00-\x20]*https?:"), "scheme")
            .when(p.isNull(), "not an absolute URL")
            .when((p["user"] != "") | (p["password"] != ""), "credentials")
            .when((p["port"] != "") & ~p["port"].isin("80", "443"), "port")
            .when(~host.contains(".") & ~host.contains(":"), "not a public host name")
            .when(reduce(lambda a, b: a | b, [host.endswith(s) for s in LOCAL_SUFFIXES]), "local host name")
            .when(literal & ~is_public(host), "address not public")
        )
        return let(
            reason,
            lambda r: F.struct(
                F.when(r.isNull(), build_url(p, fragment=False)).alias("url_norm"), r.alias("reject_reason")
            ),
        )

    def plain(u: Column) -> Column:
        # a host of letters with a point in it, no login and no port: only local names are left to reject
        host = F.substring_index(F.substring_index(u, "/", 3), "/", -1)
        return u.rlike(PLAIN_URL) & host.contains(".") & ~reduce(lambda a, b: a | b, [host.endswith(s) for s in LOCAL_SUFFIXES])

    admitted = lambda u: F.struct(F.substring_index(u, "#", 1).alias("url_norm"), F.lit(None).cast("string").alias("reject_reason"))
    return let(url, lambda u: F.when(plain(u), admitted(u)).otherwise(let(F.struct(u.alias("url"), parse_url(u).alias("parts")), judged)))


def admit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``url_norm`` (fragment dropped) and ``reject_reason``; exactly one of them is set."""
    return df.withColumn("_v", _verdict(F.col(url))).select(
        *df.columns, F.col("_v.url_norm").alias("url_norm"), F.col("_v.reject_reason").alias("reject_reason")
    )


def admitted_url(url: Column) -> Column:
    """Normalised URL, or NULL when it is not admitted."""
    return _verdict(url)["url_norm"]


def audit_resources(
    requests: DataFrame,
    page: str = "page_id",
    *,
    max_requests: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Per page: requested, served, blocked, failed and the two warnings.

    ``requests`` has (page, seq, url, method, resource_type, navigation, status, bytes). Where
    ``max_requests`` is given, only so many permitted requests of a page can be served; that ranking is cut
    on the map side, so a page with very many requests is never gathered in one task. Where ``max_bytes`` is
    given, requests beyond it fail. Without limits a page's requests are only counted.
    """
    log = requests.withColumn(
        "_allowed",
        admitted_url(F.col("url")).isNotNull()
        & (F.col("method") == "GET")
        & F.col("resource_type").isin(ALLOWED_RESOURCE_TYPES),
    )
    totals = log.groupBy(page).agg(
        F.count(F.lit(1)).alias("requested"),
        F.min(F.when(F.col("_allowed") & F.col("navigation"), F.col("seq"))).alias("_first_navigation"),
    )
    # Of the navigations only the first one is served.
    first = totals.select(page, "_first_navigation")
    permitted = (
        log.filter("_allowed")
        .select(page, "seq", "navigation", "status", "bytes")
        .join(first, [page])
        .filter(~F.col("navigation") | (F.col("seq") == F.col("_first_navigation")))
    )
    order = W.partitionBy(page).orderBy("seq")
    kept, failed = permitted, ~F.col("status").between(200, 299)
    if max_requests is not None:
        kept = kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_requests)
    if max_bytes is not None:
        kept = kept.withColumn("_total", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
        failed = failed | (F.col("_total") > max_bytes)
    served = kept.groupBy(page).agg(F.count(F.lit(1)).alias("served"), F.count_if(failed).alias("failed"))
    served_n, failed_n = (F.coalesce(F.col(c), F.lit(0)) for c in ("served", "failed"))
    blocked_n = F.col("requested") - served_n
    return totals.join(served, [page], "left").select(
        page,
        "requested",
        served_n.alias("served"),
        blocked_n.alias("blocked"),
        failed_n.alias("failed"),
        F.when(failed_n > 0, F.format_string(WARN_RESOURCE_FAILED, failed_n)).alias("failed_warning"),
        F.when(blocked_n > 0, F.format_string(WARN_RESOURCE_BLOCKED, blocked_n)).alias("blocked_warning"),
    )
