"""URL columns: parse, normalise, resolve and rewrite, following browser URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_PATH_UNSAFE = r"[^!$-;=@-\]_a-z|~]"
_QUERY_UNSAFE = r"[^!$-&(-;=?-~]"
_FRAGMENT_UNSAFE = r"[^!#-;=?-_a-~]"
_HOST_BAD = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"
SPECIAL_PORTS = {"http": "80", "https": "443"}


def _escape(c: Column, unsafe: str) -> Column:
    """Percent-encodes the characters matched by ``unsafe`` as UTF-8."""
    safe = "[" + unsafe[2:]

    def piece(p: Column) -> Column:
        encoded = F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        return F.when(p.rlike("(?s)^" + unsafe), encoded).otherwise(p)

    def text(x: Column) -> Column:
        pieces = F.regexp_extract_all(x, F.lit(f"(?s){safe}+|{unsafe}"), 0)
        return F.when(x.rlike("(?s)" + unsafe), F.array_join(F.transform(pieces, piece), "")).otherwise(x)

    return let(c, text)


def _clean_path(path: Column) -> Column:
    """Removes dot segments."""
    return let(path, _fold_dots)


def _fold_dots(path: Column) -> Column:
    segments = F.split(F.regexp_replace(path, "(?i)%2e", "."), "/", -1)
    folded = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("last")),
        lambda acc, s: F.struct(
            F.when(s == "..", F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0))))
            .when(s == ".", acc["kept"])
            .otherwise(F.array_append(acc["kept"], s))
            .alias("kept"),
            s.alias("last"),
        ),
        lambda acc: F.concat(
            F.lit("/"),
            F.array_join(acc["kept"], "/"),
            F.when(acc["last"].isin(".", "..") & (F.size(acc["kept"]) > 0), F.lit("/")).otherwise(F.lit("")),
        ),
    )
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), folded).otherwise(path)


def _ipv4(host: Column) -> Column:
    """Dotted form of any IPv4 spelling (127.1, hex, octal, one number); NULL when out of range."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    numbers = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^0[xX][0-9a-fA-F]{0,12}$"),
                         F.coalesce(F.conv(F.nullif(F.substring(p, 3, 12), F.lit("")), 16, 10), F.lit("0")))
        .when(p.rlike(r"^0[0-7]{1,15}$"), F.conv(p, 8, 10))
        .when(p.rlike(r"^(0|[1-9]\d{0,14})$"), p)
        .try_cast("bigint"),
    )

    def dotted(v: Column) -> Column:
        n = F.size(v)
        last = F.get(v, n - 1)
        lead = F.slice(v, 1, n - 1)
        ok = (
            (n <= 4)
            & F.forall(v, lambda x: x.isNotNull())
            & F.forall(lead, lambda x: x <= 255)
            & (last < F.pow(F.lit(256), 5 - n))
        )
        value = last + F.aggregate(
            F.transform(lead, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )
        octets = F.transform(
            F.array(*[F.lit(s) for s in (24, 16, 8, 0)]),
            lambda s: F.call_function("shiftright", value, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string"),
        )
        return F.when(ok, F.array_join(octets, "."))

    return let(numbers, dotted)


def _host(raw: Column) -> Column:
    """Normalised host, NULL when it is not valid."""
    decoded = F.when(raw.rlike("%[0-9a-fA-F]{2}"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw)

    def checked(h: Column) -> Column:
        ascii_host = F.when(
            h.rlike(r"[^\x00-\x7f]"),
            F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), h),
        ).otherwise(h)
        return let(
            F.lower(ascii_host),
            lambda x: F.when(x.rlike(r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$"), x)
            .when((x == "") | x.isNull() | x.rlike(_HOST_BAD), F.lit(None))
            .when(x.rlike(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$"), _ipv4(x))
            .otherwise(x),
        )

    return let(decoded, checked)


def _trim_control(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


_WEB = r"(?is)^(https?):[/\\]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _web_parts(u: Column) -> Column:
    """Parts of an absolute http(s) URL; NULL when it is not one or not valid."""

    def part(i: int) -> Column:
        return F.regexp_extract(u, _WEB, i)

    def built(raw: Column) -> Column:
        at_host = F.regexp_replace(raw["authority"], r"^.*@", "")
        host_raw = F.regexp_replace(at_host, r":\d*$", "")
        port_raw = F.regexp_replace(F.regexp_extract(at_host, r":(\d*)$", 1), r"^0+(?=\d)", "")
        default = F.when(raw["scheme"] == "http", "80").otherwise("443")
        user = F.regexp_extract(raw["authority"], r"^(.*)@", 1)
        return F.struct(
            raw["scheme"].alias("scheme"),
            F.regexp_extract(user, r"^([^:]*)", 1).alias("user"),
            F.regexp_extract(user, r"^[^:]*:(.*)$", 1).alias("password"),
            _host(host_raw).alias("host"),
            F.when(port_raw == default, "").otherwise(port_raw).alias("port"),
            _escape(_clean_path(F.when(raw["path"] == "", "/").otherwise(raw["path"])), _PATH_UNSAFE).alias("path"),
            F.when(raw["query"] == "?", "").otherwise(_escape(raw["query"], _QUERY_UNSAFE)).alias("query"),
            F.when(raw["fragment"] == "#", "").otherwise(_escape(raw["fragment"], _FRAGMENT_UNSAFE)).alias("fragment"),
            # href keeps an empty "?" or "#"
            F.when(raw["query"] == "?", "?").otherwise("").alias("bare_query"),
            F.when(raw["fragment"] == "#", "#").otherwise("").alias("bare_fragment"),
        )

    raw = F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("authority"),
        F.replace(part(3), F.lit("\\"), F.lit("/")).alias("path"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )
    parts = let(raw, lambda r: built(r))
    return F.when(
        u.rlike(_WEB),
        let(parts, lambda p: F.when(
            p["host"].isNotNull() & ((F.length(p["port"]) < 5) | ((F.length(p["port"]) == 5) & (p["port"] <= "65535"))), p)),
    )


# URLs that are their own normal form: nothing in them is encoded, resolved, dropped or a number for a host.
_PLAIN_HOST = r"(?:[a-z0-9-]++\.)*+[a-z][a-z0-9-]*+"
_PLAIN_TAIL = r"(?:/(?!\.)[A-Za-z0-9_.~!$&'()*+,;=:@-]*+)++(?:\?[A-Za-z0-9/_.~!$&()*+,;=:@%-]++)?+(?:#[A-Za-z0-9/_.~!$&()*+,;=:@%-]++)?+\z"
PLAIN_URL = rf"^https?://{_PLAIN_HOST}{_PLAIN_TAIL}"


def _plain_parts(u: Column) -> Column:
    """What ``_web_parts`` gives for a ``PLAIN_URL``."""
    empty = F.lit("")
    return F.struct(
        F.substring_index(u, "://", 1).alias("scheme"),
        empty.alias("user"),
        empty.alias("password"),
        F.substring_index(F.substring_index(u, "/", 3), "/", -1).alias("host"),
        empty.alias("port"),
        F.regexp_extract(u, r"^https?://[^/]++([^?#]++)", 1).alias("path"),
        F.when(u.contains("?"), F.regexp_extract(u, r"\?[^#]++", 0)).otherwise(empty).alias("query"),
        F.when(u.contains("#"), F.regexp_extract(u, r"#.++", 0)).otherwise(empty).alias("fragment"),
        empty.alias("bare_query"),
        empty.alias("bare_fragment"),
    )


def percent_encode(c: Column) -> Column:
    """Percent-encodes blanks, controls and everything outside ASCII."""
    return _escape(c, r"[^!-~]")


def parse_url(c: Column) -> Column:
    """STRUCT(scheme, user, password, host, port, path, query, fragment, ..) or NULL."""
    return let(c, lambda u: F.when(u.rlike(PLAIN_URL), _plain_parts(u)).otherwise(let(_trim_control(u), _web_parts)))


def origin_of(p: Column) -> Column:
    """Origin text of a parsed URL."""
    return F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])))


def build_url(p: Column, *, query: Column | None = None, fragment: bool = True, user: bool = True) -> Column:
    """Text of a parsed URL, optionally with another query, or without fragment or user."""
    login = F.when((p["user"] == "") & (p["password"] == ""), "").otherwise(
        F.concat(p["user"], F.when(p["password"] == "", "").otherwise(F.concat(F.lit(":"), p["password"])), F.lit("@"))
    )
    return F.concat(
        p["scheme"], F.lit("://"),
        login if user else F.lit(""),
        p["host"],
        F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])),
        p["path"],
        F.concat(p["query"], p["bare_query"]) if query is None else query,
        F.concat(p["fragment"], p["bare_fragment"]) if fragment else F.lit(""),
    )


def normalize_url(c: Column) -> Column:
    return let(parse_url(c), build_url)


def resolve_parts(ref: Column, base: Column) -> Column:
    """Parts of ``ref`` resolved against the parsed URL ``base``; NULL unless valid http(s)."""

    def joined(x: Column) -> Column:
        t, b = x["ref"], x["base"]
        # "http:page" with a base of the same scheme is a relative reference
        t = F.when(
            t.rlike(r"(?i)^https?:(?![/\\])") & (F.lower(F.substring_index(t, ":", 1)) == b["scheme"]),
            F.regexp_replace(t, r"^[a-zA-Z]+:", ""),
        ).otherwise(t)
        return let(t, lambda r: _web_parts_of(r, b))

    return let(F.struct(_trim_control(ref).alias("ref"), base.alias("base")), joined)


def _web_parts_of(t: Column, base: Column) -> Column:
    root = origin_of(base)
    head = (
        F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), "")
        .when(t.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":")))
        .when(t.rlike(r"^[/\\]"), root)
        .when(t.startswith("?"), F.concat(root, base["path"]))
        .when((t == "") | t.startswith("#"), F.concat(root, base["path"], base["query"], base["bare_query"]))
        .otherwise(F.concat(root, F.regexp_replace(base["path"], r"[^/]*$", "")))
    )
    return let(F.concat(head, t), _web_parts)


def resolve_url(ref: Column, base: Column) -> Column:
    """``ref`` against the parsed ``base``: absolute http(s) URL, or NULL."""

    def resolved(x: Column) -> Column:
        ref, base = x["ref"], x["base"]
        rooted = F.when(ref.startswith("/") & ~ref.startswith("//"), F.concat(origin_of(base), ref))
        return let(F.coalesce(rooted, ref), lambda u: F.when(u.rlike(PLAIN_URL), u).otherwise(let(resolve_parts(ref, base), build_url)))

    return let(F.struct(ref.alias("ref"), base.alias("base")), resolved)


def is_other_scheme(ref: Column) -> Column:
    """True for references such as mailto: or javascript: that never become http(s) URLs."""
    return _trim_control(ref).rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.\-]*:")


def host_of(c: Column) -> Column:
    host = lambda u: F.substring_index(F.substring_index(u, "/", 3), "/", -1)
    return let(c, lambda u: F.when(u.rlike(PLAIN_URL), host(u)).otherwise(let(parse_url(u), lambda p: p["host"])))


def strip_query(c: Column) -> Column:
    """URL without its query; the fragment stays."""
    built = lambda u: F.coalesce(let(parse_url(u), lambda p: build_url(p, query=F.lit(""))), F.lit(""))
    return let(c, lambda u: F.when(u.rlike(PLAIN_URL), F.regexp_replace(u, r"\?[^#]++", "")).otherwise(built(u)))


def set_query_param(url: Column, name: Column, value: Column) -> Column:
    """Sets a query parameter: the first occurrence takes the value, further ones are dropped."""

    def rewritten(p: Column) -> Column:
        pairs = F.filter(F.split(F.substring(p["query"], 2, 1 << 30), "&"), lambda x: x != "")
        named = F.transform(
            pairs,
            lambda x, i: F.struct(
                F.try_url_decode(F.substring_index(x, "=", 1)).alias("key"),
                F.try_url_decode(F.when(x.contains("="), F.regexp_replace(x, r"^[^=]*=", "")).otherwise("")).alias("value"),
            ),
        )

        def emit(ps: Column) -> Column:
            keyed = F.transform(ps, lambda x, i: F.struct(x["key"].alias("key"), x["value"].alias("value"), i.alias("i")))
            first = F.array_min(F.transform(F.filter(keyed, lambda x: x["key"] == name), lambda x: x["i"]))
            kept = F.transform(
                F.filter(keyed, lambda x: (x["key"] != name) | (x["i"] == first)),
                lambda x: F.concat(
                    F.url_encode(x["key"]), F.lit("="),
                    F.url_encode(F.when(x["key"] == name, value).otherwise(x["value"])),
                ),
            )
            added = F.when(first.isNull(), F.array(F.concat(F.url_encode(name), F.lit("="), F.url_encode(value)))).otherwise(
                F.array().cast("array<string>"))
            return F.concat(F.lit("?"), F.array_join(F.concat(kept, added), "&"))

        return build_url(p, query=let(named, emit))

    return let(parse_url(url), rewritten)
