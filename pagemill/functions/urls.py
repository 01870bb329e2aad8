"""URL and address expressions as Column expression chains.

Everything is JVM-side; host names that aren't ASCII go through ``java.net.IDN``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import sqltext as X
from pagemill.functions.dialect import SPARK
from pagemill.functions.steps import step
from pagemill.functions.text import js_trim

SPECIAL_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
SPECIAL_SCHEMES = ("http", "https", "ftp", "ws", "wss", "file")
FORBIDDEN_HOST = "[\\x00-\\x20#%/:<>?@\\[\\\\\\]^|\\x7f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_dot_segments(path: Column) -> Column:
    """WHATWG path normalisation of '.', '..' (and %2e forms); input starts with '/'."""
    segs = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    n = F.size(segs)
    indexed = F.transform(segs, lambda s, i: F.struct(F.lower(s).alias("s"), s.alias("raw"), (i == n - 1).alias("last")))

    def step(acc, x):
        is_dot = x["s"].isin(".", "%2e")
        is_dotdot = x["s"].isin("..", ".%2e", "%2e.", "%2e%2e")
        popped = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return (
            F.when(is_dotdot, F.when(x["last"], F.array_append(popped, F.lit(""))).otherwise(popped))
            .when(is_dot, F.when(x["last"], F.array_append(acc, F.lit(""))).otherwise(acc))
            .otherwise(F.array_append(acc, x["raw"]))
        )

    out = F.aggregate(indexed, F.array().cast("array<string>"), step)
    simple = ~path.rlike("(?i)(^|/)(\\.|%2e){1,2}(/|$)")
    return F.when(simple, path).otherwise(F.concat(F.lit("/"), F.array_join(out, "/")))


def _ipv4_part(p: Column) -> Column:
    """One IPv4 number part (decimal, 0x hex, leading-0 octal) -> bigint, NULL if invalid."""
    too_big = F.lit(1 << 40)  # any number of more digits is over 32 bits and so never valid

    def value(digits: Column, radix: int, most: int) -> Column:
        d = F.regexp_replace(digits, "^0+", "")
        return F.when(d == "", F.lit(0).cast("bigint")).when(F.length(d) > most, too_big).otherwise(F.conv(d, radix, 10).cast("bigint"))

    return (
        F.when(p.rlike("^0[xX][0-9a-fA-F]*$"), value(F.regexp_replace(p, "^0[xX]", ""), 16, 9))
        .when(p.rlike("^0[0-7]*$"), value(p, 8, 12))
        .when(p.rlike("^[1-9][0-9]*$"), value(p, 10, 11))
    )


def ipv4_number(host: Column) -> Column:
    """WHATWG IPv4 parser: 1-4 parts, last part fills the remaining bytes. NULL if invalid."""
    h = F.regexp_replace(host, "\\.$", "")
    parts = F.split(h, "\\.", -1)
    nums = F.transform(parts, _ipv4_part)
    n = F.size(parts)
    ok = (n <= 4) & F.forall(nums, lambda x: x.isNotNull()) & F.forall(
        F.slice(nums, 1, F.greatest(n - 1, F.lit(0))), lambda x: (x <= 255)
    )
    last = F.element_at(nums, -1)
    head = F.aggregate(
        F.transform(F.slice(nums, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: x * F.pow(F.lit(256), F.lit(3) - i).cast("bigint")),
        F.lit(0).cast("bigint"), lambda a, x: a + x,
    )
    limit = F.pow(F.lit(256), F.lit(5) - n).cast("bigint")
    ok = ok & (F.when(n == 1, last <= 4294967295).otherwise(last < limit))
    return F.when(ok, head + last)


def ends_in_number(host: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(host, "\\.$", ""), "\\.", -1), -1)
    return last.rlike("^[0-9]+$") | last.rlike("^0[xX][0-9a-fA-F]*$")


def long_to_ipv4(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])


# --- I5 -------------------------------------------------------------------
def ipv4_to_long(ip: Column) -> Column:
    """Strict dotted quad -> bigint; NULL when not exactly 4 decimal octets in 0..255."""
    parts = F.split(ip, "\\.", -1)
    octs = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int")))
    ok = (F.size(parts) == 4) & F.forall(octs, lambda x: x.isNotNull() & (x <= 255))
    val = F.aggregate(octs, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    return F.when(ok, val)


# --- B4 -------------------------------------------------------------------
IPV4_RE = "^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
IPV6_RE = "^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(:[0-9]{1,3}(\\.[0-9]{1,3}){3})?$"


def ipv6_groups(ip: Column) -> Column:
    """IPv6 text -> array of 8 ints, NULL when not a valid address."""
    s = F.lower(ip)
    v4 = F.regexp_extract(s, "^(.*:)([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$", 2)
    v4n = ipv4_to_long(v4)
    head = F.when(v4 != "", F.regexp_extract(s, "^(.*:)([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$", 1)).otherwise(s)
    head = F.when((v4 != "") & ~head.endswith("::"), F.regexp_replace(head, ":$", "")).otherwise(head)
    tail_groups = F.when(v4 != "", F.array((F.shiftright(v4n, 16) % 65536).cast("int"), (v4n % 65536).cast("int"))).otherwise(F.array().cast("array<int>"))
    dbl = F.instr(head, "::") > 0
    left = F.when(dbl, F.substring_index(head, "::", 1)).otherwise(head)
    right = F.when(dbl, F.substring_index(head, "::", -1)).otherwise(F.lit(""))

    def grp(x: Column) -> Column:
        return F.filter(F.split(x, ":", -1), lambda g: g != "")

    lg, rg = grp(left), grp(right)
    to_int = lambda arr: F.transform(arr, lambda g: F.when(g.rlike("^[0-9a-f]{1,4}$"), F.conv(g, 16, 10).cast("int")))
    li, ri = to_int(lg), to_int(rg)
    total = F.size(li) + F.size(ri) + F.size(tail_groups)
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(8) - total, F.lit(0)))
    full = F.when(dbl, F.concat(li, zeros, ri, tail_groups)).otherwise(F.concat(li, tail_groups))
    valid = (
        ip.rlike(IPV6_RE) & (F.size(full) == 8) & F.forall(full, lambda x: x.isNotNull())
        & ((dbl & (total < 8)) | (~dbl & (total == 8)))
        & ~F.regexp_replace(s, "::", "").contains(":::")
        & ((F.length(s) - F.length(F.regexp_replace(s, "::", ""))) <= 2)
        & (~s.startswith(":") | s.startswith("::")) & (~s.endswith(":") | s.endswith("::"))
        & ((v4 == "") | v4n.isNotNull())
    )
    return F.when(valid, full)


def ipv6_serialize(groups: Column) -> Column:
    """WHATWG IPv6 serializer: lowercase hex, longest run (>=2) of zero groups -> '::'."""
    hexes = F.transform(groups, lambda g: F.lower(F.conv(g.cast("string"), 10, 16)))
    # run length of zeros ending at i, computed by scanning
    runs = F.transform(
        groups,
        lambda g, i: F.when(
            g == 0,
            F.lit(1) + F.aggregate(
                F.reverse(F.slice(F.concat(groups, F.array(F.lit(1))), 1, i)),
                F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
                lambda a, x: F.when(a["go"] & (x == 0), F.struct((a["n"] + 1).alias("n"), F.lit(True).alias("go")))
                .otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("go"))),
            )["n"],
        ).otherwise(F.lit(0)),
    )
    best = F.array_max(runs)
    end_idx = F.array_position(runs, best)  # 1-based end of the first longest run
    start_idx = end_idx - best + 1
    compress = best >= 2
    left = F.array_join(F.slice(hexes, 1, F.greatest(start_idx - 1, F.lit(0))), ":")
    right = F.array_join(F.slice(hexes, F.least(end_idx + 1, F.lit(9)), F.greatest(F.lit(8) - end_idx, F.lit(0))), ":")
    return F.when(compress, F.concat(left, F.lit("::"), right)).otherwise(F.array_join(hexes, ":"))


def ip_kind(ip: Column) -> Column:
    """Node's isIP: 4, 6 or 0."""
    return F.when(ip.rlike(IPV4_RE), F.lit(4)).when(ip.rlike(IPV6_RE) & ~ip.contains(":::"), F.lit(6)).otherwise(F.lit(0))


# --- B5 -------------------------------------------------------------------
# Refused IPv4 ranges, inclusive bounds as 32-bit numbers.
REFUSED_IPV4 = [
    ("0.0.0.0/8", 0, 16777215),
    ("10.0.0.0/8", 167772160, 184549375),
    ("100.64.0.0/10", 1681915904, 1686110207),
    ("127.0.0.0/8", 2130706432, 2147483647),
    ("169.254.0.0/16", 2851995648, 2852061183),
    ("172.16.0.0/12", 2886729728, 2887778303),
    ("192.168.0.0/16", 3232235520, 3232301055),
]


def is_private_ipv4_number(n: Column) -> Column:
    cond = F.lit(False)
    for _, lo, hi in REFUSED_IPV4:
        cond = cond | n.between(lo, hi)
    return cond


def is_private_ipv4(ip) -> Column:
    """Malformed (not 4 parts each 0..255) -> True, like the reference."""
    ip = _c(ip)
    parts = F.split(ip, "\\.", -1)
    nums = F.transform(parts, lambda p: F.when(p.rlike("^\\s*[0-9]*\\s*$"), F.trim(p)))
    # JS Number(''): 0; Number(' 7 '): 7; anything else NaN
    vals = F.transform(nums, lambda p: F.when(p == "", F.lit(0).cast("bigint")).otherwise(p.try_cast("bigint")))
    ok = (F.size(parts) == 4) & F.forall(vals, lambda x: x.isNotNull() & (x >= 0) & (x <= 255))
    n = F.aggregate(vals, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    return F.when(~ok, F.lit(True)).otherwise(is_private_ipv4_number(n))


# --- B6 -------------------------------------------------------------------
def is_private_ipv6(ip, compat: bool = False) -> Column:
    """By number, whatever the spelling; ``compat``: by the text of the address (Q3)."""
    a = F.lower(_c(ip))
    if compat:
        mapped = F.regexp_extract(a, "^::ffff:([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$", 1)
        return (
            F.when(a.isin("::1", "::"), F.lit(True))
            .when(mapped != "", is_private_ipv4(mapped))
            .otherwise(a.startswith("fe80") | a.startswith("fc") | a.startswith("fd"))
        )

    def refused(g: Column) -> Column:
        at = lambda i: F.element_at(g, i)
        zeros = F.forall(F.slice(g, 1, 5), lambda x: x == 0)
        return (
            F.when(g.isNull(), F.lit(True))
            .when(zeros & (at(6) == 0) & (at(7) == 0) & (at(8) <= 1), F.lit(True))
            .when(zeros & (at(6) == 65535), is_private_ipv4_number(at(7).cast("bigint") * 65536 + at(8)))
            .otherwise(at(1).between(0xFE80, 0xFEBF) | at(1).between(0xFC00, 0xFDFF))
        )

    return F.element_at(F.transform(F.array(ipv6_groups(a)), refused), 1)  # the groups are computed once


# --- B7 -------------------------------------------------------------------
def is_private_address(ip, compat: bool = False) -> Column:
    ip = _c(ip)
    k = ip_kind(ip)
    return F.when(k == 4, is_private_ipv4(ip)).when(k == 6, is_private_ipv6(ip, compat)).otherwise(F.lit(True))


# --- B1/B2/B3 -------------------------------------------------------------
def normalise_urls(df: DataFrame, col: str = "raw_url", out: str = "nu") -> DataFrame:
    """B1 over a DataFrame: adds struct ``out`` = (href, protocol, host, port, path, valid).

    WHATWG-style parse + serialise of an absolute URL: trim, drop tab/newline, lower-case
    scheme and host, special-scheme slashes, percent-encoded hosts decoded, numeric IPv4 hosts canonicalised, IPv6 hosts
    serialised, empty credentials and default ports dropped, dot segments removed, path/query/fragment
    percent-encoded; href NULL when invalid. Every step's columns are computed once.
    """
    c = F.col
    d = step(df, _s=F.regexp_replace(F.regexp_replace(js_trim(c(col)), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", ""))
    d = step(d, _scheme=F.lower(F.regexp_extract(c("_s"), "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1)))
    rest = F.expr("substring(_s, length(_scheme) + 2)")
    special = c("_scheme").isin(*SPECIAL_SCHEMES)
    d = step(d, _special=special, _after=F.when(c("_scheme") == "file", F.regexp_replace(rest, "^[/\\\\]{2}", ""))
             .when(special, F.regexp_replace(rest, "^[/\\\\]*", "")).otherwise(rest))
    d = step(d, _auth=F.regexp_extract(c("_after"), "^([^/\\\\?#]*)", 1))
    d = step(d, _remainder=F.expr("substring(_after, length(_auth) + 1)"),
             _userinfo=F.regexp_replace(F.regexp_extract(c("_auth"), "^(.*)@", 1), ":$", ""),
             _hostport=F.regexp_replace(c("_auth"), "^.*@", ""))
    v6 = c("_hostport").startswith("[")
    d = step(d, _is_v6=v6,
             _port_raw=F.regexp_extract(c("_hostport"), "^(?:\\[[^\\]]*\\]|[^:\\[]*)(?::(.*))?$", 1),
             _host_raw=F.when(v6, F.regexp_extract(c("_hostport"), "^\\[([^\\]]*)\\](?::.*)?$", 1)).otherwise(F.regexp_extract(c("_hostport"), "^([^:]*)", 1)))
    decoded = F.when(F.instr(c("_host_raw"), "%") > 0, F.expr("try_url_decode(replace(_host_raw, '+', '%2B'))")).otherwise(c("_host_raw"))
    path = F.regexp_extract(c("_remainder"), "^([^?#]*)", 1)
    path = F.when(c("_special"), F.translate(path, "\\", "/")).otherwise(path)
    d = step(d, _host_l=F.lower(decoded), _g6=F.when(c("_is_v6"), ipv6_groups(c("_host_raw"))),
             _port_num=F.expr("try_cast(nullif(_port_raw, '') AS INT)"),
             _port_ok=(c("_port_raw") == "") | (c("_port_raw").rlike("^[0-9]+$") & F.coalesce(F.expr("try_cast(_port_raw AS INT)") <= 65535, F.lit(False))),
             _path0=F.when(path == "", F.lit("/")).when(c("_special") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path),
             _q=F.when(c("_remainder").rlike("^[^?#]*\\?"), F.regexp_extract(c("_remainder"), "^[^?#]*\\?([^#]*)", 1)),
             _frag=F.when(F.instr(c("_remainder"), "#") > 0, F.regexp_extract(c("_remainder"), "^[^#]*#(.*)$", 1)))
    d = step(d, _host_a=F.when(c("_host_l").rlike("[^\\x00-\\x7f]"), F.lower(F.expr("try_reflect('java.net.IDN', 'toASCII', _host_l)"))).otherwise(c("_host_l")),
             _path1=remove_dot_segments(c("_path0")), _v6s=ipv6_serialize(c("_g6")))
    d = step(d, _num=ends_in_number(c("_host_a")), _v4n=F.when(ends_in_number(c("_host_a")), ipv4_number(c("_host_a"))))
    default_port = F.create_map(*[x for k, v in SPECIAL_PORTS.items() for x in (F.lit(k), F.lit(v))])
    host_ok = F.when(c("_is_v6"), c("_v6s").isNotNull()).when(c("_host_a").isNull(), F.lit(False)) \
        .when(c("_num"), c("_v4n").isNotNull()).otherwise(((c("_host_a") != "") | (c("_scheme") == "file")) & ~c("_host_a").rlike(FORBIDDEN_HOST))
    d = step(d, _host=F.when(c("_is_v6"), F.concat(F.lit("["), c("_v6s"), F.lit("]"))).when(c("_num"), long_to_ipv4(c("_v4n"))).otherwise(c("_host_a")),
             _port=F.when(c("_port_num").isNotNull() & ~F.coalesce(c("_port_num") == F.try_element_at(default_port, c("_scheme")), F.lit(False)), c("_port_num").cast("string")),
             _path=F.expr(X.pct_encode(SPARK, "_path1", X.PATH_SAFE_CLASS)),
             _qe=F.expr(X.pct_encode(SPARK, "_q", X.QUERY_SAFE_CLASS)),
             _fe=F.expr(X.pct_encode(SPARK, "_frag", X.FRAGMENT_SAFE_CLASS)),
             _valid=(c("_scheme") != "") & (~c("_special") | (host_ok & c("_port_ok"))))
    part = lambda lead, x: F.coalesce(F.concat(F.lit(lead), x), F.lit(""))
    href = F.concat(c("_scheme"), F.lit("://"), F.when(c("_userinfo") != "", F.concat(c("_userinfo"), F.lit("@"))).otherwise(F.lit("")),
                    c("_host"), part(":", c("_port")), c("_path"), part("?", c("_qe")), part("#", c("_fe")))
    known = c("_valid") & c("_special")
    d = step(d, **{out: F.struct(
        F.when(known, href).alias("href"), F.when(c("_scheme") != "", F.concat(c("_scheme"), F.lit(":"))).alias("protocol"),
        F.when(known, c("_host")).alias("host"), c("_port").alias("port"), c("_path").alias("path"), c("_valid").alias("valid"))})
    return d.select(*[x for x in df.columns if x != out], out)


def url_dictionary(urls: DataFrame, col: str) -> DataFrame:
    """Each distinct raw URL parsed once: raw, href, protocol, host (IPv6 without brackets), kind (4, 6 or 0 for a
    name) and private (of an address; NULL for a name), as flat columns to join on ``raw``."""
    d = normalise_urls(urls.select(F.col(col).alias("raw")).where(F.col("raw").isNotNull()).distinct(), "raw", "u")
    d = d.select("raw", "u.href", "u.protocol", F.regexp_replace("u.host", "^\\[|\\]$", "").alias("host"), "u.valid")
    d = step(d, kind=F.when(F.col("host").isNotNull(), ip_kind(F.col("host"))))
    return step(d, private=F.when(F.col("kind") > 0, is_private_address("host")))


def host_of(url) -> Column:
    """Host name of an already-normalised URL with IPv6 brackets stripped."""
    h = F.regexp_extract(_c(url), "^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)", 1)
    return F.regexp_replace(h, "^\\[|\\]$", "")


# --- G8 -------------------------------------------------------------------
def resolve_url(base: str, ref: str) -> Column:
    """Column ``ref`` resolved against the absolute URL in column ``base`` (RFC 3986 forms used in HTML attributes)."""
    return F.expr(X.resolve_url(SPARK, base, f"btrim({ref}, {SPARK.s(X.JS_BLANKS)})"))
