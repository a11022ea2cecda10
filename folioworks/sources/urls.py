"""URL guard: only public http(s) addresses pass.

A host that is an address in any spelling (dotted, short, decimal, octal or
hexadecimal IPv4; IPv6 with or without `::`, with an IPv4 tail, or mapping an
IPv4 address) is turned into numbers, and whole networks are tested on those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reasons of the guard.
REFUSED = {name: f"Requests to {what} are not allowed" for name, what in {
    "localhost": "localhost",
    "10": "RFC1918 (10.0.0.0/8) addresses",
    "172.16": "RFC1918 (172.16.0.0/12) addresses",
    "192.168": "RFC1918 (192.168.0.0/16) addresses",
    "127": "loopback addresses (127.0.0.0/8)",
    "169.254": "link-local addresses (169.254.0.0/16)",
    "::1": "loopback (::1)",
    "fc00": "unique-local IPv6 (fc00::/7) addresses",
    "fe80": "link-local IPv6 (fe80::/10) addresses",
}.items()}
NO_SCHEME, NO_HOST = "URL is missing a scheme", "URL has no host"
BAD_SCHEME = ("Scheme '", "' is not allowed — only HTTP(S) URLs are accepted")

V4_NETWORKS = {"localhost": "0.0.0.0/8", "10": "10.0.0.0/8", "172.16": "172.16.0.0/12", "192.168": "192.168.0.0/16", "127": "127.0.0.0/8", "169.254": "169.254.0.0/16"}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once and named, so that the expression does not grow with its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_number(host: Column) -> Column:
    """The address that one to four numbers of any base stand for, null for anything else."""
    parts = F.split(host, r"\.")

    def number(p: Column) -> Column:
        hexed = F.coalesce(F.nullif(F.regexp_extract(p, "^0x([0-9a-f]*)$", 1), F.lit("")), F.lit("0"))
        value = F.when(p.startswith("0x"), F.conv(hexed, 16, 10)).when(p.rlike("^0[0-7]*$"), F.conv(p, 8, 10)).otherwise(F.conv(p, 10, 10))
        return value.cast("decimal(20,0)")

    def address(values: Column) -> Column:
        last, heads = F.element_at(values, -1), F.slice(values, F.lit(1), F.size(values) - 1)
        room = F.pow(F.lit(256.0), 5 - F.size(values)).cast("long")
        whole = F.aggregate(heads, F.lit(0).cast("long"), lambda a, v: a * 256 + v.cast("long"))
        return F.when(F.forall(heads, lambda v: v < 256) & (last < room), whole * room + last.cast("long"))

    numeric = host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+)){0,3}$")
    return F.when(numeric, _let(F.transform(parts, number), address))


def _v4_problem(address: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, network in V4_NETWORKS.items():
        base, bits = network.split("/")
        number = sum(int(b) << (24 - 8 * i) for i, b in enumerate(base.split(".")))
        size = 1 << (32 - int(bits))
        out = F.when(address.between(number, number + size - 1), REFUSED[name]).otherwise(out)
    return out


def ipv6_groups(inner: Column) -> Column:
    """The eight numbers of an IPv6 address without brackets, null for anything else."""
    ending = r"([0-9]+(?:\.[0-9]+){3})$"

    def without_tail(bare: Column) -> Column:
        half = lambda n: F.lower(F.hex(n))
        pair = lambda n: F.concat(half(F.shiftright(n, 16)), F.lit(":"), half(n.bitwiseAND(F.lit(0xFFFF))))
        spelled = F.concat(F.regexp_replace(bare, ending, ""), _let(ipv4_number(F.regexp_extract(bare, ending, 1)), pair))
        return F.when(bare.rlike(ending), spelled).otherwise(bare)

    def words(t: Column) -> Column:
        return F.filter(F.split(t, ":"), lambda w: w != "")

    def groups(bare: Column) -> Column:
        sides = F.split(bare, "::")
        filled = F.when(
            F.size(sides) == 2,
            _let(
                F.struct(words(F.get(sides, F.lit(0))).alias("l"), words(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("r")),
                lambda x: F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(x["l"]) - F.size(x["r"]), F.lit(0))), x["r"]),
            ),
        ).otherwise(words(bare))
        fine = bare.rlike("^[0-9a-f:]+$") & (F.size(sides) <= 2)
        numbers = lambda w: F.when((F.size(w) == 8) & F.forall(w, lambda x: F.char_length(x) <= 4), F.transform(w, lambda x: F.conv(x, 16, 10).cast("long")))
        return F.when(fine, _let(filled, numbers))

    return _let(_let(F.regexp_replace(inner, "%.*$", ""), without_tail), groups)


def _v6_problem(groups: Column) -> Column:
    first = F.get(groups, F.lit(0))
    zeros = lambda n: F.forall(F.slice(groups, 1, n), lambda g: g == 0)
    low = F.get(groups, F.lit(6)) * 65536 + F.get(groups, F.lit(7))
    mapped = zeros(5) & F.get(groups, F.lit(5)).isin(0, 0xFFFF)
    translated = (first == 0x64) & (F.get(groups, F.lit(1)) == 0xFF9B)
    return (
        F.when(zeros(7) & (F.get(groups, F.lit(7)) == 1), REFUSED["::1"])
        .when(zeros(8), REFUSED["localhost"])
        .when(first.bitwiseAND(F.lit(0xFE00)) == 0xFC00, REFUSED["fc00"])
        .when(first.bitwiseAND(F.lit(0xFFC0)) == 0xFE80, REFUSED["fe80"])
        .when(mapped | translated, _v4_problem(low))
    )


def url_problem(url: Column) -> Column:
    """Why a URL is refused, null when it may be fetched."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}([^/?#\\]*)", 1)

    def problem(bare: Column) -> Column:
        named = F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.$", "")
        host = F.when(bare.rlike(r"^\["), F.regexp_extract(bare, r"^(\[[^\]]*\])", 1)).otherwise(named)
        # an unbracketed IPv6 address has no port to cut off
        inner = F.when(bare.rlike(r"^\["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(bare)

        def by_host(host: Column) -> Column:
            local = host.isin("localhost", "127.0.0.1", "0.0.0.0", "[::1]", "::1") | host.endswith(".localhost")
            return (
                F.when(host == "", NO_HOST)
                .when(local, REFUSED["localhost"])
                .when(host.rlike(r"^\[|:"), _let(ipv6_groups(inner), _v6_problem))
                .otherwise(_let(ipv4_number(host), _v4_problem))
            )

        return _let(host, by_host)

    return (
        F.when(scheme == "", NO_SCHEME)
        .when(~scheme.isin("http", "https"), F.concat(F.lit(BAD_SCHEME[0]), scheme, F.lit(BAD_SCHEME[1])))
        .otherwise(_let(F.lower(F.regexp_replace(authority, r"^.*@", "")), problem))
    )
