"""Column functions over headers, bodies, addresses and keys. All stay inside Spark's own expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+"


def split_groups(value: Column) -> Column:
    """A comma list as an array: trimmed, empty entries dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def normalize_email(value: Column) -> Column:
    """``<a@b>`` or else the first address-like token, lower-cased; empty where there is none."""
    value = F.coalesce(value, F.lit(""))
    angle, bare = F.regexp_extract(value, r"<\s*([^<>\s]+@[^<>\s]+)\s*>", 1), F.regexp_extract(value, f"({MAIL})", 1)
    return F.lower(F.when(angle != "", angle).otherwise(bare))


def header(headers: Column, name: str) -> Column:
    """A header by its exact name, else by the lower-case one."""
    return F.coalesce(headers[name], headers[name.lower()])


def glob_regex(patterns: list[str]) -> str:
    """Group globs (``*`` any run, ``?`` one character) as one anchored, case-insensitive pattern."""
    one = lambda p: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
    return "(?i)^(?:" + "|".join(map(one, patterns)) + ")$" if patterns else "^(?!)$"


def article_type(groups: Column, binary_globs: list[str], mode: str = "mixed") -> Column:
    """``text``, ``binary``, or ``mixed`` where only some of the groups match the binary globs."""
    if mode == "text":
        return F.lit("text")
    n = F.size(F.filter(groups, lambda g: g.rlike(glob_regex(binary_globs))))
    return F.when((n > 0) & (n == F.size(groups)), "binary").when(n == 0, "text").otherwise("mixed")


def digest_input(mode: str, subject: Column, body: Column, newsgroups: Column, sender: Column, followup: Column) -> Column:
    parts = {"body": [body], "simple": [subject, body], "complex": [subject, newsgroups, body]}.get(mode, [subject, newsgroups, sender, followup, body])
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def line_statistics(body: Column) -> Column:
    """Struct of the body's lines: count, quoted, empty, blank, longest. A null body is one empty line."""
    lines = F.split(F.coalesce(body, F.lit("")), r"\r?\n", -1)
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    return F.struct(
        F.size(lines).alias("lines"),
        count(r"^[>:|]").alias("quoted"),
        F.size(F.filter(lines, lambda x: x == "")).alias("empty"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s+$"))).alias("blank"),
        F.array_max(F.transform(lines, F.length)).alias("longest"),
    )


def header_size(headers: Column) -> Column:
    """Bytes of ``Name: value`` lines over all headers; null values are deletions."""
    return F.coalesce(F.aggregate(F.map_entries(headers), F.lit(0).cast("long"), lambda n, e: n + F.when(e["value"].isNull(), 0).otherwise(F.octet_length(e["key"]) + F.octet_length(e["value"]) + 3)), F.lit(0).cast("long"))


def urls(body: Column, most: int = 20) -> Column:
    """Distinct http(s) URLs in order, trailing punctuation dropped, the first ``most`` of them."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?i)\b(https?://[^\s<>\"'\]\[()]+)"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))), 1, most)


def url_host(url: Column) -> Column:
    """The host of a URL, lower-case, without user, brackets and port."""
    authority = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1), r"^.*@", "")
    return F.lower(F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(authority, r":\d*$", "")))


def is_public_user(user: Column, ids: list[str] | None = None, pattern: str | None = None) -> Column:
    user = F.coalesce(user, F.lit(""))
    public = (user == "") | user.isin(ids or [])
    return public | user.rlike("(?i)" + pattern) if pattern else public


def message_id_hash(message_id: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(message_id, F.lit("")), 256), 1, 24)


def size_code(kind: Column, component: str) -> Column:
    """The rejection code of a size: text 96-98, binary 99-101 (body, header, total), else 103."""
    n = {"body": 0, "header": 1, "total": 2}[component]
    return F.when(kind == "text", 96 + n).when(kind == "binary", 99 + n).otherwise(103)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number, null where it is none."""
    part = F.split(ip, "[.]")
    valid = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)([.](25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(valid, sum((part[i].cast("long") * (256 ** (3 - i)) for i in range(1, 4)), part[0].cast("long") * 256**3))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once: an expression that is used often would else be copied at each use, and
    copies of copies make plans that take longer to build than to run."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, null where it is none (embedded IPv4 tails are not read)."""
    side = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")

    def full(halves: Column) -> Column:
        left, right = side(halves[0]), F.coalesce(side(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
        return F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, F.concat(left, zeros, right))

    def digits(groups: Column) -> Column:
        valid = (F.size(groups) == 8) & F.forall(groups, lambda x: F.length(x) <= 4)
        return F.when(valid, F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), ""))

    shaped = ip.rlike(r"(?i)^[0-9a-f:]+$") & ip.contains(":")
    return F.when(shaped, bound(F.split(F.lower(ip), "::"), lambda h: bound(full(h), digits)))


def cut_digit(key: Column, bits: Column) -> tuple[Column, Column, Column]:
    """(whole, first, block): the whole hex digits of a prefix, the next digit with its other bits cleared, and how many digits
    share that."""
    whole, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    digit = F.conv(F.substring(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    block = F.pow(F.lit(2.0), F.lit(4) - rest).cast("int")
    return whole, digit - F.pmod(digit, block), block


def cidr_range(cidr: Column) -> Column:
    """Struct (family, lo, hi) of a network, addresses as sortable text; null where it is none. No prefix: one address."""
    base, prefix = F.split_part(cidr, F.lit("/"), F.lit(1)), F.split_part(cidr, F.lit("/"), F.lit(2))
    bits4, bits6 = F.when(prefix == "", 32).otherwise(prefix.cast("int")), F.when(prefix == "", 128).otherwise(prefix.cast("int"))
    span = F.pow(F.lit(2.0), F.lit(32) - bits4).cast("long")
    text4 = lambda n: F.lpad(F.hex(n), 8, "0")
    whole_range = lambda family, lo, hi: F.struct(F.lit(family).alias("family"), lo.alias("lo"), hi.alias("hi"))

    def range6(v6: Column) -> Column:
        whole, first, block = cut_digit(v6, bits6)
        tail = lambda n, fill: F.when(whole == 32, v6).otherwise(F.rpad(F.concat(F.substring(v6, F.lit(1), whole), F.lower(F.hex(n))), 32, fill))
        return F.when(v6.isNotNull() & bits6.between(0, 128), whole_range(6, tail(first, "0"), tail(first + block - 1, "f")))

    range4 = lambda v4: F.when(v4.isNotNull() & bits4.between(0, 32), bound(v4 - F.pmod(v4, span), lambda low: whole_range(4, text4(low), text4(low + span - 1))))
    return F.coalesce(bound(ipv4_number(base), range4), bound(ipv6_hex(base), range6))


def ip_key(ip: Column) -> Column:
    """Struct (family, key) of an address in the order of ``cidr_range``."""
    key = lambda family, value: F.struct(F.lit(family).alias("family"), value.alias("key"))
    four = bound(ipv4_number(ip), lambda v: F.when(v.isNotNull(), key(4, F.lpad(F.hex(v), 8, "0"))))
    return F.coalesce(four, bound(ipv6_hex(ip), lambda v: F.when(v.isNotNull(), key(6, v))))


def in_range(key: Column, network: Column) -> Column:
    """Whether an address key (``ip_key``) lies in a range (``cidr_range``); false where either is null."""
    return F.coalesce((key["family"] == network["family"]) & key["key"].between(network["lo"], network["hi"]), F.lit(False))


def key_prefix(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address key: whole hex digits, then the rest of one."""
    whole, first, _ = cut_digit(key, bits)
    return F.lower(F.concat(F.substring(key, F.lit(1), whole), F.when(F.pmod(bits, F.lit(4)) > 0, F.hex(first)).otherwise("")))


def cidr_prefix(cidr: Column) -> Column:
    """Struct (family, bits, prefix) of a network in terms of ``key_prefix``; null where it is none. No prefix: one address."""
    length = F.split_part(cidr, F.lit("/"), F.lit(2))

    def prefix(r: Column) -> Column:
        bits = F.when(length == "", F.when(r["family"] == 4, 32).otherwise(128)).otherwise(length.cast("int"))
        return F.when(r.isNotNull(), F.struct(r["family"].alias("family"), bits.alias("bits"), key_prefix(r["lo"], bits).alias("prefix")))

    return bound(cidr_range(cidr), prefix)


def reverse_ip(ip: Column) -> Column:
    """The list key of an address: IPv4 octets or IPv6 nibbles in reverse order, joined by dots."""
    v6 = ipv6_hex(ip)
    return F.when(ipv4_number(ip).isNotNull(), F.array_join(F.reverse(F.split(ip, "[.]")), ".")).when(v6.isNotNull(), F.array_join(F.split(F.reverse(v6), "(?<=.)(?=.)"), "."))


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hex, from two SHA-256 calls over constant pads."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.sha2(F.concat(pad(0x36), value.cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def expand_template(template: str, values: dict[str, Column]) -> Column:
    """``%X`` marks replaced in one pass; values may hold ``%``; unknown marks stay."""
    out, at = [], 0
    for m in re.finditer(r"%([A-Z])", template):
        if m[1] in values:
            out += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))
