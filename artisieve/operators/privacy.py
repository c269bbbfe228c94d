"""Identity protection and header rewriting as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artisieve.functions import text as X


def pseudonym(value: Column, key: bytes, length: int) -> Column:
    return F.substring(X.hmac_sha256(value, key), 1, length)


def lookup_token(purpose: str, value: Column, key: bytes) -> Column:
    """``h1:`` and the keyed hash of purpose and value: stable in every storage mode. Empty and null give ''."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit("h1:"), X.hmac_sha256(F.concat(F.lit(purpose + "\0"), value), key)))


def encrypt_token(value: Column, key: bytes, purpose: str) -> Column:
    """A reversible token bound to its purpose; each call draws a new IV."""
    sealed = F.aes_encrypt(value, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.lit(purpose))
    return F.concat(F.lit("v1:"), F.translate(F.rtrim(F.base64(sealed), F.lit("=")), "+/", "-_"))


def decrypt_token(token: Column, key: bytes, purpose: str) -> Column:
    """The value of a token; a wrong key or purpose is an error, not a null."""
    raw = F.unbase64(F.translate(F.substring(token, 4, 1 << 20), "-_", "+/"))
    return F.aes_decrypt(raw, F.lit(bytearray(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(purpose)).cast("string")


def protect(value: Column, mode: str, key: bytes, purpose: str) -> Column:
    """A stored identity: plain, a 32-digit pseudonym, or a reversible token; '' stays ''."""
    value = F.coalesce(value, F.lit(""))
    if mode == "plain":
        return value
    out = F.concat(F.lit("h1:"), pseudonym(value, key, 32)) if mode == "hmac" else encrypt_token(value, key, purpose)
    return F.when(value == "", "").otherwise(out)


def reveal(stored: Column, mode: Column, key: bytes, purpose: str) -> Column:
    """By each row's storage mode: tokens are opened, pseudonyms and plain values stay."""
    return F.when((mode == "encrypted") & (stored != ""), decrypt_token(stored, key, purpose)).otherwise(stored)


def redact(value: Column, mode: str, key: bytes = b"", purpose: str = "report") -> Column:
    value = F.coalesce(value, F.lit(""))
    if mode == "plain":
        return value
    short = F.concat(F.substring(value, 1, 1), F.lit("…"))
    long = F.concat(F.substring(value, 1, 3), F.lit("…"), F.substring(value, -2, 2))
    out = {"redacted": F.when(F.length(value) <= 5, short).otherwise(long), "hmac": F.concat(F.lit("h1:"), pseudonym(value, key, 24))}.get(mode)
    if out is None:
        out = encrypt_token(value, key, purpose) if mode == "encrypted" else F.lit("")
    return F.when(value == "", "").otherwise(out)


def set_header(headers: Column, name: str, value: Column) -> Column:
    """The map with a header set; a null value is a deletion mark."""
    return F.map_concat(F.map_filter(headers, lambda k, _: k != name), F.create_map(F.lit(name), value))


def delete_headers(headers: Column, names: list[str]) -> Column:
    low = [n.lower() for n in names]
    return F.transform_values(headers, lambda k, v: F.when(~F.lower(k).isin(*low), v) if low else v)


def keep_headers(headers: Column, names: list[str]) -> Column:
    low = [n.lower() for n in names]
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*low), v))


def mime_repair(value: Column) -> Column:
    """A header of invalid UTF-8 as a MIME word; a valid one as it is. ``value`` is binary."""
    return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise(F.concat(F.lit("=?UTF-8?B?"), F.base64(value), F.lit("?=")))


def injection_info(entries: Column) -> Column:
    """``identity; name="value"; ...`` from an array of (name, value), the first of which has an empty name."""
    quote = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.array_join(F.transform(F.filter(entries, lambda e: e["value"].isNotNull()), lambda e: F.when(e["name"] == "", e["value"]).otherwise(F.concat(e["name"], F.lit("="), quote(e["value"])))), "; ")


def rewrite(df: DataFrame, key: bytes, domain: str = "news.example.invalid", sender: str = "pseudonym", path: str = "not-for-mail", organization: str | None = None, posting_host: str = "hmac", posting_account: str = "hmac", delete: list[str] | None = None, keep: list[str] | None = None, add: dict[str, str] | None = None, tor: str = "yes") -> DataFrame:
    """Rewrites ``headers`` of (headers, client_ip, user, tor) rows; a deleted header is null.

    Sender: preserve, delete, replace (``user@domain``) or a pseudonym. Path: preserve, ``hmac`` or a literal, with
    ``tor-network!`` before it for such clients. Injection-Info: host and account plain, hmac or left out.
    """
    h = F.col("headers")
    user, ip = F.coalesce("user", F.lit("")), F.coalesce("client_ip", F.lit(""))
    is_tor = F.coalesce("tor", F.lit(False))
    if organization is not None:
        h = set_header(h, "Organization", F.lit(organization))
    if sender == "delete":
        h = set_header(h, "Sender", F.lit(None).cast("string"))
    elif sender == "replace":
        h = set_header(h, "Sender", F.concat(user, F.lit(f"@{domain}")))
    elif sender == "pseudonym":
        source = F.when(user == "", ip).otherwise(user)
        h = set_header(h, "Sender", F.concat(F.lit("pf-"), pseudonym(source, key, 24), F.lit(f"@{domain}")))
    protect_ = lambda v, mode: v if mode == "plain" else F.lit(None).cast("string") if mode == "delete" else pseudonym(v, key, 32)
    entry = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    blank = lambda v, x: F.when(v != "", x)
    h = set_header(h, "Injection-Info", injection_info(F.array(entry("", F.lit(domain)), entry("posting-host", blank(ip, protect_(ip, posting_host))), entry("posting-account", blank(user, protect_(user, posting_account))))))
    h = delete_headers(h, ["NNTP-Posting-Date", "NNTP-Posting-Host", *(delete or [])])
    if path != "preserve":
        new = F.concat(F.lit(".POSTED!"), pseudonym(ip, key, 16), F.lit("!not-for-mail")) if path == "hmac" else F.lit(path)
        h = set_header(h, "Path", F.concat(F.when(is_tor, "tor-network!").otherwise(""), new))
    if keep is not None:
        h = keep_headers(h, keep)
    mark = {"yes": F.lit("yes"), "ip": ip}.get(tor, encrypt_token(ip, key[:16].ljust(16, b"\0"), "tor"))
    h = F.when(is_tor, set_header(h, "X-TOR", mark)).otherwise(h)
    for name, value in (add or {}).items():
        h = set_header(h, name, F.lit(value))
    return df.withColumn("headers", h)
