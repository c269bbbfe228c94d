"""Reason codes: the dimension table that maps a numeric code to its symbol, category and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The message of each numeric code.
MESSAGES = {
    0: "Message successfully sent",
    1: "Control messages are forbidden",
    2: "Forbidden crosspost",
    3: "You cannot approve messages",
    4: "Invalid Distribution header",
    5: "Invalid Content-Type",
    6: "Too many groups in Newsgroups",
    7: "Too many groups in Followup-To",
    8: "Missing Followup-To header",
    9: "The body is too large",
    10: "Difference between crossposts and followups is too large",
    11: "Re: without References",
    12: "Line too long",
    13: "Too many quoted lines",
    14: "Too many blank lines",
    15: "Too many empty lines",
    16: "HTML content is forbidden",
    17: "Nonexistent group",
    18: "Nonexistent group in Followup-To",
    19: "Date is too far in the future",
    20: "Invalid Path",
    21: "A header is too long",
    22: "Mail headers are forbidden",
    23: "Headers are too large",
    24: "Invalid In-Reply-To",
    25: "Too many hierarchies",
    26: "Too many hierarchies in Followup-To",
    27: "Syntax error in badwords configuration",
    28: "Badword in Subject",
    29: "Badword in body",
    30: "Multipost",
    31: "Your IP has sent too many articles",
    32: "Your domain has sent too many articles",
    33: "Your userid has sent too many articles",
    34: "Banlist",
    35: "Syntax error in banlist configuration",
    36: "Database connection error",
    37: "Unable to load active file",
    38: "Unable to load badwords configuration",
    39: "Unable to load banlist configuration",
    40: "Unable to open persistent storage",
    41: "Unable to save article",
    42: "Unable to run innconfval",
    43: "Unable to load main configuration",
    44: "Unable to write audit event",
    45: "Database expiry error",
    46: "Database spool error",
    47: "Default action set to rejection",
    48: "Server closed for posting",
    49: "Excessive score in banlist",
    50: "TOR is forbidden",
    51: "Supersedes, Replaces and Cancel are forbidden",
    52: "UUEncoded binaries are forbidden",
    53: "Forged system header",
    54: "Permanently closed group",
    55: "Unable to load internal module",
    56: "Forbidden due to DNSBL listing",
    57: "Message too big",
    58: "Message too old",
    59: "Unable to read public suffix data",
    60: "Banned domain in body (SURBL)",
    61: "Banned domain in body (URIBL)",
    62: "yEnc contents are forbidden",
    63: "Message rejected by a custom rule",
    64: "Too many errors for your IP",
    65: "Too many errors for your domain",
    66: "Too many errors for your userid",
    67: "Too many errors for your IP in a short period",
    68: "Too many errors for your domain in a short period",
    69: "Too many errors for your userid in a short period",
    70: "Too many messages for your IP in a short period",
    71: "Too many messages for your domain in a short period",
    72: "Too many messages for your userid in a short period",
    73: "Too many bytes for your IP in a short period",
    74: "Too many bytes for your domain in a short period",
    75: "Too many bytes for your userid in a short period",
    76: "Too many bytes for your IP",
    77: "Too many bytes for your domain",
    78: "Too many bytes for your userid",
    79: "Too many newsgroups for your IP in a short period",
    80: "Too many newsgroups for your domain in a short period",
    81: "Too many newsgroups for your userid in a short period",
    82: "Too many newsgroups for your IP",
    83: "Too many newsgroups for your domain",
    84: "Too many newsgroups for your userid",
    85: "Too many followups for your IP in a short period",
    86: "Too many followups for your domain in a short period",
    87: "Too many followups for your userid in a short period",
    88: "Too many followups for your IP",
    89: "Too many followups for your domain",
    90: "Too many followups for your userid",
    91: "Article rejected by sender request",
    92: "Syntax error in main configuration",
    93: "Syntax error in access configuration",
    94: "Syntax error in rules configuration",
    95: "Crossposting between text and binary groups is forbidden",
    96: "Text article body exceeds the configured text limit",
    97: "Text article headers exceed the configured text limit",
    98: "Text article total size exceeds the configured text limit",
    99: "Binary article body exceeds the configured binary limit",
    100: "Binary article headers exceed the configured binary limit",
    101: "Binary article total size exceeds the configured binary limit",
    102: "Binary payload is forbidden by the selected article policy",
    103: "Unable to determine a valid article type policy",
    104: "Forbidden or invalid character in header",
    105: "Unable to load per-group user database",
    106: "Sender is not authorized for this group",
    107: "Unable to store local Distribution state",
    108: "Invalid Distribution value",
    109: "multipart/mixed is forbidden in text groups",
    110: "MIME media type is forbidden in text groups",
    111: "MIME attachment metadata is forbidden in text groups",
    112: "Probable Base64 attachment is forbidden in text groups",
    113: "Malformed MIME structure in text article",
    114: "Unapproved multipart container is forbidden in text groups",
    115: "Invalid Newsgroups syntax",
    116: "Invalid Followup-To syntax",
    117: "Article violates RFC 5536 syntax",
    118: "Header transformation produced invalid RFC 5536 output",
}

# The codes of each category; a code in none of them is INTERNAL.
CATEGORIES = {
    "HEADER": [1, 3, 11, *range(20, 25), 51, 53, 97, 100, 104],
    "GROUP": [2, 4, 6, 7, 8, 10, 17, 18, 25, 26, 37, 54, 95, 108, 115, 116],
    "MIME": [5, 109, 110, 111, 113, 114],
    "BODY": [9, *range(12, 17), 52, 57, 62, 96, 98, 99, 101, 102, 112],
    "DATE": [19, 58],
    "CONFIG": [27, 35, 38, 39, 42, 43, 59, 92, 93, 94],
    "RULE": [28, 29, 34, 49, 63, 91],
    "RATE": [*range(30, 34), *range(64, 91)],
    "DB": [36, 40, 44, 45, 46, 107],
    "SAVE": [41],
    "POLICY": [47, 48, 103],
    "TOR": [50],
    "RBL": [56],
    "URIBL": [60, 61],
    "AUTH": [105, 106],
    "RFC": [117, 118],
}

_CATEGORY = {code: name for name, codes in CATEGORIES.items() for code in codes}


def symbol(code: int) -> str:
    """``PF-<CATEGORY>-NNN``; unknown codes stay visible as INTERNAL."""
    return f"PF-{_CATEGORY.get(code, 'INTERNAL')}-{code:03d}"


def reason_codes(spark: SparkSession) -> DataFrame:
    """(legacy_code, reason_code, category, message), one row for each known code: 119 rows, safe to broadcast."""
    rows = [(c, symbol(c), _CATEGORY.get(c, "INTERNAL"), m) for c, m in MESSAGES.items()]
    return spark.createDataFrame(rows, "legacy_code int, reason_code string, category string, message string")


def with_reason(df: DataFrame, code_col: str = "legacy_code") -> DataFrame:
    """Adds reason_code and message. A code without an entry is INTERNAL with a generic message; null stays null."""
    known = reason_codes(df.sparkSession).select(F.col("legacy_code").alias("__code"), "reason_code", "message")
    code = F.col(code_col)
    return df.join(F.broadcast(known), code == F.col("__code"), "left").drop("__code").withColumns({
        "reason_code": F.coalesce("reason_code", F.when(code.isNotNull(), F.format_string("PF-INTERNAL-%03d", code))),
        "message": F.coalesce("message", F.when(code.isNotNull(), F.concat(F.lit("Unknown historical error "), code.cast("string")))),
    })


def resolve(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Finds the code that a number or a symbol names: adds legacy_code, reason_code and message, null where none."""
    known = reason_codes(df.sparkSession).drop("category")
    query = F.col(query_col)
    match: Column = (query == F.col("legacy_code").cast("string")) | (query == F.col("reason_code"))
    return df.join(F.broadcast(known), match, "left")
