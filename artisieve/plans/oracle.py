"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from artisieve.functions.codes import MESSAGES, symbol
from artisieve.operators.rates import METRICS
from artisieve.plans import queries as Q


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CODES = "codes AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {text(symbol(c))}, {text(m)})" for c, m in MESSAGES.items()) + ") t(code, symbol, message))"

EV = f"""{CODES}, raw AS (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k, event_type = 'error' AS bad FROM events),
ev AS (SELECT event_id AS id, epoch_us(ts) AS received_us, 'u' || user_id AS auth_user, '198.51.100.' || (user_id % 40) AS client_ip,
  CASE WHEN event_type = 'purchase' THEN 'binary' ELSE 'text' END AS article_type, CASE WHEN bad THEN 'reject' ELSE 'pass' END AS technical_verdict,
  user_id % 2 = 0 AS audit_mode, CASE WHEN bad AND user_id % 2 = 0 THEN 'accepted' WHEN bad AND k >= 90 THEN 'discarded' WHEN bad THEN 'rejected' ELSE 'accepted' END AS nntp_result,
  bad AS would_reject, CASE WHEN bad THEN 1 + k % 90 ELSE 0 END AS legacy_code, CASE WHEN bad THEN c.symbol ELSE 'PF-ACCEPT-000' END AS reason_code, c.message AS reason_text,
  CAST(round(value * 100) AS BIGINT) AS total_size, 1 + k % 5 AS group_count, k % 3 AS followup_count, user_id % 25 = 0 AS tor, value AS elapsed_ms,
  sha256(user_id || '-' || k) AS article_digest, k, user_id
  FROM raw LEFT JOIN codes c ON c.code = CASE WHEN bad THEN 1 + k % 90 ELSE 0 END)"""


def since(hours: int) -> str:
    return f"{EV}, win AS (SELECT * FROM ev WHERE received_us >= (SELECT max(received_us) FROM ev) - {hours} * 3600000000)"


WIN = since(168)
ACC, REJ = "CASE WHEN nntp_result = 'accepted' THEN 1 ELSE 0 END", "CASE WHEN technical_verdict = 'reject' THEN 1 ELSE 0 END"
VALUES = {"articles": ACC, "errors": REJ, "size": "total_size", "groups": "group_count", "followups": "followup_count"}
LONG, SHORT = 86_400_000_000, 600_000_000


def trailing(value: str, keys: str, period: int) -> str:
    return f"CAST(coalesce(sum({value}) OVER (PARTITION BY {keys} ORDER BY received_us RANGE BETWEEN {period} PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


def snapshot(by_type: bool = False) -> str:
    keys = "kind, lookup" + (", article_type" if by_type else "")
    digest = "article_digest" + (", article_type" if by_type else "")
    cols = ", ".join(f"{trailing(VALUES[n.rsplit('_', 1)[1]], keys, SHORT if 'short' in n else LONG)} AS {n}" for n, _ in METRICS)
    return f"""{EV}, ident AS (SELECT *, CASE WHEN regexp_matches(auth_user, '{Q.PUBLIC}') THEN 'IP' ELSE 'ID' END AS kind, CASE WHEN regexp_matches(auth_user, '{Q.PUBLIC}') THEN client_ip ELSE auth_user END AS lookup,
      {trailing(ACC, digest, LONG)} AS multipost FROM ev), snap AS (SELECT *, {cols} FROM ident)"""


def violations() -> str:
    own = {"articles": "1", "errors": "0", "size": "total_size", "groups": "group_count", "followups": "followup_count"}
    whens = ["WHEN multipost >= 4 THEN '30 absolute_multipost'", "WHEN multipost >= 2 THEN '30 multipost'"]
    for name, codes in METRICS:
        for kind, limits in Q.LIMITS.items():
            if name in limits:
                whens.append(f"WHEN kind = '{kind}' AND {name} + {own[name.rsplit('_', 1)[1]]} > {limits[name]} THEN '{codes[kind]} {name}'")
    return f"WITH {snapshot()}, v AS (SELECT id, CASE {' '.join(whens)} END AS x FROM snap) SELECT id, CAST(split_part(x, ' ', 1) AS INT) AS legacy_code, split_part(x, ' ', 2) AS metric FROM v WHERE x IS NOT NULL"


def enforced(multipost: int) -> str:
    """One event of each user a step; the state is the user's events of the last day."""
    repeat = f"WHEN len(list_filter(w, lambda x: x.ok AND x.d = d)) >= {multipost} THEN 30" if multipost else ""
    return f"""WITH RECURSIVE {EV}, e AS MATERIALIZED (SELECT id, auth_user AS u, received_us AS t, bad, article_digest AS d, row_number() OVER (PARTITION BY auth_user ORDER BY received_us, id) AS n FROM (SELECT *, would_reject AS bad FROM ev)),
r AS (SELECT u, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(t BIGINT, ok BOOLEAN, d VARCHAR)[]) AS h, CAST(NULL AS BIGINT) AS id, 0 AS code FROM e WHERE n = 1
UNION ALL SELECT u, n, list_append(w, {{'t': t, 'ok': NOT bad AND code = 0, 'd': d}}), id, CASE WHEN bad THEN 0 ELSE code END FROM (
  SELECT *, CASE {repeat} WHEN len(list_filter(w, lambda x: x.ok)) + 1 > 5 THEN 33 WHEN len(list_filter(w, lambda x: NOT x.ok)) > 2 THEN 66 ELSE 0 END AS code
  FROM (SELECT e.*, list_filter(r.h, lambda x: x.t >= e.t - {LONG}) AS w FROM r JOIN e ON e.u = r.u AND e.n = r.n + 1)))
SELECT id, CAST(code AS INTEGER) AS legacy_code FROM r WHERE code > 0"""


#: Addresses as (third group of 16 bits, last digit, whether outside), whose membership is arithmetic on the third group.
V6 = """v6 AS (SELECT DISTINCT CASE WHEN doc_id % 11 = 0 THEN '2001:DB9:' ELSE '2001:db8:' END || printf('%x', doc_id % 512) || '::' || printf('%x', doc_id % 7) AS ip, doc_id % 512 AS g, doc_id % 7 AS l, doc_id % 11 = 0 AS away FROM documents),
nets6 AS (SELECT * FROM (VALUES ('2001:db8::/32', 32), ('2001:db8:40::/42', 42), ('2001:db8:7::/48', 48), ('2001:db8:9::5', 128), ('2001:db8:100::/41', 41), ('::/0', 0)) t(network, bits)),
in6 AS (SELECT ip, network, bits FROM v6, nets6 WHERE bits = 0 OR NOT away AND CASE bits WHEN 32 THEN true WHEN 42 THEN g // 64 = 1 WHEN 48 THEN g = 7 WHEN 41 THEN g // 128 = 2 ELSE g = 9 AND l = 5 END)"""


B64 = "rtrim(repeat(repeat('A', 64) || chr(10), 100), chr(10))"
AR = f"""a0 AS (SELECT *, text AS b0 FROM documents), a1 AS (SELECT *, CASE WHEN doc_id % 26 = 0 THEN b0 || chr(10) || '-----BEGIN PGP SIGNATURE-----' || chr(10) || {B64} || chr(10) || '-----END PGP SIGNATURE-----'
  WHEN doc_id % 13 = 0 THEN b0 || chr(10) || {B64} ELSE b0 END AS b1 FROM a0), a2 AS (SELECT *, CASE WHEN doc_id % 19 = 0 THEN b1 || chr(10) || '=ybegin line=128 size=4 name=x' ELSE b1 END AS b2 FROM a1),
ar AS (SELECT doc_id AS article_id, '<doc' || doc_id || '@fixture.invalid>' AS message_id, substring(split_part(text, chr(10), 1), 1, 60) AS subject, source || ' <' || source || '@' || lang || '.example.org>' AS "from",
  CASE WHEN doc_id % 10 = 5 THEN 'alt.binaries.' || source WHEN doc_id % 10 = 0 THEN lang || '.' || source || ',alt.binaries.' || source ELSE lang || '.' || source END AS newsgroups,
  '172.' || (16 + doc_id % 20) || '.5.9' AS client_ip, 1704067200000000 + doc_id * 60000000 AS received_us,
  CASE WHEN doc_id % 17 = 0 THEN '> ' || replace(b2, chr(10), chr(10) || '> ') ELSE b2 END AS body, lang, source FROM a2),
ty AS (SELECT *, string_split(newsgroups, ',') AS grp, CASE WHEN article_id % 10 = 5 THEN 'binary' WHEN article_id % 10 = 0 THEN 'mixed' ELSE 'text' END AS article_type FROM ar)"""
#: The bytes of the body that word and ban rules read, less a character cut in two.
SCAN_BYTES = "CASE WHEN article_type = 'binary' THEN 1048576 ELSE 32768 END"
SCANNED = f"CASE WHEN octet_length(encode(body)) <= {SCAN_BYTES} THEN body ELSE coalesce(" + ", ".join(f"try(decode(encode(body)[1:({SCAN_BYTES}) - {i}]))" for i in range(4)) + ") END"
BYTES = "octet_length(encode(body))"
HEAD = "octet_length(encode(subject)) + octet_length(encode(\"from\")) + octet_length(encode(newsgroups)) + octet_length(encode(message_id)) + length('FromNewsgroupsSubjectMessage-ID') + 12"
LINES = "regexp_split_to_array(body, '\\r?\\n')"

PG = "pg AS (SELECT page_id AS article_id, url || chr(10) || html AS body FROM pages)"
URLS = f"""{PG}, u0 AS (SELECT article_id, list_transform(regexp_extract_all(body, '(?i)\\b(https?://[^\\s<>"''\\]\\[()]+)', 1), lambda u: regexp_replace(u, '[.,;:!?]+$', '')) AS l FROM pg),
  u1 AS (SELECT article_id, unnest(l) AS url, generate_subscripts(l, 1) AS i FROM u0), u2 AS (SELECT article_id, url, min(i) AS i FROM u1 GROUP BY ALL),
  u3 AS (SELECT article_id, url, row_number() OVER (PARTITION BY article_id ORDER BY i) - 1 AS pos FROM u2),
  ur AS (SELECT article_id, pos, url, lower(regexp_replace(regexp_extract(url, '(?i)^https?://(?:[^/?#]*@)?([^/?#]*)', 1), ':\\d*$', '')) AS host FROM u3 WHERE pos < 20)"""
SUFFIX = "(" + ", ".join(map(text, Q.SUFFIXES)) + ")"
DOMAINS = f"""{URLS}, hs AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM ur WHERE host <> ''), hp AS (SELECT host, min(i) AS p FROM (SELECT host, l, unnest(range(1, len(l) + 1)) AS i FROM hs) WHERE array_to_string(l[i:], '.') IN {SUFFIX} GROUP BY host),
  dm AS (SELECT host, CASE WHEN regexp_full_match(host, '\\d+(\\.\\d+){{3}}') OR len(l) = 1 THEN host WHEN p IS NOT NULL THEN array_to_string(l[greatest(p - 1, 1):], '.') ELSE array_to_string(l[greatest(len(l) - 1, 1):], '.') END AS domain FROM hs LEFT JOIN hp USING (host))"""

HM = lambda v: "sha256('" + "".join(f"\\x{b ^ 0x5C:02X}" for b in Q.KEY.ljust(64, b"\0")) + "'::BLOB || unhex(sha256('" + "".join(f"\\x{b ^ 0x36:02X}" for b in Q.KEY.ljust(64, b"\0")) + f"'::BLOB || {v})))"  # noqa: E731, E501

IPN = lambda c: f"(split_part({c}, '.', 1)::BIGINT * 16777216 + split_part({c}, '.', 2)::BIGINT * 65536 + split_part({c}, '.', 3)::BIGINT * 256 + split_part({c}, '.', 4)::BIGINT)"


LISTING = lambda c: f"(('0x' || substr(md5({c}), 1, 8))::BIGINT % 9)"
REVERSED = "array_to_string(list_reverse(string_split(client_ip, '.')), '.')"


def v4_networks(networks: list[str]) -> str:
    import ipaddress

    rows = []
    for n in networks:
        net = ipaddress.ip_network(n, strict=False)
        if net.version == 4:
            rows.append(f"({text(n)}, {int(net[0])}, {int(net[-1])})")
    return "nets AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(network, lo, hi))"


def badword_hits() -> str:
    parts = []
    for i, n, pattern, subject, body, action in Q.BADWORDS:
        s, b = (f"coalesce(regexp_matches({c}, {text('(?i)' + pattern)}), false)" for c in ("subject", SCANNED))
        parts.append(f"SELECT article_id, '{i}' AS rule_id, {n} AS rank, {s} AS subject_hit, {b} AS body_hit, {subject}::DOUBLE AS ss, {body}::DOUBLE AS bs, '{action}' AS action FROM ty WHERE {s} OR {b}")
    return f"{AR}, w0 AS ({' UNION ALL '.join(parts)}), w1 AS (SELECT *, min(CASE WHEN action = 'reject' THEN rank END) OVER (PARTITION BY article_id) AS cut FROM w0), wh AS (SELECT * FROM w1 WHERE cut IS NULL OR rank <= cut)"


BADWORD_VERDICT = f"""{badword_hits()}, ws AS (SELECT article_id, sum(CASE WHEN subject_hit THEN ss ELSE 0 END) AS subject_score, sum(CASE WHEN body_hit THEN bs ELSE 0 END) AS body_score,
  min(CASE WHEN action = 'reject' THEN CASE WHEN subject_hit THEN 28 ELSE 29 END END) AS r FROM wh GROUP BY article_id),
  wv AS (SELECT article_id, subject_score, body_score, CAST(coalesce(r, CASE WHEN subject_score > 2 THEN 28 WHEN body_score > 4 THEN 29 ELSE 0 END) AS INT) AS legacy_code FROM ws)"""


def ban_hits(only: str | None = None) -> str:
    parts = []
    for i, n, priority, target, match, pattern, action in Q.BANS:
        if only not in (None, i):
            continue
        column = {"newsgroups": "newsgroups", "subject": "subject", "from.address": "source || '@' || lang || '.example.org'", "client.ip": "client_ip", "body": SCANNED}[target]
        hit = f"contains(lower({column}), lower({text(pattern)}))" if match == "contains" else f"{IPN(column)} BETWEEN {172 * 2**24 + 20 * 2**16} AND {172 * 2**24 + 23 * 2**16 + 65535}" if match == "cidr" else f"regexp_matches({column}, {text('(?i)' + pattern)})"
        parts.append(f"SELECT article_id, '{i}' AS rule_id, {-priority * 1000 + n} AS rank, '{action}' AS action FROM ty WHERE {hit}")
    return f"b0 AS ({' UNION ALL '.join(parts)}), b1 AS (SELECT *, min(CASE WHEN action IN ('reject', 'drop') THEN rank END) OVER (PARTITION BY article_id) AS cut FROM b0), bh AS (SELECT article_id, rule_id, action, rank FROM b1 WHERE cut IS NULL OR rank <= cut)"


FEATURES = f"{AR}, fe AS (SELECT *, {BYTES} AS body_size, {HEAD} AS header_size FROM ty)"
L = LINES
HEALTH = "hl AS (SELECT event_id AS id, 'p' || (user_id % 3) AS provider, epoch_us(ts) AS ts_us, regexp_extract(props, '(\\d+)', 1)::INT < 30 AS ok FROM events)"
WRITTEN = """'From: ' || "from" || chr(10) || 'Message-ID: ' || message_id || chr(10) || 'Newsgroups: ' || newsgroups || chr(10) || CASE WHEN subject <> '' THEN 'subject: ' || subject || chr(10) ELSE '' END || chr(10) || body"""
SCORES = """sc AS (SELECT article_id, (CASE WHEN regexp_matches(newsgroups, '(?i)^en\\.') THEN 4.0 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)que') THEN 7.5 ELSE 0 END)::DOUBLE AS lang_score,
  (CASE WHEN regexp_matches(subject, '(?i)th') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(subject, '(?i)er') THEN 5.0 ELSE 0 END)::DOUBLE AS word_score, regexp_matches(newsgroups, '(?i)alt') AS lim,
  regexp_matches(newsgroups, '(?i)^en\\.|alt') OR regexp_matches(subject, '(?i)th|er') OR regexp_matches(body, '(?i)que') AS has_hit FROM ty)"""

ORACLE: dict[str, str] = {
    "rate_snapshot": f"WITH {snapshot()} SELECT id, kind, lookup, {', '.join(Q.COUNTERS)} FROM snap",
    "event_commits": f"WITH {EV} SELECT strftime(make_timestamp(received_us), '%Y-%m-%d') AS received_date, article_type, count(*) AS n, count(*) FILTER (WHERE would_reject) AS n_hits, CAST(sum(total_size) AS BIGINT) AS bytes FROM ev GROUP BY ALL",
    "rate_enforced": enforced(0),
    "rate_enforced_multipost": enforced(2),
    "rate_snapshot_by_type": f"WITH {snapshot(True)} SELECT id, kind, lookup, article_type, {', '.join(Q.COUNTERS)} FROM snap",
    "rate_violations": violations(),
    "multipost_count": f"WITH {EV} SELECT id, article_digest, {trailing(ACC, 'article_digest', LONG)} AS multipost FROM ev",
    "query_events": f"WITH {EV} SELECT id, received_us, auth_user, reason_code, nntp_result FROM ev WHERE article_type = 'text' AND client_ip = '198.51.100.7' ORDER BY received_us DESC, id DESC LIMIT 100",
    "stats_hours": f"WITH {since(72)} SELECT article_type, nntp_result, technical_verdict, count(*) AS count FROM win GROUP BY ALL",
    "report_totals": f"WITH {WIN} SELECT count(*) AS total, count(*) FILTER (nntp_result = 'accepted') AS accepted, count(*) FILTER (nntp_result = 'rejected') AS rejected, count(*) FILTER (nntp_result = 'discarded') AS discarded, count(*) FILTER (audit_mode AND would_reject) AS audit_would_reject, count(*) FILTER (tor) AS tor, round(avg(elapsed_ms), 6) AS avg_elapsed_ms, max(elapsed_ms) AS max_elapsed_ms FROM win",
    "report_by_type": f"WITH {WIN} SELECT article_type, count(*) AS total, count(*) FILTER (nntp_result = 'accepted') AS accepted, count(*) FILTER (nntp_result = 'rejected') AS rejected, count(*) FILTER (nntp_result = 'discarded') AS discarded, count(*) FILTER (audit_mode AND would_reject) AS audit FROM win GROUP BY article_type",
    "report_reasons": f"WITH {WIN} SELECT article_type, reason_code, legacy_code, reason_text, count(*) AS count FROM win WHERE technical_verdict = 'reject' GROUP BY ALL ORDER BY count DESC, article_type, reason_code, legacy_code, reason_text LIMIT 20",
    "report_rules": f"WITH {WIN} SELECT 'rule-' || (k % 12) AS rule_id, count(*) AS count, sum(k % 20)::DOUBLE AS score FROM win WHERE technical_verdict = 'reject' GROUP BY 1 ORDER BY count DESC, rule_id LIMIT 20",
    "report_hourly": f"WITH {WIN} SELECT strftime(make_timestamp(received_us), '%Y-%m-%d %H:00') AS bucket, count(*) AS total, count(*) FILTER (nntp_result = 'accepted') AS accepted, count(*) FILTER (nntp_result = 'rejected') AS rejected, count(*) FILTER (audit_mode AND would_reject) AS audit FROM win GROUP BY 1",
    "report_identities": f"WITH {WIN} SELECT client_ip, auth_user, count(*) AS count, count(*) FILTER (technical_verdict = 'reject') AS rejected FROM win GROUP BY ALL ORDER BY count DESC, client_ip, auth_user LIMIT 20",
    "saved_list": f"WITH {EV} SELECT id AS event_id, received_us AS created_us, total_size AS file_size, reason_code, legacy_code FROM ev WHERE nntp_result = 'rejected' AND article_type = 'text' ORDER BY received_us DESC, id DESC LIMIT 100",
    "purge_preview": f"WITH {EV} SELECT count(*) AS count FROM ev WHERE received_us < (SELECT max(received_us) FROM ev) - 240 * 3600000000",
    "purge_apply": f"WITH {EV}, c AS (SELECT *, received_us < (SELECT max(received_us) FROM ev) - 240 * 3600000000 AS gone FROM ev) SELECT 'events' AS part, count(*) FILTER (NOT gone) AS rows FROM c UNION ALL SELECT 'hits', count(*) FILTER (NOT gone AND technical_verdict = 'reject') FROM c UNION ALL SELECT 'saved_linked', count(*) FILTER (NOT gone AND nntp_result = 'rejected') FROM c UNION ALL SELECT 'purged', count(*) FILTER (gone) FROM c",
    "history_merge": f"WITH {EV} SELECT CASE WHEN id % 2 = 0 THEN 'text' ELSE article_type END AS article_type, CASE WHEN id % 2 = 0 THEN 'plain' ELSE 'hmac' END AS identity_storage_mode, count(*) AS n FROM ev GROUP BY ALL",
    "code_lookup": f"WITH {EV}, q AS (SELECT CAST(legacy_code + k AS INT) AS legacy_code, count(*) AS n FROM ev GROUP BY 1) SELECT legacy_code, n, coalesce(symbol, 'PF-INTERNAL-' || lpad(legacy_code::VARCHAR, 3, '0')) AS reason_code, coalesce(message, 'Unknown historical error ' || legacy_code) AS message FROM q LEFT JOIN codes ON code = legacy_code",
    "article_features": f"WITH {FEATURES} SELECT article_id, CAST(len(grp) AS INT) AS group_count, article_type, source || '@' || lang || '.example.org' AS from_address, substring(sha256(message_id), 1, 24) AS message_id_hash, CAST(body_size AS BIGINT) AS body_size, CAST(header_size AS BIGINT) AS header_size, CAST(body_size + header_size AS BIGINT) AS total_size, CAST(least(body_size, 32768) AS INT) AS scan_size FROM fe",
    "article_types": f"WITH {AR} SELECT article_type, CAST(len(grp) AS INT) AS group_count, count(*) AS n FROM ty GROUP BY ALL",
    "article_digest": f"WITH {AR} SELECT article_id, sha256(subject || body) AS article_digest FROM ar",
    "line_stats": f"WITH {AR} SELECT article_id, CAST(len({L}) AS INT) AS lines, CAST(len(list_filter({L}, lambda x: regexp_matches(x, '^[>:|]'))) AS INT) AS quoted, CAST(len(list_filter({L}, lambda x: x = '')) AS INT) AS empty, CAST(len(list_filter({L}, lambda x: regexp_full_match(x, '\\s+'))) AS INT) AS blank, CAST(list_max(list_transform({L}, lambda x: length(x))) AS INT) AS longest FROM ar",
    "urls": f"WITH {URLS} SELECT article_id, CAST(pos AS INT) AS pos, url, host FROM ur",
    "registered_domains": f"WITH {DOMAINS} SELECT host, domain FROM dm",
    "article_domains": f"WITH {DOMAINS}, f AS (SELECT article_id, domain, min(pos) AS p FROM ur JOIN dm USING (host) GROUP BY ALL), r AS (SELECT article_id, domain, row_number() OVER (PARTITION BY article_id ORDER BY p) - 1 AS pos FROM f) SELECT article_id, CAST(pos AS INT) AS pos, domain FROM r WHERE pos < 10",
    "tor_clients": f"WITH {AR}, {v4_networks(['172.17.0.0/16', '172.20.5.8/30'])} SELECT article_id, true AS tor, 50 AS legacy_code FROM ar JOIN nets ON {IPN('client_ip')} BETWEEN lo AND hi UNION SELECT article_id, true, 50 FROM ar WHERE {LISTING(REVERSED)} < 2",
    "dnsbl_hits": f"WITH {AR} SELECT article_id, {REVERSED} || '.bl.example' AS query, CASE WHEN {LISTING(REVERSED)} < 2 THEN 'listed' WHEN {LISTING(REVERSED)} IN (3, 4) THEN 'error' ELSE 'clean' END AS status, {LISTING(REVERSED)} = 3 AS reject_on_failure FROM ar",
    "uri_list_hits": f"WITH {DOMAINS}, f AS (SELECT article_id, domain, min(pos) AS p FROM ur JOIN dm USING (host) GROUP BY ALL), r AS (SELECT article_id, domain, row_number() OVER (PARTITION BY article_id ORDER BY p) - 1 AS pos FROM f) SELECT DISTINCT article_id, 60 AS legacy_code, 'surbl' AS provider FROM r WHERE pos < 10 AND {LISTING('domain')} IN (0, 1, 3)",
    "cidr6_matches": f"WITH {V6} SELECT ip, network FROM in6",
    "longest_prefix": f"""WITH {EV}, {V6}, {v4_networks([*Q.NETWORKS, "198.51.100.0/24"])}, ips AS (SELECT DISTINCT client_ip AS ip FROM ev),
      found AS (SELECT * FROM in6 UNION ALL SELECT ip, network, CAST(coalesce(nullif(split_part(network, '/', 2), ''), '32') AS INT) FROM ips JOIN nets ON {IPN('ip')} BETWEEN lo AND hi)
      SELECT ip, network, bits FROM found QUALIFY row_number() OVER (PARTITION BY ip ORDER BY bits DESC, network) = 1""",
    "cidr_matches": f"WITH {EV}, {AR}, {v4_networks(Q.NETWORKS)}, ips AS (SELECT client_ip AS ip FROM ar UNION SELECT client_ip FROM ev) SELECT ip, network FROM ips JOIN nets ON {IPN('ip')} BETWEEN lo AND hi",
    "unknown_groups": f"WITH {AR}, act AS (SELECT DISTINCT lang || '.' || source AS g FROM documents WHERE source <> 'src0'), x AS (SELECT DISTINCT article_id, unnest(grp) AS g FROM ty) SELECT article_id, string_agg(g, ',' ORDER BY g) AS unknown FROM x WHERE g NOT IN (SELECT g FROM act) GROUP BY article_id",
    "sender_authorised": f"WITH {AR}, x AS (SELECT article_id, lang, source, unnest(grp) AS g FROM ty) SELECT DISTINCT article_id, 106 AS legacy_code FROM x WHERE g = lang || '.' || source AND source = 'src3' AND lang IN ('fr', 'en')",
    "access_profile": f"WITH {snapshot()}, w AS (SELECT DISTINCT kind, lookup FROM ident) SELECT kind, lookup, p AS profile_id, CAST(CASE p WHEN 'p1' THEN 3 WHEN 'p2' THEN 50 WHEN 'p3' THEN 7 WHEN 'p4' THEN NULL ELSE 5 END AS BIGINT) AS max_articles FROM (SELECT *, CASE WHEN kind = 'ID' AND lookup = 'u11' THEN 'p2' WHEN kind = 'ID' AND regexp_matches(lookup, '^u1\\d$') THEN 'p1' WHEN kind = 'ID' AND regexp_matches(lookup, '^u.2$') THEN 'p4' WHEN kind = 'IP' AND {IPN('lookup')} % 256 < 16 THEN 'p3' END AS p FROM w)",
    "trusted_profile": f"WITH {AR}, x AS (SELECT article_id, split_part(client_ip, '.', 2)::INT AS o, source, lang FROM ar), p AS (SELECT article_id, CASE WHEN o BETWEEN 24 AND 31 THEN CASE WHEN lang = 'fr' THEN 't3' END END AS p3, CASE WHEN o IN (18, 19) OR regexp_matches(source, 'src[13]$') THEN 't2' END AS p2, CASE WHEN o BETWEEN 16 AND 19 THEN 't1' END AS p1, lang FROM x), q AS (SELECT article_id, CASE WHEN lang = 'fr' THEN coalesce(p3, p2, p1) ELSE coalesce(p2, p1) END AS profile FROM (SELECT article_id, lang, p2, p1, p3 FROM p)) SELECT article_id, profile, CASE profile WHEN 't1' THEN 'rbl' WHEN 't2' THEN 'rbl,badwords' ELSE '' END AS skip_checks, profile = 't3' AS full_bypass FROM q WHERE profile IS NOT NULL",
    "badword_hits": f"WITH {badword_hits()} SELECT article_id, rule_id, subject_hit, body_hit FROM wh",
    "word_list_hits": f"""WITH {AR}, w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) >= 4),
      h AS (SELECT article_id, word AS rule_id, CASE WHEN ascii(word) % 2 = 0 THEN regexp_matches(subject, '(?i)(^|[^a-z])' || word || '([^a-z]|$)') ELSE contains(lower(subject), word) END AS subject_hit,
        CASE WHEN ascii(word) % 2 = 0 THEN regexp_matches(body, '(?i)(^|[^a-z])' || word || '([^a-z]|$)') ELSE contains(lower(body), word) END AS body_hit FROM ar, w)
      SELECT article_id, rule_id, coalesce(subject_hit, false) AS subject_hit, coalesce(body_hit, false) AS body_hit FROM h WHERE subject_hit OR body_hit""",
    "badword_verdict": f"WITH {BADWORD_VERDICT} SELECT * FROM wv",
    "ban_hits": f"WITH {AR}, {ban_hits()} SELECT article_id, rule_id, action FROM bh",
    "ban_verdict": f"WITH {AR}, {ban_hits()} SELECT article_id, CASE WHEN count(*) FILTER (action IN ('reject', 'drop')) > 0 THEN 34 ELSE 0 END AS legacy_code, CASE WHEN count(*) FILTER (action = 'drop') > 0 THEN 'discard' END AS requested_action, max(CASE WHEN action IN ('reject', 'drop') THEN rule_id END) AS rule_id, bool_or(action = 'save') AS force_save FROM bh GROUP BY article_id",
    "rule_test": f"WITH {AR}, {ban_hits('b3')} SELECT article_id, rule_id, action FROM bh",
    "named_scores": f"WITH {AR}, {SCORES} SELECT article_id, lang_score, word_score, CASE WHEN lang_score > 10 THEN 'lang' WHEN word_score > 10 OR (lim AND word_score > 6) THEN 'word' END AS over FROM sc WHERE has_hit",
    "config_overrides": f"WITH {AR} SELECT article_id, '1' AS max_crosspost FROM ty WHERE contains(newsgroups, 'alt')",
    "encoded_binaries": f"WITH {AR} SELECT article_id, CASE WHEN regexp_matches(body, '(?i)(^|\\n)=ybegin ') THEN CASE WHEN article_type = 'binary' THEN 102 ELSE 62 END ELSE 0 END AS legacy_code FROM ty",
    "base64_runs": f"WITH {AR}, ls AS (SELECT article_id, unnest({L}) AS t, generate_subscripts({L}, 1) - 1 AS n FROM ar WHERE contains(body, repeat('A', 60))), g AS (SELECT *, n - row_number() OVER (PARTITION BY article_id ORDER BY n) AS isl FROM ls WHERE regexp_full_match(t, '[A-Za-z0-9+/_-]{{58,}}={{0,2}}') AND length(t) >= 60) SELECT article_id, CAST(min(n) AS INT) AS first_line, count(*) AS lines, CAST(sum(length(t) * 3 // 4) AS BIGINT) AS decoded_bytes FROM g GROUP BY article_id, isl",
    "armour_removed": f"WITH {AR} SELECT article_id, CAST({BYTES} - CASE WHEN article_id % 26 = 0 AND article_id % 17 <> 0 THEN octet_length(encode(chr(10) || '-----BEGIN PGP SIGNATURE-----' || chr(10) || {B64} || chr(10) || '-----END PGP SIGNATURE-----')) ELSE 0 END AS INT) AS size FROM ar",
    "final_actions": f"WITH {EV}, c AS (SELECT *, CASE WHEN k >= 90 THEN 'discard' WHEN legacy_code <> 0 THEN 'reject' ELSE 'accept' END AS action, audit_mode AND legacy_code NOT IN (0, 48) AS quiet FROM ev), f AS (SELECT *, CASE WHEN quiet OR action = 'accept' THEN 'accepted' WHEN action = 'discard' THEN 'discarded' ELSE 'rejected' END AS result FROM c) SELECT id, action, result AS nntp_result, legacy_code <> 0 AND (legacy_code = 12 OR reason_code = 'PF-RULE-034') AS save, quiet AS would_reject, legacy_code AS final_code, CASE result WHEN 'accepted' THEN '' WHEN 'discarded' THEN 'DROP' ELSE reason_text END AS response FROM f",
    "custom_rule": "SELECT doc_id AS article_id, CASE WHEN doc_id % 97 = 0 OR doc_id % 4 = 3 THEN 63 WHEN doc_id % 4 = 0 THEN 34 ELSE 0 END AS legacy_code, CASE WHEN doc_id % 97 = 0 THEN 'broken' WHEN doc_id % 4 = 3 THEN 'too odd ' || (doc_id % 5) END AS message FROM documents",
    "pseudonyms": f"SELECT c_custkey, substring({HM('encode(c_name)')}, 1, 24) AS pseudonym FROM customer",
    "lookup_tokens": f"WITH {EV} SELECT DISTINCT client_ip, auth_user, 'h1:' || {HM("encode('client_ip') || '\\x00'::BLOB || encode(client_ip)")} AS ip_token, 'h1:' || {HM("encode('auth_user') || '\\x00'::BLOB || encode(auth_user)")} AS user_token FROM ev",
    "redacted": f"WITH {EV}, r AS (SELECT client_ip, auth_user, count(*) AS n FROM ev GROUP BY ALL) SELECT substring(client_ip, 1, 3) || '…' || right(client_ip, 2) AS ip, CASE WHEN length(auth_user) <= 5 THEN 'u…' ELSE substring(auth_user, 1, 3) || '…' || right(auth_user, 2) END AS user, 'h1:' || substring({HM('encode(auth_user)')}, 1, 24) AS user_hmac, n FROM r",
    "reveal_roundtrip": f"WITH {EV} SELECT id, client_ip FROM ev",
    "header_rewrite": f"""WITH {AR}, x AS (SELECT article_id, client_ip, article_id % 25 = 0 AS tor, CASE WHEN article_id % 3 = 0 THEN '' ELSE source END AS usr FROM ar)
      SELECT article_id, 'pf-' || substring({HM("encode(CASE WHEN usr = '' THEN client_ip ELSE usr END)")}, 1, 24) || '@news.example.invalid' AS sender, CASE WHEN tor THEN 'tor-network!' ELSE '' END || 'not-for-mail' AS path, 'Example' AS organization,
      'news.example.invalid; posting-host="' || substring({HM('encode(client_ip)')}, 1, 32) || '"' || CASE WHEN usr = '' THEN '' ELSE '; posting-account="' || substring({HM('encode(usr)')}, 1, 32) || '"' END AS injection_info, CAST(NULL AS VARCHAR) AS x_trace, CASE WHEN tor THEN 'yes' END AS x_tor, '1' AS x_filter FROM x""",
    "local_threads": "WITH RECURSIVE p AS (SELECT DISTINCT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN true WHEN turn = 3 AND conv_id % 6 = 0 THEN false END AS own FROM conversations), r AS (SELECT conv_id, turn, coalesce(own, false) AS local FROM p WHERE own IS NOT NULL OR turn = 0 OR NOT EXISTS (SELECT 1 FROM p q WHERE q.conv_id = p.conv_id AND q.turn = p.turn - 1) UNION ALL SELECT p.conv_id, p.turn, r.local FROM r JOIN p ON p.conv_id = r.conv_id AND p.turn = r.turn + 1 WHERE p.own IS NULL) SELECT '<c' || conv_id || '-' || turn || '@fixture.invalid>' AS message_id, local, 0 AS legacy_code FROM r",
    "serialized_articles": f"WITH {AR} SELECT article_id, sha256({WRITTEN}) AS digest FROM ar",
    "parsed_articles": f"WITH {AR} SELECT article_id, CASE WHEN subject <> '' THEN ltrim(subject) END AS subject, message_id, CAST({BYTES} AS INT) AS body_size FROM ar",
    "rnews_batch": f"WITH {AR}, w AS (SELECT article_id, {WRITTEN} AS t FROM ar) SELECT article_id, sha256('#! rnews ' || octet_length(encode(t)) || chr(10) || t) AS digest FROM w",
    "mbox_batch": f"WITH {AR}, w AS (SELECT article_id, received_us, source || '@' || lang || '.example.org' AS s, {WRITTEN} AS t FROM ar), m AS (SELECT article_id, 'From ' || s || ' ' || strftime(make_timestamp(received_us), '%a %b %-d %H:%M:%S %Y') AS l, regexp_replace(t, '(^|\\n)From ', '\\1>From ', 'g') AS t FROM w) SELECT article_id, CAST(octet_length(encode(l || chr(10) || t || chr(10))) AS INT) AS size, l AS from_line FROM m",
    "rule_log_lines": f"WITH {AR}, {ban_hits()} SELECT rule_id, strftime(make_timestamp(received_us), '%Y-%m-%dT%H:%M:%SZ') || ' rule=' || rule_id || ' action=' || action || ' message_id=' || message_id || ' message=matched' AS line FROM bh JOIN ar USING (article_id)",
    "export_jsonl": f"""WITH {EV} SELECT '{{"auth_user":"' || auth_user || '","id":' || id || ',"received_us":' || received_us || ',"tor":' || tor || '}}' AS line FROM ev""",
    "export_csv": f"""WITH {EV} SELECT '"' || auth_user || '","' || id || '","' || CASE WHEN legacy_code > 0 THEN 'say ""' || reason_code || '""' ELSE '' END || '","' || received_us || '"' AS line FROM ev""",
    "template_lines": f"""WITH {AR} SELECT article_id, 'from ' || "from" || ' in ' || newsgroups || ': ' || message_id || ' at ' || client_ip || ' (100%)' AS line FROM ar""",
    "saved_rejects": f"""WITH {AR}, w AS (SELECT article_id, message_id, received_us, octet_length(encode({WRITTEN})) + octet_length(encode('X-Reject-Code: PF-RULE-034' || chr(10) || 'X-Reject-Number: 34' || chr(10) || 'X-Reject-Reason: Banlist' || chr(10))) AS n FROM ar) SELECT article_id AS event_id, 'text/' || strftime(make_timestamp(received_us), '%Y/%m/%d') || '/' || (received_us // 1000000) || '.' || lpad((received_us % 1000000)::VARCHAR, 6, '0') || '.PF-RULE-034.' || substring(sha256(message_id), 1, 24) || '.post' AS path, CAST(n AS BIGINT) AS file_size, received_us AS created_us FROM w""",
    "provider_health": f"WITH {HEALTH}, e AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY ts_us, id) AS era FROM hl), f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY provider, era ORDER BY ts_us, id) AS BIGINT) AS failures FROM e), s AS (SELECT *, max(CASE WHEN failures >= 4 THEN ts_us END) OVER (PARTITION BY provider ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS struck FROM f) SELECT id, provider, failures, coalesce(ts_us - struck < 1800000000, false) AS suppressed FROM s",
    "lookup_dedupe": f"WITH {HEALTH}, {EV}, r AS (SELECT hl.*, ev.client_ip AS key FROM hl JOIN ev USING (id)), l AS (SELECT *, lag(ts_us) OVER w AS t, lag(ok) OVER w AS o FROM r WINDOW w AS (PARTITION BY provider, key ORDER BY ts_us, id)) SELECT id, coalesce(ts_us - t < CASE WHEN o THEN 36000000000 ELSE 300000000 END, false) AS cached FROM l",
}

N = "article_id"
STYLE = f"""st AS (SELECT article_id, CASE WHEN {N} % 31 = 0 THEN 1 WHEN {N} % 14 = 0 THEN 4 WHEN {N} % 33 = 0 THEN 5 WHEN article_type = 'text' AND {BYTES} > 20000 THEN 96 WHEN article_type = 'binary' AND {BYTES} > 10000 THEN 99
  WHEN {N} % 17 = 0 AND {N} % 5 <> 0 THEN 11 WHEN list_max(list_transform({L}, lambda x: length(x))) > 3000 THEN 12 WHEN {N} % 17 = 0 THEN 13 WHEN {N} % 10 = 0 THEN 25 WHEN list_contains(grp, 'es.src7') THEN 54
  WHEN {N} % 23 = 0 OR {N} % 29 = 0 THEN 19 WHEN {N} % 37 = 0 THEN 22 ELSE 0 END AS code FROM ty)"""
BINARY = "bi AS (SELECT article_id, CASE WHEN regexp_matches(body, '(?i)(^|\\n)=ybegin ') THEN CASE WHEN article_type = 'binary' THEN 102 ELSE 62 END ELSE 0 END AS code FROM ty)"
STEPS = f"""{BADWORD_VERDICT}, {ban_hits()}, {STYLE}, {BINARY}, bv AS (SELECT article_id, CASE WHEN count(*) FILTER (action IN ('reject', 'drop')) > 0 THEN 34 ELSE 0 END AS code FROM bh GROUP BY article_id),
  sp AS (SELECT article_id, st.code AS c0, bi.code AS c1, coalesce(bv.code, 0) AS c2, coalesce(wv.legacy_code, 0) AS c3 FROM st JOIN bi USING (article_id) LEFT JOIN bv USING (article_id) LEFT JOIN wv USING (article_id)),
  fv AS (SELECT article_id, CASE WHEN c0 <> 0 THEN 'style' WHEN c1 <> 0 THEN 'binary' WHEN c2 <> 0 THEN 'banlist' WHEN c3 <> 0 THEN 'badwords' END AS step, CASE WHEN c0 <> 0 THEN c0 WHEN c1 <> 0 THEN c1 WHEN c2 <> 0 THEN c2 ELSE c3 END AS legacy_code FROM sp)"""
MD = "md AS (SELECT doc_id AS article_id, doc_id % 5 = 0 AS mixed, doc_id % 7 = 0 AS broken, doc_id % 3 AS k, octet_length(encode(text)) AS b1 FROM documents)"


def violations_sql() -> str:
    wrong = [("From", "41 = 0", "invalid-mailbox-list"), ("Newsgroups", "43 = 0", "invalid-newsgroups"), ("Date", "23 = 0", "invalid-date-time"), ("Distribution", "14 = 0", "invalid-distribution"), ("Content-Type", "33 = 0", "invalid-content-type"), ("References", "20 = 0", "invalid-references"), ("Path", "18 = 9", "invalid-path"), ("Lines", "26 = 13", "invalid-lines"), ("Content-Language", "30 = 15", "invalid-content-language")]
    parts = [f"SELECT article_id, '{h}' AS header, '{reason}' AS reason FROM ar WHERE article_id % {when}" for h, when, reason in wrong]
    parts.append("SELECT article_id, 'Subject', 'empty-folded-line' FROM ar WHERE trim(subject) = '' AND article_id % 17 <> 0")
    parts.append("SELECT article_id, 'Subject', 'missing-mandatory-header' FROM ar WHERE subject = '' AND article_id % 17 <> 0")
    parts.append(f"SELECT article_id, '(body)', CASE WHEN regexp_matches(body, '\\r[^\\n]|\\r$') THEN 'bare-cr-in-body' ELSE 'body-line-too-long' END FROM ar WHERE regexp_matches(body, '\\r[^\\n]|\\r$') OR list_max(list_transform({L}, lambda x: length(x))) > 998")
    return f"WITH {AR} " + " UNION ALL ".join(parts)


ORACLE |= {
    "style_verdict": f"WITH {AR}, {STYLE} SELECT article_id, code AS legacy_code FROM st",
    "article_violations": violations_sql(),
    "verdicts_audit": f"WITH {STEPS} SELECT article_id, step, legacy_code FROM fv",
    "verdicts_enforce": f"WITH {STEPS} SELECT article_id, step, legacy_code FROM fv WHERE legacy_code <> 0",
    "explain_steps": f"WITH {STEPS} " + " UNION ALL ".join(f"SELECT article_id, {i} AS step_no, '{n}' AS step, c{i} AS legacy_code, CASE WHEN c{i} = 0 THEN 'pass' ELSE 'reject' END AS verdict FROM sp" for i, n in enumerate(["style", "binary", "banlist", "badwords"])),
    "mime_parts": f"WITH {MD} SELECT article_id, 1 AS part_no, '1' AS location, 1 AS depth, CASE WHEN mixed THEN 'multipart/mixed' ELSE 'multipart/alternative' END AS media_type, CAST(NULL AS VARCHAR) AS filename, broken AS malformed FROM md UNION ALL SELECT article_id, 2, '1.1', 2, 'text/plain', NULL, false FROM md WHERE NOT broken UNION ALL SELECT article_id, 3, '1.2', 2, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/html' ELSE 'multipart/alternative' END, CASE WHEN k = 0 THEN 'a;b.png' END, false FROM md WHERE NOT broken UNION ALL SELECT article_id, 4, '1.2.1', 3, 'text/plain', NULL, false FROM md WHERE NOT broken AND k = 2",
    "mime_verdict": f"WITH {MD} SELECT article_id, CASE WHEN mixed THEN 109 WHEN broken THEN 113 WHEN k = 0 THEN 111 ELSE 110 END AS legacy_code, CASE WHEN mixed OR broken THEN 1 ELSE 3 END AS part_no FROM md WHERE mixed OR broken OR k < 2",
    "scan_segments": f"WITH {MD} SELECT article_id, 1 + CAST(b1 < 32768 AS BIGINT) AS parts, CAST(least(b1, 32768) + CASE WHEN b1 < 32768 THEN least(32768 - b1, CASE k WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 1 END) ELSE 0 END AS BIGINT) AS bytes FROM md WHERE NOT broken",
}
