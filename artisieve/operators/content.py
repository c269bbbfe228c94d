"""Content checks: encoded payloads, scored words, MIME parts, Base64 runs and armoured blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from artisieve.operators.rules import SCAN, checked_rules, matches, ranked_by_type, scan_body, tried

UUENCODE = r"(?m)^begin [0-7]{3,4} [^\r\n]+\r?\n[\x20-\x60]{10,}"
YENC = r"(?im)^=ybegin [^\r\n]*"
BASE64_LINE = r"^[A-Za-z0-9+/_-]+={0,2}$"


def binary_code(body: Column, kind: Column, allow_uuencode: bool = False, allow_yenc: bool = False) -> Column:
    """52 or 62 for text articles and 102 for binary ones with a forbidden payload, else 0."""
    uu, yenc = F.coalesce(body.rlike(UUENCODE), F.lit(False)), F.coalesce(body.rlike(YENC), F.lit(False))
    return F.when(uu & F.lit(not allow_uuencode), F.when(kind == "binary", 102).otherwise(52)).when(yenc & F.lit(not allow_yenc), F.when(kind == "binary", 102).otherwise(62)).otherwise(0)


def badword_hits(articles: DataFrame, rules: DataFrame, cap: int = 2000, scan: dict[str, int] | None = SCAN) -> DataFrame:
    """(article_id, rank, rule_id, subject_hit, body_hit, subject_score, body_score, action, own_code, own_reason, own_response):
    word rules that an article meets, in list order, cut after the first that rejects or stops. An article is tried with the
    first ``cap`` rules of its type; a rule may have its own legacy_code, reason_code and response."""
    rules = checked_rules(rules)
    kinds = {"targets": "array<string>", "subject_score": "double", "body_score": "double", "stop_on_match": "boolean", "legacy_code": "int", "reason_code": "string", "response": "string"}
    for c, kind in kinds.items():
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast(kind))
    articles = scan_body(articles, scan)
    ranked, own_type = ranked_by_type(rules, [F.col("ord")], cap)
    def test(r: Callable[[str], Column], known: Callable[[str | None, Column], Column]) -> tuple[Column, Column]:
        hit = lambda name: F.coalesce(F.array_contains(r("targets"), name), F.lit(True)) & known(name, matches(F.col(name), r("pattern"), r("match_type"), r("case_sensitive")))
        subject, body = hit("subject"), hit("body")
        scores = (F.coalesce(r(f"{c}_score"), F.lit(0.0)).alias(f"{c}_score") for c in ("subject", "body"))
        own = (r("legacy_code").cast("int").alias("own_code"), r("reason_code").alias("own_reason"), r("response").alias("own_response"))
        out = F.struct(r("rank").alias("rank"), r("id").alias("rule_id"), subject.alias("subject_hit"), body.alias("body_hit"), *scores, r("action").alias("action"), F.coalesce(r("stop_on_match"), F.lit(False)).alias("stop"), *own)
        return (own_type(F.col("article_type")) == r("type")) & (subject | body), out

    def reads(r: Row) -> list[tuple[str, str | None, str | None]]:
        return [(name, r["pattern"], r["match_type"]) for name in ("subject", "body") if r["targets"] is None or name in r["targets"]]

    found = tried(articles, ranked, test, reads, F.col)
    if ranked.where((F.col("action") == "reject") | F.coalesce("stop_on_match", F.lit(False))).isEmpty():  # nothing cuts the list
        return found
    before = Window.partitionBy("article_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("stopped", F.coalesce(F.max((F.col("action") == "reject") | F.col("stop")).over(before), F.lit(False))).where("NOT stopped").drop("stopped")


def badword_verdict(hits: DataFrame, max_subject: float = 0.0, max_body: float = 0.0) -> DataFrame:
    """(article_id, subject_score, body_score, legacy_code, rule_id, reason_code, response): a rejecting rule first, with its
    own code, reason and response where it has them, then the sums over the thresholds."""
    part = lambda name: F.sum(F.when(F.col(f"{name}_hit"), F.col(f"{name}_score")).otherwise(0.0))
    rejects = F.col("action") == "reject"
    rule = F.struct(F.coalesce("own_code", F.when(F.col("subject_hit"), 28).otherwise(29)).alias("code"), "rule_id", "own_reason", "own_response")
    g = hits.groupBy("article_id").agg(part("subject").alias("subject_score"), part("body").alias("body_score"), F.min_by(F.when(rejects, rule), F.when(rejects, F.col("rank"))).alias("t"))
    code = F.coalesce("t.code", F.when(F.col("subject_score") > max_subject, 28), F.when(F.col("body_score") > max_body, 29), F.lit(0))
    return g.select("article_id", "subject_score", "body_score", code.alias("legacy_code"), F.col("t.rule_id").alias("rule_id"), F.col("t.own_reason").alias("reason_code"), F.col("t.own_response").alias("response"))


def decoded_size(text: Column, encoding: Column) -> Column:
    """Estimated bytes of a part once decoded."""
    bare = F.regexp_replace(text, r"\s+", "")
    padding = F.length(bare) - F.length(F.regexp_replace(bare, "=+$", ""))
    return F.when(F.lower(encoding) == "base64", F.greatest(F.floor(F.length(bare) * 3 / 4) - padding, F.lit(0))).otherwise(F.octet_length(text)).cast("long")


def base64_runs(articles: DataFrame, min_length: int = 60) -> DataFrame:
    """(article_id, first_line, lines, decoded_bytes): runs of neighbouring Base64 lines; one short final line of 4 or more
    characters joins its run. A fold over each body's own lines, with no shuffle."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r?\n", -1), lambda x: F.struct(x.alias("t"), (x.rlike(BASE64_LINE) & (F.length(x) >= min_length)).alias("full"), (x.rlike(BASE64_LINE) & (F.length(x) >= 4)).alias("short")))
    each = articles.where(F.col("body").rlike(rf"(?m)^[A-Za-z0-9+/_-]{{{min_length - 2},}}={{0,2}}\r?$")).select("article_id", F.posexplode(lines).alias("n", "l"))
    w = Window.partitionBy("article_id").orderBy("n")
    last = F.coalesce(F.lag("l.full").over(w), F.lit(False))
    each = each.withColumn("inside", F.col("l.full") | (last & F.col("l.short"))).where("inside")
    start = F.when(F.coalesce(F.lag("n").over(w), F.lit(-2)) != F.col("n") - 1, 1).when(~F.coalesce(F.lag("l.full").over(w), F.lit(True)), 1).otherwise(0)
    size = F.floor(F.length("l.t") * 3 / 4) - (F.length("l.t") - F.length(F.regexp_replace("l.t", "=+$", "")))
    runs = each.withColumn("run", F.sum(start).over(w)).groupBy("article_id", "run").agg(F.min("n").cast("int").alias("first_line"), F.count("*").alias("lines"), F.sum(size).cast("long").alias("decoded_bytes"))
    return runs.drop("run")


def base64_code(runs: DataFrame, min_lines: int = 12, min_bytes: int = 4096, single_line_bytes: int = 8192) -> DataFrame:
    """(article_id, legacy_code): 112 where a run is a probable attachment."""
    big = ((F.col("lines") >= min_lines) & (F.col("decoded_bytes") >= min_bytes)) | ((F.col("lines") == 1) & (F.col("decoded_bytes") >= single_line_bytes))
    return runs.where(big).select("article_id").distinct().withColumn("legacy_code", F.lit(112))


def armour_removed(body: Column, labels: tuple[str, ...] = ("PGP SIGNATURE", "PGP MESSAGE", "PGP PUBLIC KEY BLOCK"), ceiling: int = 65_536) -> Column:
    """The body without complete armoured blocks of an allowed label and at most ``ceiling`` bytes: one linear fold over
    lines that keeps the open label and its buffer."""
    mark = lambda x, word: F.regexp_extract(x, rf"^-----{word} ({'|'.join(re.escape(v) for v in labels)})-----\s*$", 1)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("label"), none.alias("held"))

    def fold(s: Column, x: Column) -> Column:
        opens, closes = mark(x, "BEGIN"), mark(x, "END")
        held = F.concat(s["held"], F.array(x))
        small = F.length(F.array_join(held, "\n")) <= ceiling
        return (
            F.when(opens != "", F.struct(F.concat(s["out"], s["held"]).alias("out"), opens.alias("label"), F.array(x).alias("held")))
            .when((s["label"] != "") & (closes == s["label"]), F.struct(F.when(small, s["out"]).otherwise(F.concat(s["out"], held)).alias("out"), F.lit("").alias("label"), none.alias("held")))
            .when(s["label"] != "", F.struct(s["out"].alias("out"), s["label"].alias("label"), held.alias("held")))
            .otherwise(F.struct(F.concat(s["out"], F.array(x)).alias("out"), s["label"].alias("label"), none.alias("held")))
        )

    folded = F.aggregate(F.split(body, "\n", -1), start, fold, lambda s: F.array_join(F.concat(s["out"], s["held"]), "\n"))
    return F.when(body.contains("-----BEGIN "), folded).otherwise(body)


def header_parameters(value: str | None) -> tuple[str, dict[str, str]] | None:
    """The lower-case token and parameters of a MIME header; quotes and escapes are read; None where malformed."""
    if value is None:
        return "", {}
    fields, at, quoted, escaped = [""], 0, False, False
    for c in value:
        if quoted and escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif c == ";" and not quoted:
            fields.append("")
            at += 1
            continue
        fields[at] += c
    if quoted:
        return None
    out = {}
    for f in fields[1:]:
        name, eq, text = f.strip().partition("=")
        if not f.strip():
            continue
        if not eq or not re.fullmatch(r"[^\s()<>@,;:\\\"/\[\]?=]+", name.strip()):
            return None
        text = text.strip()
        if len(text) > 1 and text[0] == text[-1] == '"':
            text = re.sub(r"\\(.)", r"\1", text[1:-1])
        out.setdefault(name.strip().lower(), text)
    return fields[0].strip().lower(), out


def split_boundary(body: str, boundary: str) -> list[str] | None:
    """The parts between whole boundary lines; None without an opening, a closing or a part."""
    if not boundary or len(boundary) > 200:
        return None
    parts: list[list[str]] = []
    closed = False
    for line in body.split("\n"):
        bare = line.rstrip("\r \t")
        if bare == f"--{boundary}--":
            closed = True
            break
        if bare == f"--{boundary}":
            parts.append([])
        elif parts:
            parts[-1].append(line)
    return ["\n".join(p) for p in parts] if closed and parts else None


def part_headers(raw: str) -> tuple[dict[str, str], str] | None:
    """Headers (lower-case names, folds joined, repeats joined by a comma) and body of a part; None where malformed."""
    if raw.startswith(("\n", "\r\n")):
        return {}, raw.split("\n", 1)[1]
    head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
    out: dict[str, str] = {}
    last = ""
    for line in head.split("\n"):
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif (m := re.match(r"([!-9;-~]+):\s*(.*)$", line)) is not None:
            last = m[1].lower()
            out[last] = f"{out[last]}, {m[2]}" if last in out else m[2]
        elif line:
            return None
    return out, body


#: Characters of bodies and rows of parts that a task gathers before it passes them on.
PART_BYTES, PART_ROWS = 2 << 20, 4096
PART_SCHEMA = "article_id long, part_no int, location string, depth int, media_type string, disposition string, filename string, params map<string,string>, cte string, body string, malformed boolean, reason string"


def mime_parts(articles: DataFrame, max_depth: int = 8, max_parts: int = 100) -> DataFrame:
    """One row for each MIME part, in document order: ``articles(article_id, content_type, cte, disposition, body)``.

    The part tree of one article is walked in its own task; a part that is malformed, too deep or past the
    greatest number is a row with its reason and is not opened."""

    def walk(article: tuple) -> Iterator[tuple]:
        n = 0

        def visit(where: str, depth: int, content_type: str | None, cte: str | None, disposition: str | None, body: str) -> Iterator[tuple]:
            nonlocal n
            n += 1
            row = (article[0], n, where, depth)
            kind, disp = header_parameters(content_type), header_parameters(disposition)
            if kind is None or disp is None:
                yield (*row, None, None, None, {}, cte, body, True, "header")
                return
            media, params = kind[0] or "text/plain", kind[1]
            name = next((v for d in (disp[1], params) for k, v in d.items() if k.split("*")[0] in ("filename", "name")), None)
            full = (*row, media, disp[0] or None, name, params, (cte or "").strip().lower() or None, body)
            if depth > max_depth or n > max_parts:
                yield (*full, True, "depth" if depth > max_depth else "parts")
            elif media.startswith("multipart/"):
                parts = split_boundary(body, params.get("boundary", ""))
                yield (*full, parts is None, None if parts is not None else "boundary")
                for i, raw in enumerate(parts or [], 1):
                    if n >= max_parts + 1:
                        return
                    got = part_headers(raw)
                    if got is None:
                        n += 1
                        yield (article[0], n, f"{where}.{i}", depth + 1, None, None, None, {}, None, raw, True, "part")
                    else:
                        h, text = got
                        yield from visit(f"{where}.{i}", depth + 1, h.get("content-type"), h.get("content-transfer-encoding"), h.get("content-disposition"), text)
            else:
                yield (*full, False, None)

        yield from visit("1", 1, *article[1:4], article[4] or "")

    return articles.select("article_id", "content_type", "cte", "disposition", "body").mapInArrow(lambda batches: part_batches(batches, walk), PART_SCHEMA)


def part_batches(batches: Iterable[pa.RecordBatch], walk: Callable[[tuple], Iterable[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows of ``walk`` for each article. A batch holds as many articles as their number says, whatever their size, so parts leave
    after some megabytes of bodies."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PART_SCHEMA.split(", "))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = ([list(x.items()) for x in c] if pa.types.is_map(f.type) else c for f, c in zip(schema, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)

    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            article = tuple(c[i].as_py() for c in batch.columns)
            size += len(article[4] or "")
            rows += walk(article)
            if size >= PART_BYTES or len(rows) >= PART_ROWS:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def media_matches(media: Column, patterns: list[str]) -> Column:
    one = lambda p: "".join(".*" if c == "*" else re.escape(c) for c in p)
    return media.rlike("(?i)^(?:" + "|".join(map(one, patterns)) + ")$") if patterns else F.lit(False)


def mime_verdict(parts: DataFrame, allowed_media: list[str], forbidden_media: list[str], allowed_multipart: list[str], max_part_bytes: int = 1_048_576, on_malformed: str = "reject") -> DataFrame:
    """(article_id, legacy_code, part_no): the first failing part in document order."""
    multi = F.col("media_type").startswith("multipart/")
    listed = media_matches(F.col("media_type"), allowed_media)
    code = (
        F.when(F.col("reason").isin("depth", "parts", "header", "part"), 113 if on_malformed == "reject" else None)
        .when((F.col("disposition") == "attachment") | F.col("filename").isNotNull(), 111)
        .when(F.col("media_type") == "multipart/mixed", 109)
        .when(multi & ~media_matches(F.col("media_type"), allowed_multipart), 114)
        .when(F.col("malformed"), 113 if on_malformed == "reject" else None)
        .when(~multi & listed & (decoded_size(F.col("body"), F.col("cte")) > max_part_bytes), 110)
        .when(~multi & (media_matches(F.col("media_type"), forbidden_media) | ~listed), 110)
    )
    return parts.withColumn("code", code).where("code IS NOT NULL").groupBy("article_id").agg(F.min(F.struct("part_no", "code")).alias("x")).select("article_id", F.col("x.code").alias("legacy_code"), F.col("x.part_no").alias("part_no"))


def scan_segments(parts: DataFrame, budget: int = 32_768) -> DataFrame:
    """(article_id, part_no, segment): part bodies in order, sharing one byte budget an article."""
    w = Window.partitionBy("article_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.octet_length("body")).over(w), F.lit(0)), F.lit(0))
    return parts.where("NOT malformed AND NOT media_type LIKE 'multipart/%'").withColumn("left", left.cast("int")).where("left > 0").select("article_id", "part_no", F.substring(F.col("body").cast("binary"), F.lit(1), F.col("left")).cast("string").alias("segment"))
