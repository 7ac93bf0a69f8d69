"""WARC derivatives: for each response, a metadata record and a plain-text conversion record that refer to it.

Metadata keeps the response's own header lines, whatever they are. Both keep its target URI and date, name its record id in WARC-Refers-To, and carry its payload digest
in WARC-Source-Payload-Digest; each has a record id of its own, derived from that of the response, and a digest
and length of its block. Only DataFrame functions are used; texts are made by patterns, not by a full HTML parser:
comments, scripts, styles and the title go, block elements end lines, other tags vanish, character references are
decoded once (numeric ones, and the names of HTML 4 with apos), and white space is collapsed. Titles and link targets are decoded too.

`read_warc` reads WARC files by Spark's splits, plain or gzip; `responses_of` takes their responses with the headers they
came with; `write_warc` writes records. A pages table has no such headers: `responses` gives it the ones that a response must have.

Cases: a null payload counts as empty. A null URI gives no WARC-Target-URI line. Repeated responses have equal
record ids and give equal records. An unclosed comment, script or style runs to the end. A reference without semicolon, of an
unknown name or of more than seven digits stays as it is; a number that is no character gives U+FFFD; a no-break space written as a
reference is a space. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
#: Pattern and replacement, in order; both engines that run them read them alike.
STEPS = (
    (r"(?s)<!--.*?(-->|\z)", ""),
    (r"(?is)<script\b[^>]*>.*?(</script\s*>|\z)", ""),
    (r"(?is)<style\b[^>]*>.*?(</style\s*>|\z)", ""),
    (r"(?is)<title\b[^>]*>.*?(</title\s*>|\z)", ""),
    (rf"(?i)</?({BLOCK})\b[^>]*>", "\n"),
    (r"<[a-zA-Z/!?][^>]*>", ""),
)
#: Names of character references, frequent ones first: a lookup goes through them in order.
NAMES = {n: chr(name2codepoint[n]) for n in ("amp", "quot", "lt", "gt")} | {"nbsp": " ", "apos": "'"}
NAMES |= {n: chr(c) for n, c in sorted(name2codepoint.items()) if n not in NAMES}
NUMBER = r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})\z"
#: What the SQL takes for a reference.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
SPACES = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+\z", ""))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
LANG = r'(?i)<html\b[^>]*?\blang\s*=\s*"([^"]*)"'
LINK = r'(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it: lambdas and generators share no subexpressions."""
    return F.element_at(F.transform(F.array(value), f), 1)


def character(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(code == 160, " ").when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(32).cast("long"))), 8, "0")), "UTF-32")).otherwise("\ufffd")


def decoded(text: Column) -> Column:
    """text with its character references decoded once: what a reference gives is not read again."""
    names = F.map_from_arrays(F.split(F.lit(" ".join(NAMES)), " "), F.split(F.lit("\t".join(NAMES.values())), "\t"))

    def plain(run: Column) -> Column:
        return F.replace(run, F.lit("&amp;"), F.lit("&"))

    def numeric(n: Column) -> Column:
        code = F.when(n.rlike("^#[xX]"), F.conv(F.substring(n, 3, 6), 16, 10)).otherwise(F.substring(n, 2, 7)).cast("long")
        return F.when(n.rlike(NUMBER), character(code))

    def one(part: Column) -> Column:
        def given(n: Column) -> Column:
            known = (F.octet_length(n) <= 10) & (F.octet_length(n) < F.octet_length(part))
            to = F.when(known, F.when(F.startswith(n, F.lit("#")), numeric(n)).otherwise(F.try_element_at(names, n)))
            return F.coalesce(F.concat(to, plain(F.substring(part, F.length(n) + 2, F.length(part)))), F.concat(F.lit("&"), plain(part)))

        # only numbers meet a pattern
        return bound(F.substring_index(part, ";", 1), given)

    def joined(parts: Column) -> Column:
        return F.concat(plain(F.element_at(parts, 1)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    # the most frequent reference is replaced by whole runs of text; what the others give is never in such a run
    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), bound(F.split(t, "&(?!amp;)", -1), joined)).otherwise(t))


def plain_text(html: Column) -> Column:
    out = html
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = decoded(out)
    for pattern, to in SPACES[:2]:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(" \n"))  # the other two patterns, by a plain pass


def urn(*parts: Column) -> Column:
    """A record id in the form of a UUID, from the SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) as responses: page_id, record_id, target_uri, date, payload, payload_digest, headers (lines)."""
    html = F.coalesce(pages["html"], F.lit(""))
    key = urn(F.lit("response"), F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.coalesce(pages["url"], F.lit("")), html)
    own = pages.select(pages["page_id"].alias("page_id"), key.alias("record_id"), pages["url"].alias("target_uri"), F.lit(date).alias("date"), html.alias("payload"), digest(html).alias("payload_digest"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri"))
    lines = [F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), "record_id"), uri, F.concat(F.lit("WARC-Date: "), "date"), F.concat(F.lit("WARC-Payload-Digest: "), "payload_digest")]
    return own.withColumn("headers", F.array_compact(F.array(*lines)))


def derive(found: DataFrame) -> DataFrame:
    """responses to records: page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length,
    block_digest, source_payload_digest, header (the record's header lines), block."""
    html = F.col("payload")
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract(html, TITLE, 1)), r"[ \t\r\n\f]+", " "))
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda u: F.regexp_replace(decoded(u), r"[\t\r\n]+", ""))
    fields = F.concat(
        F.lit("title: "), title, F.lit("\r\nlanguage: "), F.regexp_extract(html, LANG, 1),
        F.lit("\r\nsource-length: "), F.octet_length(html).cast("string"), F.lit("\r\n"),
        F.array_join(F.transform(links, lambda u: F.concat(F.lit("outlink: "), u, F.lit("\r\n"))), ""),
        F.array_join(F.transform(F.coalesce("headers", F.array().cast("array<string>")), lambda h: F.concat(F.lit("source-header: "), h, F.lit("\r\n"))), ""),
    )
    kind = lambda name, form, block: F.struct(F.lit(name).alias("warc_type"), F.lit(form).alias("content_type"), block.alias("block"))
    both = F.array(kind("metadata", "application/warc-fields", fields), kind("conversion", "text/plain", plain_text(html)))
    x = found.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"), F.inline(both))
    x = x.withColumn("record_id", urn(F.col("warc_type"), F.col("refers_to"))).withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")), line("WARC-Date", F.col("date")), line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return x.withColumn("header", header).select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_payload_digest", "header", "block")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records (header, block) as WARC files, one for each partition."""
    lines = records.select(F.concat("header", F.lit("\r\n"), "block"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files as records: path, warc_type, record_id, refers_to, target_uri, date, payload_digest, headers (lines), block (binary), whole.

    Records are cut where a version line follows two line ends, so a plain file of any size is read by many tasks. A block that
    itself holds such a place comes in pieces: `whole` tells whether a block has the length that its header gives."""
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    # the first record keeps its own version line, the last one the end of the file; others begin with the digit of the version
    head = F.substring_index("v", "\r\n\r\n", 1)
    lines = F.slice(F.split(head, "\r\n", -1), 2, F.size(F.split(head, "\r\n", -1)))
    block = F.expr("substring(cast(v AS binary), octet_length(substring_index(v, '\\r\\n\\r\\n', 1)) + 5)")
    x = raw.where(F.length("v") > 0).select("path", lines.alias("headers"), block.alias("block"))

    def named(name: str) -> Column:
        line = F.get(F.filter("headers", lambda h: F.lower(F.substring_index(h, ":", 1)) == name.lower()), F.lit(0))
        return F.trim(F.substring(line, len(name) + 2, F.length(line)))

    fields = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest"}
    x = x.withColumns({k: named(n) for k, n in fields.items()} | {"size": named("Content-Length").try_cast("long")})
    # only the last record of a file still has the two line ends that close it
    ended = F.expr("CASE WHEN octet_length(block) = size + 4 AND right(hex(block), 8) = '0D0A0D0A' THEN substring(block, 1, cast(size AS int)) ELSE block END")
    return x.withColumn("block", ended).withColumn("whole", F.coalesce(F.octet_length("block") == F.col("size"), F.lit(False))).select("path", *fields, "headers", "block", "whole")


def responses_of(records: DataFrame) -> DataFrame:
    """The responses among records of `read_warc`, for `derive`: HTTP headers cut off, headers and digest as they came (a digest is made where none came).

    Payloads are read as UTF-8; what is none becomes U+FFFD. page_id is null: such records have no number."""
    raw = F.col("block").cast("string")
    http = F.startswith(raw, F.lit("HTTP/"))
    body = F.when(http, F.expr("substring(block, octet_length(substring_index(cast(block AS string), '\\r\\n\\r\\n', 1)) + 5)")).otherwise(F.col("block"))
    own = records.where("warc_type = 'response'").select("record_id", "target_uri", "date", "payload_digest", "headers", body.alias("body"))
    sha = F.concat(F.lit("sha256:"), F.sha2("body", 256))
    return own.select(F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date", F.make_valid_utf8(F.col("body").cast("string")).alias("payload"), F.coalesce("payload_digest", sha).alias("payload_digest"), "headers")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = derive(responses(pages))
    return out.withColumn("header_sha256", F.sha2("header", 256)).drop("header", "block")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_decoded(text: str) -> str:
    names = ", ".join(_quoted(n) for n in NAMES)
    chars = ", ".join(_quoted(c) for c in NAMES.values())
    name = f"regexp_extract(p, {_quoted(REFERENCE)}, 1)"
    code = "(CASE WHEN n[2:2] IN ('x', 'X') THEN ('0x' || n[3:])::bigint ELSE n[2:]::bigint END)"
    char = f"CASE WHEN {code} = 160 THEN ' ' WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN chr({code}::int) ELSE chr(65533) END"
    to = f"CASE WHEN n = '' THEN NULL WHEN n[1:1] = '#' THEN {char} ELSE list_extract([{chars}], list_position([{names}], n)) END"
    part = f"list_transform([{name}], lambda n: coalesce({to} || p[length(n) + 2:], '&' || p))[1]"
    return f"(list_transform([string_split({text}, '&')], lambda s: s[1] || coalesce(array_to_string(list_transform(s[2:], lambda p: {part}), ''), ''))[1])"


def _sql_text() -> str:
    out = "html"
    for pattern, to in STEPS:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    out = _sql_decoded(out)
    for pattern, to in SPACES:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return out


_UUID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"
SQL = rf"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS html,
       sha256('response' || chr(10) || coalesce(page_id::varchar, '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(html, '')) AS h FROM pages),
s AS (SELECT page_id, url AS target_uri, html, {_UUID} AS refers_to, 'sha256:' || sha256(html) AS source_payload_digest FROM r),
b AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'title: ' || trim(regexp_replace({_sql_decoded(f"regexp_extract(html, {_quoted(TITLE)}, 1)")}, '[ \t\r\n\f]+', ' ', 'g')) || chr(13) || chr(10) || 'language: ' || regexp_extract(html, {_quoted(LANG)}, 1)
    || chr(13) || chr(10) || 'source-length: ' || strlen(html)::varchar || chr(13) || chr(10)
    || coalesce(array_to_string(list_transform(regexp_extract_all(html, {_quoted(LINK)}, 1), lambda u: 'outlink: ' || regexp_replace({_sql_decoded("u")}, '[\t\r\n]+', '', 'g') || chr(13) || chr(10)), ''), '')
    || 'source-header: WARC-Type: response' || chr(13) || chr(10) || 'source-header: WARC-Record-ID: ' || refers_to || chr(13) || chr(10) || coalesce('source-header: WARC-Target-URI: ' || target_uri || chr(13) || chr(10), '')
    || 'source-header: WARC-Date: {DATE}' || chr(13) || chr(10) || 'source-header: WARC-Payload-Digest: ' || source_payload_digest || chr(13) || chr(10) AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain', {_sql_text()} FROM s),
d AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block)::bigint AS content_length, sha256(warc_type || chr(10) || refers_to) AS h FROM b),
e AS (SELECT *, {_UUID} AS record_id FROM d)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_payload_digest,
  sha256(concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to, 'WARC-Target-URI: ' || target_uri,
    'WARC-Date: {DATE}', 'WARC-Source-Payload-Digest: ' || source_payload_digest, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type,
    'Content-Length: ' || content_length::varchar) || chr(13) || chr(10)) AS header_sha256 FROM e"""
