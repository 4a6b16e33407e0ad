"""Queries over text, media, pages and markdown, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import emit
from ..sources import html, media, texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_D_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_D_WS}+', ''), '{_D_WS}+$', '')"
_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS line_ix FROM documents)"
_BLOCKS = f"{_LINES}, blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) - 1 AS INTEGER) AS block_ix, t AS text FROM (SELECT doc_id, line_ix, {_STRIP('s')} AS t FROM lines) WHERE t <> '')"
_WRAP = f"""{_LINES}, pieces AS (
  SELECT doc_id, line_ix, p, substr(rt, p * 78 + 1, 78) AS t
  FROM (SELECT doc_id, line_ix, regexp_replace(s, '{_D_WS}+$', '') AS rt FROM lines), LATERAL (SELECT unnest(range(0, greatest((length(rt) - 1) // 78, 0) + 1)) AS p)
), numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix, p) - 1 AS n, t FROM pieces),
wrapped AS (SELECT doc_id, CAST(n // 54 + 1 AS INTEGER) AS page, CAST(n % 54 AS INTEGER) AS row, t AS text FROM numbered),
rects AS (
  SELECT doc_id, page, row, text, CAST(72 + 6 * (length(text) - length(regexp_replace(text, '^{_D_WS}+', ''))) AS BIGINT) AS x0,
         CAST(72 + 12 * (row + 1) - 10 AS BIGINT) AS y0, CAST(72 + 6 * length(text) AS BIGINT) AS x1, CAST(72 + 12 * (row + 1) AS BIGINT) AS y1
  FROM wrapped WHERE text <> ''
)"""
_CLEAN = lambda x: _STRIP(f"replace({x}, '<!--', '<! --')")


def text_blocks(spark, sf):
    return texts.text_blocks(table(spark, sf, "documents"))


def text_wrap_pages(spark, sf):
    return texts.wrap_pages(table(spark, sf, "documents"))


def convert_text(spark, sf):
    """Every document as anchored markdown, one row of the conversions index each."""
    return emit.wrapped_markdown(table(spark, sf, "documents")).drop("markdown")


CONVERT = f"""{_WRAP}, marks AS (
  SELECT w.doc_id, w.page, string_agg(CASE WHEN w.text <> '' THEN '<!-- @' || w.page || ' [' || r.x0 || ',' || r.y0 || ',' || r.x1 || ',' || r.y1 || '] p -->' || chr(10) || {_CLEAN('w.text')} || chr(10) || chr(10) ELSE '' END, '' ORDER BY w.row) AS body
  FROM wrapped w LEFT JOIN rects r ON w.doc_id = r.doc_id AND w.page = r.page AND w.row = r.row GROUP BY 1, 2
), bodies AS (
  SELECT doc_id, count(*) AS pages, string_agg('<!-- page ' || page || ' size=612x792 unit=point -->' || chr(10) || chr(10) || body, '' ORDER BY page) AS body FROM marks GROUP BY 1
), sums AS (SELECT doc_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM rects GROUP BY 1),
md AS (
  SELECT d.doc_id, b.pages, coalesce(s.blocks, 0) AS blocks, coalesce(s.chars, 0) AS chars, d.text,
    '---' || chr(10) || 'format: inkfold/1' || chr(10) || 'generator: inkfold' || chr(10) || 'source: document' || chr(10) || 'provider: plain-text' || chr(10) || 'doc_id: ' || d.doc_id || chr(10)
    || 'pages: ' || b.pages || chr(10) || 'blocks: ' || coalesce(s.blocks, 0) || chr(10) || 'chars: ' || coalesce(s.chars, 0) || chr(10) || '---' || chr(10) || chr(10)
    || regexp_replace(b.body, '\\s+$', '') || chr(10) AS markdown
  FROM documents d JOIN bodies b USING (doc_id) LEFT JOIN sums s USING (doc_id)
)"""


def latin1_uncoverable(spark, sf):
    d = table(spark, sf, "documents")
    n = T.uncoverable(F.col("text"))
    return d.select("doc_id", n.alias("uncoverable"), F.when(n > 0, "refuse").otherwise("render").alias("route"))


def media_classify(spark, sf):
    """Documents and pages as bytes, with names that hint, lie or say nothing."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").cast("binary").alias("content"), F.concat(F.lit("x."), F.element_at(F.array(F.lit("txt"), F.lit("csv"), F.lit("pdf"), F.lit("bin")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("name"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.when(F.col("page_id") % 5 == 0, F.to_binary(F.lit("255044462D312E37"), F.lit("hex"))).otherwise(F.col("html").cast("binary")).alias("content"), F.lit("page").alias("name"))
    both = d.unionByName(p)
    kind = media.classify(F.col("content"), F.col("name"))
    both = both.select("id", kind.alias("k"))
    return both.select("id", F.col("k.kind").alias("kind"), F.col("k.media_type").alias("media_type"), media.route(F.col("k.kind"), F.lit(False), F.lit("plain"))["route"].alias("route"))


def email_sniff(spark, sf):
    d = table(spark, sf, "documents")
    mail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("From: a@b.example\nSubject: "), F.split("text", "\n")[0], F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", media.looks_email(mail).alias("is_email"))


def _html(spark, sf):
    return html.html_blocks(table(spark, sf, "pages"))


def html_blocks(spark, sf):
    return _html(spark, sf).where("kind = 'block'").select("page_id", "seq", "text", "zone", "role")


# Independent token windows: scripts, styles, comments and the head go; a break tag starts a run; inside an open <b> all is bold.
_HTML = r"""
WITH tidy AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages
), tokens AS (
  SELECT page_id, unnest(regexp_extract_all(h, '<[^>]*>|[^<]+')) AS t, unnest(range(0, len(regexp_extract_all(h, '<[^>]*>|[^<]+')))) AS i FROM tidy
), named AS (
  SELECT page_id, i, t, CASE WHEN t LIKE '<%' THEN lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) END AS tag, t LIKE '</%' AS closes FROM tokens
), runs AS (
  SELECT *, tag IN ('h1','p','div','li','nav','ul','article','footer') AS breaks FROM named
), numbered AS (
  SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER w AS run,
         max(CASE WHEN tag = 'b' THEN i END) OVER w AS bold_at, max(CASE WHEN tag IN ('article', 'body') AND closes THEN i END) OVER w AS reset_at
  FROM runs WINDOW w AS (PARTITION BY page_id ORDER BY i)
), texts AS (
  SELECT page_id, run, min(i) AS i,
         max(CASE WHEN breaks AND NOT closes AND tag IN ('h1','p','div','li') THEN tag END) AS role,
         string_agg(CASE WHEN tag = 'br' THEN chr(10) WHEN tag IS NULL THEN
           regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g') ELSE '' END, '' ORDER BY i) AS raw,
         bool_and(bold_at IS NOT NULL AND bold_at > coalesce(reset_at, -1)) FILTER (WHERE tag IS NULL AND trim(t) <> '') AS bold
  FROM numbered GROUP BY page_id, run
), squeezed AS (
  SELECT page_id, i, role, bold, trim(regexp_replace(raw, '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) AS text FROM texts
), kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS seq FROM squeezed WHERE text <> ''),
blocks AS (
  SELECT page_id, CAST(seq AS INTEGER) AS seq, CASE WHEN role = 'li' THEN '- ' || text ELSE text END AS text,
         CASE WHEN role = 'h1' THEN 'title' WHEN role = 'li' THEN 'body' WHEN bold AND length(text) <= 120 THEN 'heading' ELSE 'body' END AS zone, role FROM kept
)
"""


def html_outline(spark, sf):
    """Blocks of each zone and their characters, page by page."""
    b = html_blocks(spark, sf)
    n = lambda z: F.count_if(F.col("zone") == z).alias(f"{z}s")
    return b.groupBy("page_id").agg(n("title"), n("heading"), F.count_if(F.col("zone") == "body").alias("bodies"), F.sum(F.length("text")).alias("chars"))


def html_lang(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_lang(F.col("html")).alias("lang"))


def html_markdown(spark, sf):
    """Pages as markdown in provider order, without anchors for want of geometry."""
    b = html_blocks(spark, sf)
    md = F.when(F.col("zone").isin("title", "heading"), T.heading(F.col("text"), F.col("zone") == "title")).otherwise(T.clean(F.col("text")))
    rows = b.select("page_id", "seq", md.alias("md"))
    g = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "md"))), lambda x: x["md"]), "\n\n").alias("body"))
    full = F.concat(T.page_marker(F.lit(1)), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return g.select("page_id", F.length(full).cast("long").alias("chars"), F.sha2(full, 256).alias("sha256_markdown"))


def case_profile(spark, sf):
    u, c = T.case_counts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", u.alias("upper"), c.alias("cased"), T.case_voided(u, c).alias("voided"))


def script_class(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.script_class(F.col("text")).alias("script_class"))


def digit_class(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), F.col("props").alias("t"))
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    return e.unionByName(d).select("id", T.digit_class(F.col("t")).alias("digit_class"))


def block_metrics(spark, sf):
    """Counts and flags of every block; the case profile of its document decides whether case speaks."""
    d = table(spark, sf, "documents")
    u, c = T.case_counts(F.col("text"))
    b = d.withColumn("voided", T.case_voided(u, c)).select("doc_id", "voided", F.posexplode(texts.blocks_of(F.col("text"))).alias("block_ix", "text"))
    b = b.withColumn("mark", T.last_mark(F.col("text")))
    t, m = F.col("text"), F.col("mark")
    return b.select("doc_id", "block_ix", F.length(t).cast("long").alias("char_count"), T.is_terminal(m).alias("ends_terminal_punct"), T.is_hyphen(m).alias("ends_hyphen"), T.starts_lowercase(t, F.col("voided")).alias("starts_lowercase"), T.digit_class(t).alias("digit_class"))


_VOID = "(length(regexp_replace({t}, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g')) = 0 OR 10 * length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g')) >= 9 * length(regexp_replace({t}, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g')))"
_DIGIT = "CASE WHEN length(regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g')) = 0 THEN 'none' WHEN length(regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g')) = length(regexp_replace({t}, '[^\\p{{Nd}}\\p{{L}}]', '', 'g')) THEN 'all' WHEN 2 * length(regexp_replace({t}, '[^\\p{{Nd}}]', '', 'g')) >= length(regexp_replace({t}, '[^\\p{{Nd}}\\p{{L}}]', '', 'g')) THEN 'high' ELSE 'low' END"
_LAST = "right(regexp_replace(text, '[\\s\"\\x27\\p{Pe}\\p{Pf}]+$', ''), 1)"


def alignment(spark, sf):
    """Alignment of every wrapped row within its page."""
    r = texts.row_rects(texts.wrap_pages(table(spark, sf, "documents")))
    w = Window.partitionBy("doc_id", "page")
    a = G.alignment(F.col("x0"), F.col("x1"), F.lit(10), F.min("x0").over(w), F.max("x1").over(w))
    return r.select("doc_id", "page", "row", a.alias("alignment"))


def dedupe_inputs(spark, sf):
    """One row for each distinct input: its first document and its copies."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256_input"))
    return d.groupBy("sha256_input").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def anchor_grade(spark, sf):
    """Grammar, bounds and page order of the anchors in the markdown of every document."""
    md = emit.wrapped_markdown(table(spark, sf, "documents")).select("doc_id", "pages", "markdown")
    a = F.regexp_extract_all("markdown", F.lit(r"(<!-- @\d+ \[-?\d+,-?\d+,-?\d+,-?\d+\] [^ ]+ -->)"), F.lit(1))
    num = lambda s, k: F.regexp_extract(s, r"@(\d+) \[(-?\d+),(-?\d+),(-?\d+),(-?\d+)\]", k).cast("long")
    good = F.filter(a, lambda s: (num(s, 2) >= 0) & (num(s, 3) >= 0) & (num(s, 4) <= 612) & (num(s, 5) <= 792) & (num(s, 2) <= num(s, 4)) & (num(s, 3) <= num(s, 5)))
    pages = F.transform(F.regexp_extract_all("markdown", F.lit(r"<!-- page (\d+) size=\d+x\d+ unit=\w+ -->"), F.lit(1)), lambda x: x.cast("long"))
    rising = F.forall(F.sequence(F.lit(2), F.greatest(F.size(pages), F.lit(2))), lambda i: F.coalesce(F.try_element_at(pages, i) > F.try_element_at(pages, i - 1), F.lit(True)))
    return md.select("doc_id", F.size(a).cast("long").alias("anchors"), F.size(good).cast("long").alias("in_bounds"), F.size(pages).cast("long").alias("pages"), rising.alias("ascending"))


def conversions_page(spark, sf):
    """Newest first, a page of the index: limit clamped to 1..500, offset to 0 or more."""
    limit, offset = max(1, min(25, 500)), max(0, 10)
    c = emit.wrapped_markdown(table(spark, sf, "documents")).select("doc_id", "pages", "blocks", "chars")
    return c.orderBy(F.desc("chars"), "doc_id").offset(offset).limit(limit)


QUERIES = {f.__name__: f for f in (convert_text, text_blocks, text_wrap_pages, latin1_uncoverable, media_classify, email_sniff, html_blocks, html_outline, html_lang, html_markdown, case_profile, script_class, digit_class, block_metrics, alignment, dedupe_inputs, anchor_grade, conversions_page)}

_FIRST = "string_split(text, chr(10))[1]"
SQL = {
    "convert_text": f"WITH {CONVERT} SELECT doc_id, pages, blocks, chars, sha256(markdown) AS sha256_markdown, sha256(text) AS sha256_input FROM md",
    "text_blocks": f"WITH {_BLOCKS} SELECT doc_id, block_ix, text FROM blocks",
    "text_wrap_pages": f"WITH {_WRAP} SELECT doc_id, page, row, text FROM wrapped",
    "latin1_uncoverable": "SELECT doc_id, CAST(length(regexp_replace(text, '[\\x{00}-\\x{ff}]', '', 'g')) AS BIGINT) AS uncoverable, CASE WHEN regexp_matches(text, '[^\\x{00}-\\x{ff}]') THEN 'refuse' ELSE 'render' END AS route FROM documents",
    "media_classify": """
SELECT 'd' || doc_id AS id, 'text' AS kind, CASE WHEN doc_id % 4 = 1 THEN 'text/csv' ELSE 'text/plain' END AS media_type, 'plain' AS route FROM documents
UNION ALL SELECT 'p' || page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END, CASE WHEN page_id % 5 = 0 THEN 'needs_ocr' ELSE 'html' END
FROM pages WHERE html ILIKE '<!doctype html%'""",
    "email_sniff": """
SELECT doc_id, doc_id % 3 = 0 OR (len(string_split(text, chr(10) || chr(10))[1]) > 0
  AND len(list_filter(string_split(string_split(text[1:8192], chr(10) || chr(10))[1], chr(10)), lambda l: l <> '' AND NOT regexp_matches(l, '^[ \\t]|^[\\x21-\\x39\\x3b-\\x7e]+:'))) = 0
  AND len(list_filter(['from:', 'to:', 'subject:', 'date:', 'message-id:', 'received:', 'mime-version:'], lambda n: contains(lower(string_split(text[1:8192], chr(10) || chr(10))[1]), n))) >= 2) AS is_email FROM documents""",
    "html_blocks": f"{_HTML} SELECT page_id, seq, text, zone, role FROM blocks",
    "html_outline": f"{_HTML} SELECT page_id, count(*) FILTER (zone = 'title') AS titles, count(*) FILTER (zone = 'heading') AS headings, count(*) FILTER (zone = 'body') AS bodies, CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY 1",
    "html_lang": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
    "html_markdown": f"""{_HTML}, md AS (
  SELECT page_id, '<!-- page 1 -->' || chr(10) || chr(10) || string_agg(CASE zone WHEN 'title' THEN '# ' WHEN 'heading' THEN '## ' ELSE '' END || CASE WHEN zone <> 'body' AND text LIKE '#%' THEN chr(92) ELSE '' END || text, chr(10) || chr(10) ORDER BY seq) || chr(10) AS m FROM blocks GROUP BY 1)
SELECT page_id, CAST(length(m) AS BIGINT) AS chars, sha256(m) AS sha256_markdown FROM md""",
    "case_profile": f"SELECT doc_id, CAST(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS upper, CAST(length(regexp_replace(text, '[^\\p{{Lu}}\\p{{Ll}}]', '', 'g')) AS BIGINT) AS cased, {_VOID.format(t='text')} AS voided FROM documents",
    "script_class": """
WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters,
  length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[^\\x{41}-\\x{24f}\\x{1e00}-\\x{1eff}]', '', 'g')) AS latin FROM documents)
SELECT doc_id, CASE WHEN letters = 0 THEN 'none' WHEN 10 * latin >= 9 * letters THEN 'latin' ELSE 'mixed' END AS script_class FROM n""",
    "digit_class": f"SELECT id, {_DIGIT.format(t='t')} AS digit_class FROM (SELECT 'e' || event_id AS id, props AS t FROM events UNION ALL SELECT 'd' || doc_id, text FROM documents)",
    "block_metrics": f"""WITH {_BLOCKS}, v AS (SELECT doc_id, {_VOID.format(t='text')} AS voided FROM documents)
SELECT doc_id, block_ix, CAST(length(text) AS BIGINT) AS char_count, {_LAST} IN ('.', '!', '?', '…', '。', '！', '？', '؟', '۔') AS ends_terminal_punct,
  {_LAST} IN ('-', '‐', '‑', chr(173)) AS ends_hyphen,
  CASE WHEN voided OR NOT regexp_matches(text, '[\\p{{Lu}}\\p{{Ll}}]') THEN NULL ELSE regexp_matches(regexp_extract(text, '[\\p{{Lu}}\\p{{Ll}}]'), '\\p{{Ll}}') END AS starts_lowercase,
  {_DIGIT.format(t='text')} AS digit_class FROM blocks JOIN v USING (doc_id)""",
    "alignment": f"""WITH {_WRAP}, m AS (SELECT *, x0 - min(x0) OVER (PARTITION BY doc_id, page) AS l, max(x1) OVER (PARTITION BY doc_id, page) - x1 AS r FROM rects)
SELECT doc_id, page, row, CASE WHEN l <= 10 AND r <= 10 THEN 'justified' WHEN l <= 10 THEN 'left' WHEN r <= 10 THEN 'right' WHEN abs(l - r) <= 10 THEN 'center' ELSE 'unknown' END AS alignment FROM m""",
    "dedupe_inputs": "SELECT sha256(text) AS sha256_input, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1",
    "anchor_grade": f"""WITH {_WRAP}, g AS (SELECT doc_id, count(*) AS anchors, count(*) FILTER (x0 >= 0 AND y0 >= 0 AND x1 <= 612 AND y1 <= 792 AND x0 <= x1 AND y0 <= y1) AS in_bounds FROM rects GROUP BY 1),
m AS (SELECT doc_id, page, lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM (SELECT DISTINCT doc_id, page FROM wrapped))
SELECT m.doc_id, coalesce(any_value(g.anchors), 0) AS anchors, coalesce(any_value(g.in_bounds), 0) AS in_bounds, count(*) AS pages, bool_and(before IS NULL OR page > before) AS ascending FROM m LEFT JOIN g ON g.doc_id = m.doc_id GROUP BY m.doc_id""",
    "conversions_page": f"WITH {_WRAP} SELECT doc_id, CAST(max(page) AS BIGINT) AS pages, count(*) FILTER (text <> '') AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM wrapped GROUP BY doc_id ORDER BY chars DESC, doc_id LIMIT 25 OFFSET 10",
}
