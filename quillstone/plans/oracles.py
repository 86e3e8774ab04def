r"""Equivalent DuckDB SQL for the registered queries.

Its regular expressions know only ASCII ``\b`` and have no look-around, so
boundaries are taken on ``t_``, the text with accented Latin letters replaced by
an underscore (a word character no pattern but the e-mail one can contain).
Whitespace is spelled out as ``{S}``.
"""

from __future__ import annotations

from ..dims import (
    BLANK_TYPE, DOC_TYPES, LANGUAGES, NO_TYPE_ICON, OCR_LANGUAGE_SHORTHAND, UNMATCHED_TYPE,
)
from ..operators import language
from ..operators.language import SCALE
from .registry import SHOWN_USER

SPACES = (r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
          r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TRIM_SET = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(pattern: str) -> str:
    return _q(pattern.replace("{S}", SPACES).replace("{MONTH}", MONTH))


def _strip(expr: str) -> str:
    return f"trim({expr}, {TRIM_SET})"


def _blank(expr: str) -> str:
    return f"(coalesce({_strip(expr)}, '') = '')"


def _digits(expr: str) -> str:
    return rf"regexp_replace({expr}, '\P{{Nd}}', '', 'g')"


def _squeeze(expr: str) -> str:
    return _strip(f"regexp_replace({expr}, {_rx('[{S}]+')}, ' ', 'g')")


def _first(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {_rx(pattern)}, 1)"


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_rx(pattern)}, {group})"


def _distinct(values: str, cap: int | None) -> str:
    kept = f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"
    return f"{kept}[1:{cap}]" if cap else kept


FORMS = """forms AS (
SELECT o.o_orderkey AS doc_id, o.o_custkey AS user_id, o.o_orderdate AS created_at,
 'scan.' || k || CASE WHEN o.o_orderkey % 3 = 0 THEN '.PDF' WHEN o.o_orderkey % 3 = 1 THEN '.png' ELSE '.jpeg' END AS filename,
 CASE o.o_orderkey % 8
 WHEN 0 THEN 'INVOICE NO ' || k || chr(10) || 'Customer: ' || p.p_name || chr(10) || 'Due Date: ' || dmy || chr(10) || 'Total Amount: Rs. ' || n4 || '.50' || chr(10) || 'GST 18%' || chr(10) || 'Phone: 98' || n8 || chr(10)
 WHEN 1 THEN 'GOVERNMENT OF INDIA' || chr(10) || 'AADHAAR' || chr(10) || 'Name: ' || p.p_name || chr(10) || 'DOB: ' || dmy || chr(10) || 'Gender: Male' || chr(10) || chr(10) || 'Address:' || chr(10) || 'Flat ' || n4 || ', Sunshine Towers,' || chr(10) || 'Karnataka 560001' || chr(10) || chr(10) || n4 || ' 5678 ' || n4 || chr(10)
 WHEN 2 THEN 'INCOME CARD' || chr(10) || 'Nane: ' || p.p_name || chr(10) || dmy || chr(10) || 'ABCDE' || n4 || 'F' || chr(10) || 'female' || chr(10)
 WHEN 3 THEN 'Dear holder,' || chr(10) || 'kindly write ' || 'u' || k || '@example.com or see https://example.com/d/' || k || ' today' || chr(10) || 'Regards' || chr(10)
 WHEN 4 THEN 'The Principat wi|l c|a|m £' || n4 || ' on the 12° at SCH!OL' || chr(10)
 WHEN 5 THEN CASE WHEN o.o_orderkey % 16 = 5 THEN '' ELSE '  ' || chr(10) END
 WHEN 6 THEN 'Account Number ' || n8 || chr(10) || 'Balance debit credit IFSC statement' || chr(10) || '03 March 2021, April 7, 2022 and ' || dmy || chr(10)
 ELSE 'Note ' || k || ' is plain' END AS text
FROM (SELECT *, cast(o_orderkey AS string) AS k,
  lpad(cast(o_orderkey % 9000 + 1000 AS string), 4, '0') AS n4, lpad(cast(o_orderkey AS string), 8, '0') AS n8,
  lpad(cast(day(o_orderdate) AS string), 2, '0') || '/' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '/' || cast(year(o_orderdate) AS string) AS dmy
  FROM orders) o
JOIN part p ON p.p_partkey = o.o_custkey)"""

CORPUS = FORMS + """, corpus AS (
SELECT 'form' AS src, doc_id, text FROM forms
UNION ALL SELECT 'doc', doc_id, text FROM documents
UNION ALL SELECT 'page', page_id, url || chr(10) || html FROM pages)"""

DAMAGED = """damaged AS (
SELECT doc_id, 'doc.' || doc_id || '.png' AS filename,
 CASE WHEN doc_id % 7 <> 0 THEN text END AS raw_text,
 CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 <> 1 THEN replace(text, 'e', 'E') END AS corrected_text,
 CASE WHEN doc_id % 4 <> 2 THEN lang END AS language,
 CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars % 101 AS DOUBLE) END AS confidence,
 doc_id % 50 AS user_id FROM documents)"""

WORDS = """words AS (
SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page,
 CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_linenumber % 5 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS conf
FROM lineitem)"""

PAGE_CONF = WORDS + """, page_conf AS (
SELECT doc_id, page, coalesce(CAST(printf('%.2f', avg(CASE WHEN conf <> -1 THEN conf END)) AS DOUBLE), 0.0) AS confidence
FROM words GROUP BY ALL)"""

DOC_PAGES = """doc_pages AS (
SELECT conv_id AS doc_id, turn AS page, text, CAST((conv_id * 7 + turn * 13) % 101 AS DOUBLE) AS confidence,
 CASE WHEN (conv_id + turn) % 3 = 0 THEN 'unknown' WHEN (conv_id * 5 + turn) % 3 = 1 THEN 'en' ELSE 'hi' END AS detected_language
FROM conversations)"""

UPLOAD_LOG = """upload_log AS (
SELECT event_id AS doc_id, user_id, ts AS created_at, event_type || '-' || event_id || '.png' AS filename,
 CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 <> 1 THEN 'en' END AS language,
 CASE WHEN event_id % 6 <> 0 THEN value END AS confidence FROM events)"""

ORDER_DOCS = """order_docs AS (
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN -o_custkey - 1 ELSE o_custkey END AS user_id
FROM orders)"""

REQUESTS = """requests AS (
SELECT o_orderkey AS doc_id, o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS user_id FROM orders)"""

STORED = """stored AS (
SELECT doc_id, user_id, filename, text AS raw_text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE text END AS corrected_text FROM forms)"""

EFFECTIVE = "coalesce(nullif(corrected_text, ''), nullif(raw_text, ''), '')"


def _repair(expr: str) -> str:
    """Look-around is unavailable; the consuming form applied twice gives the same text."""
    out = rf"regexp_replace(replace({expr}, '£', '₹'), '(\p{{Nd}}+)°', '\1th', 'g')"
    for letters, repl in (("a-z", "l"), ("A-Z", "I")):
        for _ in range(2):
            out = rf"regexp_replace({out}, '([{letters}])[|!]([{letters}])', '\1{repl}\2', 'g')"
    return out


# Classification: hits per (document, type) as a join, independent of the column form.

KEYWORDS = "keywords(ord, type, icon, keyword) AS (VALUES " + ", ".join(
    f"({i}, {_q(t)}, {_q(icon)}, {_q(word)})"
    for i, (t, icon, kws) in enumerate(DOC_TYPES) for word in kws) + ")"


def _classified(source: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``classified(keys, type, icon, confidence, scores)``."""
    using = f"USING ({keys})"
    return f"""{KEYWORDS}, scored AS (
SELECT {keys}, ord, type, icon, round(least(count(*) / 3.0 * 100, 100.0)::DOUBLE, 1) AS score
FROM (SELECT {keys}, lower({text}) AS l FROM {source}) s JOIN keywords k ON contains(s.l, k.keyword)
GROUP BY ALL), best AS (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, ord) AS rn FROM scored) WHERE rn = 1
), score_text AS (
SELECT {keys}, string_agg(type || '=' || printf('%.1f', score), ';' ORDER BY ord) AS scores FROM scored GROUP BY ALL
), classified AS (
SELECT {', '.join('s.' + k for k in keys.split(', '))},
 CASE WHEN {_blank('s.' + text)} THEN {_q(BLANK_TYPE)} ELSE coalesce(b.type, {_q(UNMATCHED_TYPE)}) END AS type,
 coalesce(b.icon, {_q(NO_TYPE_ICON)}) AS icon, coalesce(b.score, 0.0)::DOUBLE AS confidence,
 coalesce(t.scores, '') AS scores
FROM {source} s LEFT JOIN best b {using} LEFT JOIN score_text t {using})"""


# Key information.

NUMERIC_DATE = r"(?i)\b(\p{Nd}{1,2}[/\-.]\p{Nd}{1,2}[/\-.]\p{Nd}{2,4})\b"
LISTS = {
    "dates": (
        "list_concat(list_concat("
        + _all("t_", NUMERIC_DATE, 1) + ", "
        + _all("t_", r"(?i)\b(\p{Nd}{1,2}[{S}]+{MONTH}[{S}]+\p{Nd}{2,4})\b", 1) + "), "
        + _all("t_", r"(?i)\b({MONTH}[{S}]+\p{Nd}{1,2},?[{S}]+\p{Nd}{2,4})\b", 1) + ")", 5),
    "emails": (
        "list_transform("
        + _all("text", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
        + r", lambda x: regexp_replace(x, '^[.%+\-]+', ''))", 5),
    "phone_numbers": (
        "list_transform(list_filter("
        + _all("text", r"(?:\+?91[{S}\-]?)?(?:[6-9]\p{Nd}{9}|(?:\(?0\p{Nd}{2,4}\)?[{S}\-]?)?\p{Nd}{6,8})")
        + f", lambda x: length({_digits('x')}) >= 7), lambda x: {_strip('x')})", 5),
    "amounts": (
        _all("text", r"(?i)(?:₹|Rs\.?|INR|USD|\$|€|£)[{S}]*[\p{Nd},]+(?:\.\p{Nd}{1,2})?"
                     r"|[\p{Nd},]+(?:\.\p{Nd}{1,2})?[{S}]*(?:₹|Rs\.?|INR)"), 5),
    "pan_numbers": (_all("t_", r"\b[A-Z]{5}\p{Nd}{4}[A-Z]\b"), None),
    "aadhaar_numbers": (_all("t_", r"\b\p{Nd}{4}[{S}]?\p{Nd}{4}[{S}]?\p{Nd}{4}\b"), 2),
    "percentages": (_all("t_", r"\b\p{Nd}+(?:\.\p{Nd}+)?%"), 5),
    "urls": (_all("text", r"""(?i)(?:https?://|www\.)[^{S}<>"']+"""), 3),
}


def _with_t(source: str) -> str:
    return f"(SELECT *, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g') AS t_ FROM {source})"


def _key_info(source: str, keys: str) -> str:
    """CTEs ending in ``ki(keys, <lists>, name, dob, address, gender)``."""
    lists = ", ".join(f"{expr} AS all_{f}" for f, (expr, _) in LISTS.items())
    capped = ", ".join(f"{_distinct('all_' + f, cap)} AS {f}" for f, (_, cap) in LISTS.items())
    name_label = (r"(?i)\b(?:Name|Customer|Client|To|Student|Employee|Holder|Recipient)\b"
                  r"[{S}]*[:\-]?[{S}]*\n?([a-zA-Z][a-zA-Z{S}.]{2,40})\n")
    dob_label = (r"(?i)\b(?:DOB|Date of Birth|Birth Date)\b[{S}]*[:\-]?[{S}]*"
                 r"((?:[0-3]?\p{Nd}[/\-.][0-1]?\p{Nd}[/\-.]\p{Nd}{2,4})"
                 r"|(?:[0-3]?\p{Nd}[{S}]+{MONTH}[{S}]+\p{Nd}{2,4}))")
    above = _strip(f"regexp_replace({_strip('lines[i - 1]')}, {_rx('(?i)^(?:Name|Nane|Nam)[:' + chr(92) + '-{S}]*')}, '')")
    found_above = (
        "coalesce(list_filter(list_transform(list_filter(range(2, len(lines) + 1), "
        f"lambda i: contains(lines[i], dob)), lambda i: {above}), "
        r"lambda c: length(c) > 2 AND NOT regexp_matches(c, '\p{Nd}'))[1], '')")
    listed = "coalesce(phones0, [])"
    return f"""raw_lists AS (SELECT *, {lists} FROM {_with_t(source)}),
lists AS (SELECT * EXCLUDE (phone_numbers), phone_numbers AS phones0 FROM (SELECT {keys}, text, t_, {capped} FROM raw_lists)),
fields AS (SELECT *,
 coalesce(nullif({_strip(_first('t_', name_label))}, ''), {_strip(_first('t_', r'(?i)Government of India[{S}]+([a-zA-Z][a-zA-Z{S}.]{2,40})[{S}]*' + chr(92) + 'n'))}) AS label_name,
 coalesce(nullif({_strip(_first('t_', dob_label))}, ''), nullif({_first('t_', r'(?i)' + chr(92) + r'b(?:Year of Birth|YOB)[{S}]*[:\-]?[{S}]*(\p{Nd}{4})' + chr(92) + 'b')}, ''), dates[1], '') AS dob,
 string_split(text, chr(10)) AS lines,
 coalesce(nullif({_first('t_', r'(?i)' + chr(92) + r'b(?:Gender|Sex)\b[{S}]*[:\-]?[{S}]*(Male|Female|Transgender|M|F)' + chr(92) + 'b')}, ''), {_first('t_', r'(?i)' + chr(92) + 'b(Male|Female)' + chr(92) + 'b')}) AS g,
 {_first('text', r'(?i)((?:s[/\\]o|c[/\\]o|w[/\\]o|d[/\\]o|Address|Add)[:\-{S}]*(?s:.){10,200}?' + chr(92) + r'b\p{Nd}{3}[{S}]?\p{Nd}{3}' + chr(92) + 'b)')} AS addr1,
 {_first('text', r'([A-Za-z0-9{S},.\-/]{20,150}?' + chr(92) + r'b\p{Nd}{3}[{S}]?\p{Nd}{3}' + chr(92) + 'b)')} AS addr2,
 {_first('text', r'(?i)(?:Mobile|Mob|Ph|Phone)[{S}]*[:\-]?[{S}]*(\+?[\p{Nd}{S}\-]{8,15})')} AS mob
 FROM lists),
ki AS (SELECT {keys}, dates, emails,
 CASE WHEN mob <> '' AND NOT list_contains(list_transform({listed}, lambda x: {_digits('x')}), {_digits('mob')})
  THEN list_append({listed}, {_strip('mob')}) ELSE phones0 END AS phone_numbers,
 amounts, pan_numbers, aadhaar_numbers, percentages, urls,
 CASE WHEN label_name = '' AND dob <> '' THEN {found_above} ELSE label_name END AS name,
 dob, {_squeeze("coalesce(nullif(addr1, ''), addr2)")} AS address,
 upper(left(g, 1)) || lower(substr(g, 2)) AS gender FROM fields)"""


LIST_TEXT = ", ".join(
    f"CASE WHEN len({f}) > 0 THEN array_to_string({f}, '|') END AS {f}" for f in LISTS)
FORM_FIELDS = "name, dob, address, gender"


def _list_query(field: str) -> str:
    expr, cap = LISTS[field]
    return f"""WITH {CORPUS}, found AS (
SELECT src, doc_id, {_distinct('v', cap)} AS v FROM (SELECT src, doc_id, {expr} AS v FROM {_with_t('corpus')}))
SELECT src, doc_id, CAST(unnest(range(len(v))) AS INT) AS ord, unnest(v) AS value FROM found"""


KI_CORPUS = f"WITH {CORPUS}, {_key_info('corpus', 'src, doc_id')}"
KI_FORMS = f"WITH {FORMS}, {_key_info('forms', 'doc_id')}"


def _na(expr: str) -> str:
    return f"coalesce(nullif({expr}, ''), 'Not Available')"


AUTOFILL = {
    "name": _na("name"), "dob": _na("dob"), "gender": _na("gender"),
    "phone": "CASE WHEN len(phone_numbers) > 0 THEN phone_numbers[1] ELSE 'Not Available' END",
    "email": "CASE WHEN len(emails) > 0 THEN emails[1] ELSE 'Not Available' END",
    "address": _na("address"),
}

ONE_DECIMAL = "printf('%.1f', CASE WHEN {0} % 1 = 0.25 THEN {0} + 0.05 ELSE {0} END)"

GRAMS = """grams AS (
SELECT doc_id, lang, unnest(list_transform(range(1, length(l) - 1), lambda i: substr(l, i, 3))) AS gram
FROM (SELECT doc_id, lang, lower(text) AS l, text FROM documents) WHERE length(l) >= 3 AND """ + f"NOT {_blank('text')})"
PROFILES = GRAMS + f""", profiles AS (
SELECT lang, gram, count(*) AS cnt FROM grams WHERE lang IS NOT NULL GROUP BY ALL)"""

CODES = ", ".join(f"({_q(n)}, {_q(c)})" for n, c in LANGUAGES)
LANGUAGE_ROWS = f"languages(name, code) AS (VALUES {CODES})"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["scan_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    sql["intake_route"] = """SELECT *, CASE WHEN filename = '' THEN 'No selected file' WHEN length > 10485760 THEN 'File too large (max 10MB)' END AS reject_reason,
 (filename <> '' AND length <= 10485760) AS accepted,
 CASE WHEN filename ILIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS route
FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE string_split(url, '/')[-1] || CASE WHEN page_id % 3 = 1 THEN '.Pdf' ELSE '.png' END END AS filename,
 length(html) * CASE WHEN page_id % 7 = 0 THEN 10000 ELSE 1 END AS length FROM pages)"""
    sql["scan_text_files"] = "SELECT doc_id, CAST(length(text) AS INT) AS n, md5(text) AS text_md5 FROM documents"
    sql["camera_payload_decode"] = """SELECT doc_id AS id, doc_id % 2 = 1 AS handwriting,
 CASE WHEN doc_id % 9 = 0 THEN 'No image data provided' END AS error,
 CASE WHEN doc_id % 9 <> 0 THEN CAST(strlen(text) AS INT) END AS n_bytes,
 CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS bytes_md5 FROM documents"""
    sql["export_txt"] = f"WITH {DAMAGED} SELECT doc_id, md5({EFFECTIVE}) AS text_md5 FROM damaged"
    sql["export_json"] = f"WITH {DAMAGED} SELECT filename, {EFFECTIVE} AS text FROM damaged"
    sql["export_name"] = """SELECT page_id, filename, fmt,
 CASE WHEN fmt <> 'odt' THEN CASE WHEN contains(ltrim(base, '.'), '.') THEN left(filename, length(filename) - instr(reverse(filename), '.')) ELSE filename END || '.' || fmt END AS export_name,
 CASE WHEN fmt = 'odt' THEN 'Invalid format type' END AS error
FROM (SELECT *, string_split(filename, '/')[-1] AS base FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN last || '.tar.gz' WHEN 2 THEN '.h' || last WHEN 3 THEN last || '.' WHEN 4 THEN 'a.b/..x' || last || '.PDF' ELSE 'a.b/' || last END AS filename,
  ['txt', 'json', 'docx', 'pdf', 'odt'][page_id % 5 + 1] AS fmt FROM (SELECT *, string_split(url, '/')[-1] AS last FROM pages)))"""
    sql["export_latin1_text"] = r"SELECT doc_id, regexp_replace(replace(text, 'e', '€'), '[^\x{00}-\x{FF}]', '?', 'g') AS safe_text FROM documents"
    sql["append_documents"] = f"""WITH {DAMAGED} SELECT filename, 2 AS copies, 2 AS ids, 2 AS dated,
 2 * count(*) OVER () AS all_ids, 2 * count(*) OVER () AS last_id,
 md5(coalesce(raw_text, '')) AS raw_md5, md5(coalesce(corrected_text, '')) AS corrected_md5,
 coalesce(language, 'unknown') AS language, coalesce(confidence, 0.0) AS confidence, user_id FROM damaged"""
    sql["image_catalog"] = """SELECT file, height, width, width > 0 AS ok,
 CASE WHEN width > 2000 THEN CAST(trunc(width * (2000.0::DOUBLE / width)) AS INT) WHEN width > 0 THEN width END AS target_w,
 CASE WHEN width > 2000 THEN CAST(trunc(height * (2000.0::DOUBLE / width)) AS INT) WHEN width > 0 THEN height END AS target_h
FROM (SELECT 'img-' || page_id AS file, CASE WHEN page_id % 11 = 0 THEN -1 ELSE CAST(length(url) * 37 + 1 AS INT) END AS height,
 CASE WHEN page_id % 11 = 0 THEN -1 ELSE CAST(length(html) % 60000 + page_id % 50 + 1 AS INT) END AS width FROM pages)"""

    sql["effective_text"] = f"WITH {DAMAGED} SELECT doc_id, {EFFECTIVE} AS text FROM damaged"
    sql["is_blank"] = f"WITH {CORPUS} SELECT src, doc_id, {_blank('text')} AS blank FROM corpus"
    sql["find_document"] = f"""WITH {FORMS}, {REQUESTS}
SELECT r.doc_id, r.user_id, f.filename, CASE WHEN f.doc_id IS NULL THEN 404 ELSE 200 END AS status
FROM requests r LEFT JOIN forms f ON f.doc_id = r.doc_id AND f.user_id = r.user_id"""
    sql["confidence_band"] = f"""WITH {PAGE_CONF}
SELECT doc_id, page, CASE WHEN c > 70 THEN 'green' WHEN c > 40 THEN 'yellow' ELSE 'red' END AS band, {ONE_DECIMAL.format('c')} AS shown
FROM (SELECT doc_id, page, CASE WHEN page <> 2 THEN confidence * 2 ELSE 0.0 END AS c FROM page_conf)"""
    shorthand = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in OCR_LANGUAGE_SHORTHAND.items())
    sql["ocr_language_arg"] = f"""SELECT *, CASE WHEN route = 'pdf' AND endpoint = 'upload' THEN code ELSE CASE code {shorthand} ELSE code END END AS ocr_lang
FROM (SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN ['eng', 'hin', 'guj', 'tel', 'tam'][doc_id % 6 + 1] ELSE lang END AS code,
 CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'image' END AS route, CASE WHEN doc_id % 4 < 2 THEN 'upload' ELSE 'upload-id' END AS endpoint FROM documents)"""
    sql["display_defaults"] = f"""WITH {DAMAGED} SELECT doc_id, coalesce(nullif(raw_text, ''), '(no text detected)') AS raw_text,
 coalesce(nullif(corrected_text, ''), '(no text)') AS corrected_text, coalesce(nullif(language, ''), '–') AS language FROM damaged"""
    fills = ", ".join(f"{expr} AS fill_{f}" for f, expr in AUTOFILL.items())
    sql["autofill_form"] = f"""{KI_FORMS} SELECT doc_id, {fills},
 (name <> '' OR dob <> '' OR gender <> '' OR address <> '' OR len(emails) > 0 OR len(phone_numbers) > 0) AS filled FROM ki"""
    pairs = ", ".join(f"{_q(f)}, {expr}" for f, expr in AUTOFILL.items())
    sql["autofill_json"] = f"{KI_FORMS} SELECT doc_id, CAST(json_object({pairs}) AS VARCHAR) AS form_json FROM ki"
    sql["supported_languages"] = f"""WITH {LANGUAGE_ROWS}
SELECT name, code, count(d.doc_id) AS n_docs FROM languages LEFT JOIN documents d ON d.lang = code GROUP BY name, code"""

    fixed = "replace({0}, 'Principat', 'Principal')"
    for name, expr in (
        ("fix_ocr_artifacts", _repair("text")),
        ("document_specific_fix", fixed.format("text")),
        ("corrected_text", fixed.format(_repair("text"))),
    ):
        sql[name] = f"WITH {CORPUS} SELECT src, doc_id, md5({expr}) AS text_md5 FROM corpus"
    sql["route_lines"] = f"""SELECT *, CASE WHEN {_blank('line')} OR digit_ratio > 0.25 THEN 'keep' ELSE 'correct' END AS action
FROM (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, length({_digits('line')})::DOUBLE / greatest(length(line), 1) AS digit_ratio
FROM (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""
    sql["rejoin_lines"] = "SELECT doc_id, text FROM documents"

    sql["keyword_hits"] = f"""WITH {KEYWORDS} SELECT doc_id, type, keyword
FROM (SELECT doc_id, lower(text) AS l FROM documents) JOIN keywords ON contains(l, keyword)"""
    sql["type_scores"] = f"""WITH {KEYWORDS} SELECT doc_id, type, count(*) AS matched, round(least(count(*) / 3.0 * 100, 100.0)::DOUBLE, 1) AS confidence
FROM (SELECT doc_id, lower(text) AS l FROM documents) JOIN keywords ON contains(l, keyword) GROUP BY ALL"""
    classified = f"WITH {CORPUS}, {_classified('corpus', 'src, doc_id')}"
    sql["classify"] = f"{classified} SELECT * FROM classified"
    sql["classify_relational"] = (
        f"WITH {FORMS}, {_classified('forms', 'doc_id')} SELECT doc_id, type, icon, confidence FROM classified")
    sql["display_classification"] = f"""{classified} SELECT src, doc_id, CASE WHEN type = {_q(BLANK_TYPE)} THEN 'Could not classify document.'
 ELSE icon || ' ' || type || ' ' || printf('%.0f', confidence) || '%' END AS display FROM classified"""

    for name, field in (
        ("extract_dates", "dates"), ("extract_emails", "emails"), ("extract_phones", "phone_numbers"),
        ("extract_amounts", "amounts"), ("extract_pan", "pan_numbers"), ("extract_aadhaar", "aadhaar_numbers"),
        ("extract_percentages", "percentages"), ("extract_urls", "urls"),
    ):
        sql[name] = _list_query(field)
    for field in FORM_FIELDS.split(", "):
        sql[f"form_{field}"] = f"{KI_CORPUS} SELECT src, doc_id, {field} FROM ki"
    sql["labelled_mobile"] = f"""{KI_CORPUS} SELECT src, doc_id, CAST(unnest(range(len(phone_numbers))) AS INT) AS ord, unnest(phone_numbers) AS value FROM ki"""
    sql["extract_key_info"] = f"{KI_CORPUS} SELECT src, doc_id, {LIST_TEXT}, {FORM_FIELDS} FROM ki"
    tidy = [
        f"SELECT src, doc_id, '{f}' AS kind, CAST(unnest(range(len({f}))) AS INT) AS ord, unnest({f}) AS value FROM ki"
        for f in LISTS
    ] + [
        f"SELECT src, doc_id, '{f}', 0, {f} FROM ki WHERE {f} <> ''" for f in FORM_FIELDS.split(", ")
    ]
    sql["key_info_long"] = KI_CORPUS + " " + " UNION ALL ".join(tidy)
    fields = ", ".join(f"k.{f}" for f in FORM_FIELDS.split(", "))
    sql["analyze"] = f"""WITH {FORMS}, {REQUESTS}, {STORED},
chosen AS (SELECT doc_id, user_id, filename, {EFFECTIVE} AS text FROM stored),
{_classified('chosen', 'doc_id')}, {_key_info('chosen', 'doc_id')}
SELECT r.doc_id, r.user_id, CASE WHEN c.doc_id IS NULL THEN 404 ELSE 200 END AS status, c.filename, t.type, t.confidence, {LIST_TEXT}, {fields}
FROM requests r LEFT JOIN chosen c ON c.doc_id = r.doc_id AND c.user_id = r.user_id
LEFT JOIN classified t ON t.doc_id = c.doc_id LEFT JOIN ki k ON k.doc_id = c.doc_id"""

    sql["page_confidence"] = f"WITH {PAGE_CONF} SELECT doc_id, page, confidence FROM page_conf"
    sql["snapshot_confidence"] = f"""WITH {WORDS} SELECT doc_id, page,
 coalesce(CAST(printf('%.1f', avg(CASE WHEN conf > 0 THEN conf END)) AS DOUBLE), 0.0) AS confidence FROM words GROUP BY ALL"""
    sql["document_text"] = f"""WITH {DOC_PAGES} SELECT doc_id, {_strip("string_agg(text, chr(10) || chr(10) ORDER BY page)")} AS text FROM doc_pages GROUP BY doc_id"""
    sql["document_parts"] = f"""WITH {DOC_PAGES}, parts AS (
SELECT doc_id, page // 3 AS part, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM doc_pages GROUP BY ALL)
SELECT doc_id, part, CASE WHEN part = min(part) OVER d AND part = max(part) OVER d THEN trim(text, {TRIM_SET})
 WHEN part = min(part) OVER d THEN ltrim(text, {TRIM_SET}) WHEN part = max(part) OVER d THEN rtrim(text, {TRIM_SET}) ELSE text END AS text
FROM parts WHERE NOT {_blank('text')} WINDOW d AS (PARTITION BY doc_id)"""
    mean = "sum(CAST(confidence AS DECIMAL(28,10)))::DOUBLE / count(*)"
    sql["document_confidence"] = f"WITH {PAGE_CONF} SELECT doc_id, {mean} AS confidence FROM page_conf GROUP BY doc_id"
    doc_lang = """counted AS (SELECT doc_id, detected_language AS lang, count(*) AS n, min(page) AS seen FROM doc_pages WHERE detected_language <> 'unknown' GROUP BY ALL),
doc_lang AS (SELECT d.doc_id, coalesce(c.lang, 'unknown') AS language FROM (SELECT DISTINCT doc_id FROM doc_pages) d LEFT JOIN (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS rn FROM counted) WHERE rn = 1) c USING (doc_id))"""
    sql["document_language"] = f"WITH {DOC_PAGES}, {doc_lang} SELECT * FROM doc_lang"
    sql["multi_page_document"] = f"""WITH {DOC_PAGES}, {doc_lang}, merged AS (
SELECT doc_id, {_strip("string_agg(text, chr(10) || chr(10) ORDER BY page)")} AS raw_text,
 {_strip(f"string_agg({fixed.format(_repair('text'))}, chr(10) || chr(10) ORDER BY page)")} AS corrected_text, {mean} AS confidence FROM doc_pages GROUP BY doc_id)
SELECT o.o_orderkey AS doc_id, m.raw_text, m.corrected_text, m.confidence, l.language, CASE WHEN m.doc_id IS NULL THEN 'PDF contains no pages' END AS error
FROM orders o LEFT JOIN merged m ON m.doc_id = o.o_orderkey LEFT JOIN doc_lang l ON l.doc_id = o.o_orderkey"""
    sql["first_page"] = f"WITH {DOC_PAGES} SELECT doc_id, page, text, confidence, detected_language FROM doc_pages WHERE page = 0 OR (doc_id, page) IN (SELECT doc_id, min(page) FROM doc_pages GROUP BY doc_id HAVING min(page) > 0)"
    sql["best_candidate"] = f"""SELECT doc_id, CASE WHEN length(a) >= length(b) THEN 0 ELSE 1 END AS pref, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS text
FROM (SELECT conv_id * 1000 + turn AS doc_id, {_strip("text")} AS a, {_strip("CASE WHEN turn % 2 = 0 THEN text || chr(10) || role ELSE text END")} AS b FROM conversations)"""

    sql["register_users"] = """WITH asked AS (
SELECT c_name AS username, c_custkey * 4 AS seq FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'new_' || c_custkey, c_custkey * 4 + i + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END FROM customer, range(2) r(i)),
verdict AS (SELECT username, seq, row_number() OVER (PARTITION BY username ORDER BY seq) = 1 AND username NOT IN (SELECT c_name FROM customer) AS ok FROM asked)
SELECT username, seq, CASE WHEN ok THEN 200 ELSE 400 END AS status,
 CASE WHEN ok THEN 'User created successfully' ELSE 'Username already registered' END AS message FROM verdict"""
    sql["documents_with_owner"] = f"WITH {ORDER_DOCS} SELECT d.user_id, d.doc_id, c.c_name AS username FROM order_docs d LEFT JOIN customer c ON c.c_custkey = d.user_id"
    sql["owned_documents"] = f"WITH {ORDER_DOCS} SELECT user_id, doc_id FROM order_docs WHERE user_id IN (SELECT c_custkey FROM customer)"

    sql["history"] = f"WITH {UPLOAD_LOG} SELECT * FROM upload_log WHERE user_id = {SHOWN_USER} ORDER BY created_at DESC, doc_id DESC"
    sql["history_top30"] = sql["history"] + " LIMIT 30"
    sql["history_top30_all"] = f"""WITH {UPLOAD_LOG} SELECT user_id, CAST(rn AS INT) AS rank, doc_id FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, doc_id DESC) AS rn FROM upload_log) WHERE rn <= 30"""
    shown = ONE_DECIMAL.format("coalesce(confidence, 0.0)")
    sql["history_view"] = f"""WITH {UPLOAD_LOG} SELECT doc_id, user_id, filename, coalesce(nullif(language, ''), '–') AS language,
 strftime(created_at, '%Y-%m-%d %H:%M:%S') AS uploaded, {shown} || '%' AS confidence FROM upload_log"""

    sql["language_profiles"] = f"WITH {PROFILES} SELECT lang, gram, cnt FROM profiles"
    h = "0::BIGINT"
    for i in range(1, language.GRAM + 1):
        h = f"(({h}) * {language.BASE} + ord(substr(gram, {i}, 1))) % {language.PRIME}"
    sql["detect_language"] = f"""WITH {PROFILES}, p AS (SELECT lang, ({h}) % {language.BUCKETS} AS b, sum(cnt) AS cnt FROM profiles GROUP BY ALL),
totals AS (SELECT lang, sum(cnt) AS total FROM p GROUP BY lang),
model AS (SELECT g.b, t.lang, CAST(round(ln((coalesce(p.cnt, 0) + 1) / (t.total + (SELECT count(DISTINCT b) FROM p))::DOUBLE) * {SCALE}) AS BIGINT) AS w
 FROM (SELECT DISTINCT b FROM p) g CROSS JOIN totals t LEFT JOIN p ON p.b = g.b AND p.lang = t.lang),
scored AS (SELECT doc_id, m.lang, sum(w) AS s FROM (SELECT doc_id, ({h}) % {language.BUCKETS} AS b FROM grams) JOIN model m USING (b) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS rn FROM scored) WHERE rn = 1)
SELECT d.doc_id, coalesce(b.lang, 'unknown') AS detected_language FROM documents d LEFT JOIN best b USING (doc_id)"""
    sql["translation_requests"] = f"""WITH {CORPUS}, {LANGUAGE_ROWS}
SELECT src, doc_id, target, l.name AS target_name, l.name IS NOT NULL AS supported, NOT blank AND length(text) > 4500 AS truncated,
 CASE WHEN blank THEN 'No text to translate' END AS error, CASE WHEN NOT blank THEN CAST(least(length(text), 4500) AS INT) END AS chunk_chars,
 CASE WHEN NOT blank THEN md5(left(text, 4500)) END AS chunk_md5
FROM (SELECT *, ['hi', 'zh-CN', 'xx'][doc_id % 3 + 1] AS target, {_blank('text')} AS blank FROM corpus) LEFT JOIN languages l ON l.code = target"""

    sql["translate_document"] = f"""WITH {FORMS}, {REQUESTS}, {STORED}, found AS (
SELECT r.doc_id, r.user_id, CASE WHEN r.doc_id % 2 = 0 THEN 'ta' ELSE 'xx' END AS target, s.doc_id IS NOT NULL AS hit, {EFFECTIVE} AS text
FROM requests r LEFT JOIN stored s ON s.doc_id = r.doc_id AND s.user_id = r.user_id)
SELECT doc_id, user_id, target, CASE WHEN NOT hit THEN 404 WHEN {_blank('text')} THEN 500 ELSE 200 END AS status,
 CASE WHEN hit AND {_blank('text')} THEN 'No text to translate' END AS error, target = 'ta' AS supported,
 length(text) > 4500 AS truncated, CASE WHEN NOT {_blank('text')} THEN left(text, 4500) END AS chunk FROM found"""
    sql["export_document"] = f"""WITH {FORMS}, {REQUESTS}, {STORED}, found AS (
SELECT r.doc_id, r.user_id, ['txt', 'json', 'odt'][r.doc_id % 3 + 1] AS fmt, s.doc_id IS NOT NULL AS hit, filename, {EFFECTIVE} AS text
FROM requests r LEFT JOIN stored s ON s.doc_id = r.doc_id AND s.user_id = r.user_id)
SELECT doc_id, user_id, fmt, CASE WHEN NOT hit THEN 404 WHEN fmt = 'odt' THEN 400 ELSE 200 END AS status,
 CASE WHEN hit AND fmt <> 'odt' THEN 'scan.' || doc_id || '.' || fmt END AS export_name,
 CASE WHEN hit AND fmt <> 'odt' THEN text END AS text FROM found"""

    repaired = fixed.format(_repair("text"))
    def uploads(files: str, texts: str, error: str) -> str:
        return f"""{texts}, {_classified('repaired', 'doc_id')}, {_key_info('repaired', 'doc_id')},
e AS (SELECT r.doc_id, r.raw_text, r.text AS corrected_text, r.language, r.score, c.type, c.confidence, {LIST_TEXT}, {fields}
FROM repaired r JOIN classified c USING (doc_id) JOIN ki k USING (doc_id))
SELECT u.doc_id, user_id, filename, {error} AS reject_reason, md5(raw_text) AS raw_md5, md5(corrected_text) AS corrected_md5,
 language, score, e.* EXCLUDE (doc_id, raw_text, corrected_text, language, score)
FROM {files} u LEFT JOIN e ON e.doc_id = u.doc_id AND {refused} IS NULL"""

    refused = "CASE WHEN filename = '' THEN 'No selected file' WHEN length > 10485760 THEN 'File too large (max 10MB)' END"
    for name in ("stream_enrich", "enrich_uploads"):
        sql[name] = uploads("""(SELECT doc_id, doc_id % 50 AS user_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'scan-' || doc_id || '.png' END AS filename,
 n_chars * CASE WHEN doc_id % 7 = 0 THEN 10000 ELSE 1 END AS length FROM documents)""", f"""WITH repaired AS (
SELECT doc_id, text AS raw_text, {repaired} AS text, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE 'unknown' END AS language,
 CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 101)::DOUBLE ELSE 0.0 END AS score FROM documents)""", refused)
    paged = """(SELECT *, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'scan.' || doc_id || '.pdf' END AS filename, abs(doc_id) % 50 AS user_id,
 abs(doc_id) * 7919 % 12000000 AS length FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations UNION ALL SELECT -1 - n_nationkey FROM nation))"""
    for name, kept in (("process_uploads", "true"), ("process_id_uploads", "page = first")):
        sql[name] = uploads(paged, f"""WITH {DOC_PAGES.replace('doc_pages AS', 'every_page AS', 1)}, doc_pages AS (
SELECT * FROM (SELECT *, min(page) OVER (PARTITION BY doc_id) AS first FROM every_page) WHERE {kept}), {doc_lang},
repaired AS (SELECT doc_id, {_strip("string_agg(text, chr(10) || chr(10) ORDER BY page)")} AS raw_text,
 {_strip(f"string_agg({fixed.format(_repair('text'))}, chr(10) || chr(10) ORDER BY page)")} AS text,
 any_value(language) AS language, {mean} AS score FROM doc_pages JOIN doc_lang USING (doc_id) GROUP BY doc_id)""",
            f"coalesce({refused}, CASE WHEN e.doc_id IS NULL THEN 'PDF contains no pages' END)")
    for name, processed in (("stream_store", "enrich_uploads"), ("store_uploads", "process_uploads")):
        sql[name] = f"""SELECT count(*) OVER () AS all_ids, count(*) OVER () AS last_id, count(*) OVER () AS dated,
 filename, user_id, raw_md5, corrected_md5, language, score FROM ({sql[processed]}) WHERE reject_reason IS NULL"""
    sql["camera_results"] = f"""WITH b AS ({sql['best_candidate']}), s AS ({sql['snapshot_confidence']})
SELECT b.doc_id, {fixed.format(_repair('b.text'))} AS text, b.text AS raw_text, coalesce(s.confidence, 0.0) AS confidence
FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.page = b.pref"""
    sql["insert_users"] = """WITH n AS (SELECT count(*) AS n FROM customer), t AS (
SELECT c_name AS username, 1 AS copies FROM customer UNION ALL SELECT 'new_' || c_custkey, 1 FROM customer)
SELECT username, copies, 2 * n AS all_ids, n AS first_accepted, 0 AS second_accepted FROM t, n"""
    sql["translation_parts"] = f"""WITH {CORPUS} SELECT src, doc_id, CAST(i AS INT) AS chunk_no, md5(substr(text, i * 4500 + 1, 4500)) AS chunk_md5
FROM (SELECT src, doc_id, text, unnest(range((length(text) + 4499) // 4500)) AS i FROM corpus WHERE NOT {_blank('text')})"""
    return sql
