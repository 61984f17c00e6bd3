"""SQL counterparts of the registered queries, for another engine to check the results.

They are written in long form (one row per line, leaf or rule) instead of arrays, so they
share no code path with the operators.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from foliograde import fixed_values as fv
from foliograde import schemas
from foliograde.plans.catalog import JOB_STAMP
from foliograde.plans.inputs import FILE_EXTENSIONS

SQL: dict[str, str] = {}


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.500001::DOUBLE) / 1000000.0::DOUBLE"


def r2(x: str) -> str:
    return f"floor(({x}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"


def pattern(java: str) -> str:
    """A fixed pattern in the other engine's dialect, which has plain word boundaries only."""
    plain = java.replace(fv.WORD_EDGE, r"\b").replace(r"\x85", r"\x{85}")
    return text_literal(plain)


def with_ctes(names: list[str], body: str) -> str:
    """The statement preceded by the named common tables and all that they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in CTE:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", CTE[name]):
                add(other)
        needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in needed) + "\n" + body


def put(name: str, body: str) -> None:
    used = [n for n in CTE if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", body)]
    SQL[name] = with_ctes(used, body) if used else body


BLANK = r"^[\s\p{Z}\x0B\x1C-\x1F\x{85}]*$"
CLEAN = lambda t: (
    f"regexp_replace(regexp_replace({t}, {pattern(fv.WHITESPACE + '+')}, ' ', 'g'), "
    f"{pattern(fv.DELETED_BY_CLEANING)}, '', 'g')")
WORDS = lambda t: f"len(regexp_extract_all({t}, {pattern(fv.NOT_WHITESPACE + '+')}))"

CTE: dict[str, str] = {}

# --- orders as documents ------------------------------------------------------------------

CTE["priced"] = f"""
  SELECT l.*, p_name, p_size, s_name, n_name AS s_nation,
    {r2('l_extendedprice * (1 - l_discount)')} AS total_price,
    {r2('l_extendedprice / l_quantity')} AS unit_price
  FROM lineitem l
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey"""

CTE["lines"] = f"""
  SELECT *, {r2('total_price * l_tax')} AS line_tax,
    l_orderkey::VARCHAR AS doc_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS pos
  FROM priced"""

CTE["bodies"] = f"""
  SELECT l_orderkey, count(*) AS n_lines, {r2('sum(total_price ORDER BY pos)')} AS goods,
    {r2('sum(line_tax ORDER BY pos)')} AS tax, min(s_name) AS v_name, arg_min(s_nation, s_name) AS v_nation,
    arg_min(l_suppkey, s_name) AS v_key,
    string_agg(p_name || ' x' || l_quantity::BIGINT || ' at ' || format('{{:,.2f}}', unit_price) || ' = '
      || format('{{:,.2f}}', total_price), '; ' ORDER BY pos) AS rows_text,
    string_agg('take ' || p_name || ' ' || CASE WHEN p_size % 7 = 0 THEN 'drops' ELSE p_size || ' mg' END
      || ' twice daily for ' || l_quantity::BIGINT || ' days', '; ' ORDER BY pos) AS doses_text
  FROM lines GROUP BY l_orderkey"""

CTE["notes"] = """
  SELECT doc_id * 9 AS n_key, text AS note FROM documents
  UNION ALL SELECT doc_id * 5, text FROM documents WHERE (doc_id * 5) % 9 <> 0"""

CTE["docs"] = """
  SELECT o_orderkey AS o, o_totalprice, o_orderdate, c_custkey, c_name, c_mktsegment, n_name AS c_nation,
    note, coalesce(n_lines, 0) AS n_lines, coalesce(goods, 0.0) AS goods, coalesce(tax, 0.0) AS tax,
    v_name, v_nation, v_key, coalesce(rows_text, '') AS rows_text, coalesce(doses_text, '') AS doses_text,
    o_orderkey::VARCHAR AS doc_id,
    CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'medical_bill' ELSE 'prescription' END AS kind,
    strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE WHEN o_orderkey % 4 = 0 THEN 1.0 WHEN o_orderkey % 4 = 1 THEN 0.8
      ELSE (o_orderkey * 7 % 41) / 40.0 END::DOUBLE AS quality
  FROM orders LEFT JOIN bodies ON o_orderkey = l_orderkey LEFT JOIN notes ON o_orderkey = n_key
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""

CTE["invoices0"] = f"""
  SELECT *, CASE WHEN o % 17 = 0 THEN NULL WHEN o % 19 = 0 THEN '   ' ELSE 'INV-' || o END AS invoice_number,
    CASE WHEN o % 13 = 0 THEN 'n/a' ELSE day END AS date,
    strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due_date,
    CASE WHEN o % 23 <> 0 THEN v_name END AS vendor_name, v_nation AS vendor_address,
    c_name AS customer_name, c_nation AS customer_address,
    goods + CASE WHEN o % 11 = 0 THEN 1.0 ELSE 0.0 END AS subtotal,
    CASE WHEN o % 7 <> 0 THEN tax END AS tax_amount, 'USD' AS currency
  FROM docs WHERE kind = 'invoice'"""

CTE["invoice"] = f"""
  SELECT *, CASE WHEN o % 29 <> 0 THEN {r2('goods + coalesce(tax_amount, 0.0)')}
    + CASE WHEN o % 10 = 0 THEN 5.0 ELSE 0.0 END END AS total_amount FROM invoices0"""

CTE["medical0"] = """
  SELECT *, CASE WHEN o % 31 = 0 THEN -o_totalprice ELSE o_totalprice END AS t0 FROM docs
  WHERE kind = 'medical_bill'"""

CTE["medical1"] = f"""
  SELECT *, CASE WHEN o % 5 <> 0 THEN {r2('t0 * 0.25')} END AS amount_paid FROM medical0"""

CTE["medical_bill"] = f"""
  SELECT *, CASE WHEN o % 41 <> 0 THEN c_name END AS patient_name, 'P' || c_custkey AS patient_id,
    CASE WHEN o % 13 <> 0 THEN 'Hospital ' || c_nation END AS hospital_name, c_nation AS hospital_address,
    CASE WHEN o % 17 = 0 THEN 'soon' ELSE day END AS bill_date, day AS service_date, v_name AS doctor_name,
    c_mktsegment AS insurance_info, CASE WHEN o % 37 <> 0 THEN t0 END AS total_amount,
    CASE WHEN o % 8 <> 0 THEN {r2('t0 - coalesce(amount_paid, 0.0)')}
      + CASE WHEN o % 7 = 0 THEN 1.0 ELSE 0.0 END END AS balance_due, 'USD' AS currency
  FROM medical1"""

CTE["prescription"] = """
  SELECT *, CASE WHEN o % 41 <> 0 THEN c_name END AS patient_name, (c_custkey % 60 + 20)::VARCHAR AS patient_age,
    c_nation AS patient_address, CASE WHEN o % 23 <> 0 THEN v_name END AS doctor_name,
    'LIC' || v_key AS doctor_license, 'Clinic ' || v_nation AS clinic_name, v_nation AS clinic_address,
    CASE WHEN o % 13 = 0 THEN strftime(o_orderdate, '%Y.%m.%d')
      ELSE day(o_orderdate) || strftime(o_orderdate, ' %B %Y') END AS prescription_date,
    c_mktsegment AS diagnosis, NULL::VARCHAR AS notes
  FROM docs WHERE kind = 'prescription'"""

CTE["line_items"] = """
  SELECT doc_id, pos, p_name AS description, l_quantity AS quantity, unit_price, total_price,
    0.0::DOUBLE AS confidence FROM lines WHERE l_orderkey % 3 <> 2"""

CTE["medicines"] = """
  SELECT doc_id, pos, p_name AS name, CASE WHEN p_size % 7 = 0 THEN 'drops' ELSE p_size || ' mg' END AS dosage,
    'twice daily' AS frequency, l_quantity::BIGINT || ' days' AS duration, 0.0::DOUBLE AS confidence
  FROM lines WHERE l_orderkey % 3 = 2"""

_money = lambda c: f"coalesce(format('{{:,.2f}}', {c}), '')"
_said = lambda *cs: " || ".join(c if c.startswith("'") else f"coalesce({c}, '')" for c in cs)

CTE["own_texts"] = f"""
  SELECT doc_id, {_said("'Invoice '", "invoice_number", "'\nDate: '", "day", "' Due: '", "due_date",
                        "'\nVendor: '", "vendor_name", "', '", "vendor_address", "'\nCustomer: '",
                        "customer_name", "'\nLine items: '", "rows_text", "'\nSubtotal '", _money("subtotal"),
                        "' Tax '", _money("tax_amount"), "'\nTotal USD '", _money("total_amount"))} AS own
  FROM invoice
  UNION ALL SELECT doc_id, {_said("hospital_name", "'\nHospital bill, service date '", "service_date",
                                  "'\nPatient: '", "patient_name", "' ('", "patient_id", "')\nInsurance: '",
                                  "insurance_info", "'\nTreatment: '", "rows_text", "'\nTotal '",
                                  _money("total_amount"), "' paid '", _money("amount_paid"), "' balance '",
                                  _money("balance_due"))} FROM medical_bill
  UNION ALL SELECT doc_id, {_said("'Prescription '", "prescription_date", "'\nDoctor: '", "doctor_name", "' '",
                                  "doctor_license", "'\n'", "clinic_name", "'\nPatient: '", "patient_name",
                                  "', age '", "patient_age", "'\nMedication: '", "doses_text",
                                  "'\nDiagnosis '", "diagnosis")} FROM prescription"""

CTE["texts"] = """
  SELECT d.doc_id, o, kind, CASE WHEN o % 9 = 0 THEN coalesce(note, '')
    WHEN note IS NULL THEN own ELSE own || chr(10) || note END AS text
  FROM docs d JOIN own_texts t ON d.doc_id = t.doc_id"""

# --- leaves ----------------------------------------------------------------------------------


def _leaf_rows(schema: T.StructType, source: str) -> str:
    rows = []
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.ArrayType):
            for j, g in enumerate(f.dataType.elementType.fields):
                rows.append(
                    f"SELECT e.doc_id, {i} AS o1, e.pos AS o2, {j} AS o3, '{f.name}[' || e.pos || '].{g.name}' AS path, "
                    f"'{g.name}' AS key, e.{g.name}::VARCHAR AS value FROM {f.name} e JOIN {source} s ON e.doc_id = s.doc_id")
        else:
            rows.append(f"SELECT doc_id, {i} AS o1, 0 AS o2, 0 AS o3, '{f.name}' AS path, '{f.name}' AS key, "
                        f"{f.name}::VARCHAR AS value FROM {source}")
    return "\n  UNION ALL ".join(rows)


for _name, _schema in schemas.RECORD_TYPES.items():
    CTE[f"{_name}_leaves"] = "\n  " + _leaf_rows(_schema, _name)

CTE["leaves"] = "\n  UNION ALL ".join(
    f"SELECT *, '{t}' AS doc_type FROM {t}_leaves WHERE value IS NOT NULL AND trim(value) <> ''" for t in fv.DOC_TYPES)


def evidence(value: str, lower_text: str) -> str:
    words = f"regexp_extract_all(lower({value}), {pattern(fv.NOT_WHITESPACE + '+')})"
    hits = f"len(list_filter({words}, lambda w: contains({lower_text}, w)))"
    return (f"CASE WHEN {value} IS NULL OR {value} = '' OR {lower_text} IS NULL OR {lower_text} = '' THEN 0.0::DOUBLE "
            f"WHEN contains({lower_text}, lower({value})) THEN 0.9 "
            f"WHEN {hits} > 0 THEN 0.7::DOUBLE * ({hits} / len({words})) ELSE 0.3 END")


CTE["lowered"] = "SELECT doc_id, lower(text) AS lt FROM texts"

CTE["supported"] = f"""
  SELECT l.*, row_number() OVER (PARTITION BY l.doc_id ORDER BY o1, o2, o3) - 1 AS pos,
    CASE WHEN key = 'confidence' THEN value::DOUBLE ELSE {evidence('value', 'lt')} END AS llm_conf
  FROM leaves l JOIN lowered t ON l.doc_id = t.doc_id"""

# --- rules --------------------------------------------------------------------------------------

_present = lambda c: f"({c} IS NOT NULL AND trim({c}) <> '')"
_date = lambda c: f"({_present(c)} AND regexp_matches({c}, {pattern('|'.join(fv.DATE_RULE_PATTERNS))}))"
_odd_date = lambda c: f"CASE WHEN {_present(c)} AND NOT {_date(c)} THEN 'Unusual date format: ' || {c} END"
_bad_items = "(n_lines = 0)"

_RULE_SQL = {
    fv.INVOICE: [
        ("invoice_number_present", _present("invoice_number"), "NULL"),
        ("total_amount_valid", "total_amount >= 0", "NULL"),
        ("line_items_total_match",
         "n_lines > 0 AND (total_amount IS NULL OR abs(goods + coalesce(tax_amount, 0) - total_amount) <= 0.01)",
         "CASE WHEN n_lines > 0 AND abs(goods - subtotal) > 0.01 THEN 'Line items total (' || format('{:.2f}', goods) "
         "|| ') doesn''t match subtotal (' || format('{:.2f}', subtotal) || ')' END"),
        ("vendor_name_present", _present("vendor_name"), "NULL"),
        ("date_format_valid", _date("date"), _odd_date("date")),
    ],
    fv.MEDICAL_BILL: [
        ("patient_name_present", _present("patient_name"), "NULL"),
        ("hospital_name_present", _present("hospital_name"), "NULL"),
        ("total_amount_valid", "total_amount >= 0", "NULL"),
        ("bill_date_valid", _date("bill_date"), _odd_date("bill_date")),
        ("balance_calculation_valid",
         "total_amount IS NOT NULL AND (balance_due IS NULL OR "
         "abs(total_amount - coalesce(amount_paid, 0) - balance_due) <= 0.01)", "NULL"),
    ],
    fv.PRESCRIPTION: [
        ("patient_name_present", _present("patient_name"), "NULL"),
        ("doctor_name_present", _present("doctor_name"), "NULL"),
        ("medicines_present", "n_lines > 0", "NULL"),
        ("prescription_date_valid", _date("prescription_date"), _odd_date("prescription_date")),
        ("medicine_dosages_valid", "true", "NULL"),
    ],
}

CTE["rules"] = "\n  UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS doc_type, {i} AS pos, '{name}' AS rule, "
    f"CASE WHEN coalesce({check}, false) THEN 'passed' ELSE 'failed' END AS outcome, ({warn})::VARCHAR AS warning FROM {t}"
    for t, rules in _RULE_SQL.items() for i, (name, check, warn) in enumerate(rules))

CTE["rule_warnings"] = f"""
  SELECT doc_id, pos, 0 AS sub, warning FROM rules WHERE warning IS NOT NULL
  UNION ALL SELECT doc_id, 4, pos, 'Medicine ' || (pos + 1) || ' has unusual dosage format: ' || dosage
  FROM medicines WHERE NOT regexp_matches(dosage, {pattern(fv.DOSAGE_PATTERN)})"""

CTE["warned"] = "SELECT doc_id, pos, count(*) AS n FROM rule_warnings GROUP BY doc_id, pos"

CTE["rule_counts"] = """
  SELECT doc_id, any_value(doc_type) AS doc_type, count(*) FILTER (outcome = 'passed') AS passed,
    count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (outcome = 'failed' AND regexp_matches(rule, 'total|amount|balance|required|present')) AS critical,
    coalesce(string_agg(rule, ',' ORDER BY pos) FILTER (outcome = 'passed'), '') AS passed_rules,
    coalesce(string_agg(rule, ',' ORDER BY pos) FILTER (outcome = 'failed'), '') AS failed_rules
  FROM rules GROUP BY doc_id"""

CTE["warning_counts"] = "SELECT doc_id, sum(n)::BIGINT AS warnings FROM warned GROUP BY doc_id"


def note(passed: str, failed: str, warnings: str) -> str:
    return (f"{passed} || ' validation rules passed' || CASE WHEN {failed} > 0 THEN ', ' || {failed} || ' failed' ELSE '' END "
            f"|| CASE WHEN {warnings} > 0 THEN ', ' || {warnings} || ' warnings' ELSE '' END "
            f"|| CASE WHEN {failed} > 0 THEN ' - Document has validation issues' "
            f"WHEN {warnings} > 0 THEN ' - Document valid with minor warnings' ELSE ' - Document appears valid' END")


CTE["checked"] = f"""
  SELECT r.*, coalesce(warnings, 0) AS warnings, {note('passed', 'failed', 'coalesce(warnings, 0)')} AS notes
  FROM rule_counts r LEFT JOIN warning_counts w ON r.doc_id = w.doc_id"""

# --- scores -----------------------------------------------------------------------------------------

CTE["statuses"] = """
  SELECT f.*, CASE WHEN contains(failed_rules, lower(key)) THEN 'false'
    WHEN contains(passed_rules, lower(key)) THEN 'true' ELSE 'none' END AS status
  FROM supported f JOIN rule_counts r ON f.doc_id = r.doc_id"""


def score(llm: str, ocr: str, val: str, status: str = "status") -> str:
    checked = f"CASE {status} WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0 ELSE 0.7 END"
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {llm}::DOUBLE * llm_conf + {ocr}::DOUBLE * quality "
            f"+ {val}::DOUBLE * ({checked})))")


CTE["scored"] = f"""
  SELECT s.*, quality, {score('0.6', '0.2', '0.2')} AS confidence
  FROM statuses s JOIN docs d ON s.doc_id = d.doc_id"""


def overall(base: str, critical: str, method: str) -> str:
    lowered = f"(({base}) * (1.0::DOUBLE - least(0.3::DOUBLE, {critical} * 0.1::DOUBLE)))"
    return (f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE {method} WHEN 'llm_structured' THEN {lowered} * 1.05::DOUBLE "
            f"WHEN 'fallback_json' THEN {lowered} * 0.8::DOUBLE ELSE {lowered} END))")


CTE["means"] = """
  SELECT doc_id, count(*) AS field_count, avg(confidence) AS avg_conf,
    count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
    count(*) FILTER (confidence < 0.5) AS low, min(confidence) AS min_c, max(confidence) AS max_c,
    stddev_pop(confidence) AS std_c
  FROM scored GROUP BY doc_id"""

CTE["results"] = f"""
  SELECT c.*, coalesce(field_count, 0) AS field_count, coalesce(avg_conf, 0.5) AS avg_conf, high, medium, low,
    min_c, max_c, std_c, {overall('coalesce(avg_conf, 0.5)', 'critical', "'llm_structured'")} AS overall
  FROM checked c LEFT JOIN means m ON c.doc_id = m.doc_id"""

# --- files, sinks, streams ----------------------------------------------------------------------------

_cases = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(FILE_EXTENSIONS))
CTE["files"] = f"""
  SELECT page_id, ext, 'page.v' || page_id || ext AS filename, '/in/page.v' || page_id || ext AS path, size_bytes,
    CASE WHEN ext = '' THEN '.v' || page_id ELSE lower(ext) END AS extension
  FROM (SELECT page_id, CASE page_id % {len(FILE_EXTENSIONS)} {_cases} END AS ext,
        length(html)::BIGINT * 3001 AS size_bytes FROM pages)"""

_images = ", ".join(f"'{e}'" for e in fv.IMAGE_EXTENSIONS)
put("file_info", f"""
SELECT path, filename, size_bytes, round_even(size_bytes / 1048576.0::DOUBLE, 2) AS size_mb, extension,
  extension = '.pdf' AS is_pdf, extension IN ({_images}) AS is_image FROM files""")
put("file_kind", f"""
SELECT path, extension, CASE WHEN extension = '.pdf' THEN 'pdf' WHEN extension IN ({_images}) THEN 'image'
  ELSE 'unsupported' END AS kind FROM files""")
put("result_name", f"""
SELECT path, CASE WHEN ext = '' THEN 'page' ELSE 'page.v' || page_id END || '_' ||
  CASE page_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'medical_bill' ELSE 'prescription' END
  || '_{JOB_STAMP}.json' AS result_name FROM files""")
put("result_roundtrip", f"""
SELECT doc_id, doc_type, {r6('overall')} AS overall_confidence, field_count AS fields, failed_rules FROM results""")

# --- text and pages ----------------------------------------------------------------------------------------

put("clean_text", f"SELECT doc_id, trim({CLEAN('text')}) AS text FROM documents")
put("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS routing_text,
  left(text, 4000) AS extraction_text, left(text, 2000) AS fallback_text FROM documents""")

CTE["convo"] = "SELECT conv_id AS doc_id, turn + 1 AS page_num, text FROM conversations"
CTE["whole"] = f"""
  SELECT doc_id, count(*) AS pages,
    {CLEAN("string_agg(chr(10) || '--- Page ' || page_num || ' ---' || chr(10) || text || chr(10), '' ORDER BY page_num)")} AS t
  FROM convo GROUP BY doc_id"""
put("assemble_pages", """
SELECT doc_id, 0::BIGINT AS segment, pages, trim(t) AS text,
  (length(t) - length(rtrim(t)))::BIGINT AS tail_blanks FROM whole""")
put("page_metadata", f"""
SELECT doc_id, page_num, length(text) AS text_length, {WORDS('text')} AS word_count FROM convo""")
CTE["scan_check"] = f"""
  SELECT doc_id, length(trim({CLEAN("string_agg(CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END, '' ORDER BY page_num)")}))
    / count(*) AS density FROM convo WHERE page_num <= 3 GROUP BY doc_id"""
CTE["scans"] = """
  SELECT d.doc_id, density, coalesce(density < 50, true) AS scanned
  FROM documents d LEFT JOIN scan_check s ON d.doc_id = s.doc_id"""
put("detect_scanned", f"""
SELECT doc_id, {r6('density')} AS chars_per_page, scanned,
  CASE WHEN scanned THEN 'ocr' ELSE 'text' END AS text_source FROM scans""")

CTE["tokens"] = """
  SELECT doc_id, page_num, pos, word, (length(word) * 37 + pos * 13) % 111 - 10 AS conf FROM (
    SELECT doc_id, page_num, unnest(string_split(text, ' ')) AS word,
      generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM convo)"""
CTE["ocr"] = "SELECT doc_id, page_num, CASE WHEN (doc_id * 7 + page_num) % 23 = 0 THEN 'engine timeout' END AS error FROM convo"
CTE["token_stats"] = f"""
  SELECT doc_id, page_num, count(*) AS n, length(string_agg(word, ' ' ORDER BY pos)) AS chars,
    string_agg(word, ' ' ORDER BY pos) AS text, avg(conf) FILTER (conf > 0) AS mean
  FROM tokens WHERE NOT regexp_matches(word, {text_literal(BLANK)}) GROUP BY doc_id, page_num"""
CTE["page_quality"] = """
  SELECT o.doc_id, o.page_num, error, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END AS word_count,
    CASE WHEN error IS NULL THEN coalesce(chars, 0) ELSE 0 END AS text_length,
    CASE WHEN error IS NULL THEN coalesce(mean, 0) ELSE 0 END AS mean,
    CASE WHEN error IS NULL THEN coalesce(text, '') ELSE '[OCR failed: ' || error || ']' END AS text
  FROM ocr o LEFT JOIN token_stats t ON o.doc_id = t.doc_id AND o.page_num = t.page_num"""
put("ocr_page_stats", f"""
SELECT doc_id, page_num, word_count, text_length, {r6('mean')} AS avg_confidence,
  {r6('mean / 100.0::DOUBLE')} AS confidence, error FROM page_quality""")
put("ocr_page_text", "SELECT doc_id, page_num, 0::BIGINT AS part, text FROM page_quality")
CTE["doc_quality"] = "SELECT doc_id, sum(mean / 100.0::DOUBLE) / count(*) AS q FROM page_quality GROUP BY doc_id"
put("ocr_quality", f"""
SELECT s.doc_id, CASE WHEN scanned THEN 'ocr' ELSE 'text' END AS text_source,
  {r6("CASE WHEN NOT scanned THEN 1.0::DOUBLE ELSE coalesce(q, 0.8) END")} AS ocr_quality
FROM scans s LEFT JOIN doc_quality d ON s.doc_id = d.doc_id""")

CTE["page_docs"] = f"""
  SELECT c.doc_id, q, density, c.doc_id % 5 <> 0 AS routed, c.doc_id % 3 AS kind, c.doc_id // 3 % 4 AS shape
  FROM (SELECT DISTINCT doc_id FROM convo) c LEFT JOIN scan_check s ON c.doc_id = s.doc_id
  LEFT JOIN doc_quality d ON c.doc_id = d.doc_id"""
put("pages_to_results", f"""
SELECT doc_id, CASE WHEN NOT routed THEN 'unknown' WHEN kind = 0 THEN 'invoice' WHEN kind = 1 THEN 'medical_bill'
    ELSE 'prescription' END AS doc_type,
  {r6("CASE WHEN density >= 50 THEN 1.0::DOUBLE ELSE coalesce(q, 0.8) END")} AS ocr_quality,
  CASE WHEN routed AND shape < 2 THEN 'llm_structured' WHEN routed AND shape = 2 THEN 'fallback_json' ELSE 'failed' END AS extraction_method,
  {r6("CASE WHEN routed THEN 0.75::DOUBLE ELSE 0.0 END")} AS routing_confidence,
  CASE WHEN routed AND shape = 2 THEN 2 WHEN routed AND shape < 2 AND kind <> 2 THEN 1 ELSE 0 END::BIGINT AS field_count
FROM page_docs""")

CTE["table_rows"] = """
  SELECT doc_id, pos AS row_num, CASE WHEN p_size % 11 <> 0 THEN p_name ELSE 'None' END AS c1,
    l_quantity::BIGINT::VARCHAR AS c2, format('{:.2f}', total_price) AS c3 FROM lines"""
put("table_normalize", """
SELECT d.doc_id, (o % 3 + 1)::INTEGER AS page, CASE WHEN o % 17 = 0 THEN '' ELSE 'item' END || '|qty|total' AS headers,
  row_num, c1 || '|' || c2 || '|' || c3 AS row FROM docs d JOIN table_rows r ON d.doc_id = r.doc_id""")
CTE["rendered"] = """
  SELECT d.doc_id, CASE WHEN n_lines = 0 THEN 'No tables found' ELSE
    'Table 1 (Page ' || (o % 3 + 1) || '):' || chr(10) || 'Headers: ' || CASE WHEN o % 17 = 0 THEN '' ELSE 'item' END
    || ', qty, total' || chr(10) || shown || CASE WHEN n_lines > 5 THEN '... and ' || (n_lines - 5) || ' more rows'
    || chr(10) ELSE '' END END AS tables
  FROM docs d LEFT JOIN (SELECT doc_id AS r_id, string_agg('Row ' || (row_num + 1) || ': ' || c1 || ', ' || c2 || ', ' || c3
    || chr(10), '' ORDER BY row_num) AS shown FROM table_rows WHERE row_num < 5 GROUP BY doc_id) ON doc_id = r_id"""
put("table_render", "SELECT doc_id, tables FROM rendered")

# --- patterns and similarity ---------------------------------------------------------------------------------


def matches(patterns: list[str], text: str = "text") -> str:
    lists = ", ".join(f"regexp_extract_all({text}, {pattern(p)})" for p in patterns)
    return f"list_concat({lists})" if len(patterns) > 1 else lists


def long_form(source: str, values: str, kind: str) -> str:
    return f"""
SELECT doc_id, '{kind}' AS kind, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS pos
FROM (SELECT doc_id, {values} AS v FROM {source})"""


_numbers = (f"list_filter(list_transform({matches([fv.NUMBER_PATTERN])}, "
            f"lambda m: try_cast(replace(m, ',', '') AS DOUBLE)), lambda n: n IS NOT NULL)")
put("extract_numbers", long_form("texts", _numbers, "number"))
put("extract_dates", long_form("texts", matches(fv.DATE_PATTERNS), "date"))
put("extract_emails", long_form("documents", matches([fv.EMAIL_PATTERN]), "email"))
put("char_jaccard", f"""
SELECT doc_id, item_id, {r6('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS similarity
FROM (SELECT doc_id, item_id, list_distinct(string_split(lower(d.text), '')) AS a,
      list_distinct(string_split(lower(b.text), '')) AS b
      FROM documents d JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id)""")
put("char_best_items", f"""
SELECT doc_id, item_id, {r6('s')} AS similarity FROM (
  SELECT doc_id, item_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS s
  FROM (SELECT doc_id, list_distinct(string_split(lower(text), '')) AS a FROM documents WHERE text <> ''),
    (SELECT item_id, list_distinct(string_split(lower(text), '')) AS b FROM benchmark WHERE text <> ''))
WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) = 1""")
put("bbox_struct", "SELECT vec_id, " + ", ".join(
    f"{r6(f'CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE embedding[{i + 1}]::DOUBLE END')} AS {n}"
    for i, n in enumerate(("x0", "y0", "x1", "y1"))) + " FROM embeddings")
put("label_format", """
SELECT list_aggregate(list_transform(string_split(rule, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label,
  count(*) AS documents FROM rules GROUP BY rule""")

# --- routing ------------------------------------------------------------------------------------------------


def hits(doc_type: str, lower_text: str) -> str:
    return " + ".join(f"contains({lower_text}, {text_literal(k)})::BIGINT" for k in fv.ROUTING_KEYWORDS[doc_type])


CTE["keyword_hits"] = f"""
  SELECT doc_id, {", ".join(f"{hits(t, 'lt')} AS {t}" for t in fv.DOC_TYPES)}, {WORDS('lt')} AS words FROM lowered"""


def routed(source: str) -> str:
    best = "greatest(invoice, medical_bill, prescription)"
    return f"""
  SELECT doc_id, CASE WHEN {best} = 0 THEN 'unknown' WHEN invoice = {best} THEN 'invoice'
      WHEN medical_bill = {best} THEN 'medical_bill' ELSE 'prescription' END AS doc_type,
    CASE WHEN {best} = 0 THEN 0.0::DOUBLE ELSE least(0.8::DOUBLE, {best} / greatest(1.0::DOUBLE, words / 50.0::DOUBLE)) END AS confidence,
    CASE WHEN {best} = 0 THEN 'No matching keywords found'
      ELSE 'Keyword-based classification: ' || {best} || ' matching keywords' END AS reasoning
  FROM {source}"""


CTE["routed"] = routed("keyword_hits")
put("keyword_scores", "SELECT doc_id, invoice, medical_bill, prescription, words FROM keyword_hits")
put("route_keywords", f"SELECT doc_id, doc_type, {r6('confidence')} AS confidence, reasoning FROM routed")
CTE["all_pages"] = f"""
  SELECT 'c' || doc_id AS doc_id, lower(t) AS lt FROM whole
  UNION ALL SELECT doc_id, lower({CLEAN("'--- Page 1 ---' || chr(10) || text")}) FROM texts"""
CTE["page_hits"] = f"""
  SELECT doc_id, {", ".join(f"{hits(t, 'lt')} AS {t}" for t in fv.DOC_TYPES)}, {WORDS('lt')} AS words FROM all_pages"""
CTE["page_routed"] = routed("page_hits")
put("route_segments", f"SELECT doc_id, doc_type, {r6('confidence')} AS confidence, reasoning FROM page_routed")

CTE["model_routes"] = """
  SELECT doc_id, CASE WHEN c IN (0, 2, 3) THEN kind ELSE 'unknown' END AS doc_type,
    CASE c WHEN 0 THEN (o % 91) / 100.0::DOUBLE WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
    CASE WHEN c IN (0, 1, 2, 3) THEN 'seen' WHEN c IN (4, 5, 6) THEN 'Classification failed: no usable confidence'
      ELSE 'Classification failed: Invalid response format' END AS reasoning
  FROM (SELECT o_orderkey AS o, o_orderkey::VARCHAR AS doc_id, o_orderkey // 3 % 10 AS c,
        CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'medical_bill' ELSE 'prescription' END AS kind FROM orders)
  WHERE c <> 9"""
put("route_model", f"SELECT doc_id, doc_type, {r6('confidence')} AS confidence, reasoning FROM model_routes")
put("route_with_fallback", f"""
SELECT t.doc_id, CASE WHEN usable THEN m.doc_type ELSE k.doc_type END AS doc_type,
  {r6('CASE WHEN usable THEN m.confidence ELSE k.confidence END')} AS confidence,
  CASE WHEN usable THEN m.reasoning ELSE k.reasoning END AS reasoning
FROM (SELECT t0.*, m0.doc_type IS NOT NULL AND m0.doc_type <> 'unknown'
        AND NOT regexp_matches(text, {text_literal(BLANK)}) AS usable
      FROM texts t0 LEFT JOIN model_routes m0 ON t0.doc_id = m0.doc_id) t
JOIN routed k ON t.doc_id = k.doc_id LEFT JOIN model_routes m ON t.doc_id = m.doc_id""")
put("routing_requests", f"""
SELECT doc_id, {text_literal(fv.ROUTING_SYSTEM_PROMPT)} AS system, {text_literal(fv.ROUTING_USER_PROMPT)} ||
  CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS user
FROM texts WHERE NOT regexp_matches(text, {text_literal(BLANK)})""")
put("route_lexicon", """
SELECT doc_id, CASE WHEN greatest(invoice, medical_bill, prescription) = 0 THEN 'unknown'
    WHEN invoice >= greatest(medical_bill, prescription) THEN 'invoice'
    WHEN medical_bill >= prescription THEN 'medical_bill' ELSE 'prescription' END AS doc_type,
  greatest(invoice, medical_bill, prescription) AS score FROM keyword_hits""")
CTE["part_words"] = """
  SELECT DISTINCT 'kind_' || left(w, 1) AS doc_type, lower(left(w, 3)) AS keyword, ascii(w) AS priority
  FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''"""
put("route_lexicon_join", """
SELECT d.doc_id, coalesce(doc_type, 'unknown') AS doc_type, coalesce(n, 0) AS score FROM documents d LEFT JOIN (
  SELECT doc_id AS h_id, doc_type, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, priority, doc_type DESC) AS rn
  FROM (SELECT doc_id, doc_type, count(*) AS n, min(priority) AS priority
        FROM documents JOIN part_words ON contains(lower(text), keyword) GROUP BY doc_id, doc_type))
ON doc_id = h_id AND rn = 1""")

# --- requests and replies --------------------------------------------------------------------------------------

_by_type = lambda f: "CASE kind " + " ".join(f"WHEN '{t}' THEN {text_literal(f(t))}" for t in fv.DOC_TYPES) + " END"
put("extraction_requests", f"""
SELECT t.doc_id, kind AS doc_type,
  {_by_type(lambda t: fv.EXTRACTION_BASE_PROMPT + fv.EXTRACTION_TYPE_PROMPTS[t])} AS system,
  chr(10) || 'Document Text:' || chr(10) || left(text, 4000) || chr(10) || chr(10) || 'Table Data:' || chr(10) || tables ||
  {_by_type(lambda t: chr(10) + chr(10) + 'Return a JSON object of this shape: ' + schemas.describe(schemas.RECORD_TYPES[t])
            + chr(10) + chr(10) + fv.EXTRACTION_REQUEST_CLOSING + chr(10))} AS user
FROM texts t JOIN rendered r ON t.doc_id = r.doc_id""")

CTE["shapes"] = "SELECT doc_id, o, kind, text, o // 3 % 10 AS c FROM texts"
put("fallback_requests", f"""
SELECT doc_id, kind AS doc_type, chr(10) || 'Extract information from this ' || kind ||
  ' document and return it as valid JSON.' || chr(10) || chr(10) || 'Document Text:' || chr(10) || left(text, 2000) ||
  chr(10) || chr(10) || 'Return a JSON object with the relevant fields for a ' || kind || '. ' || chr(10) ||
  'Include confidence scores (0.0 to 1.0) for each field.' || chr(10) || 'Use null for missing information.' || chr(10) AS user
FROM shapes WHERE c NOT IN (0, 1, 3)""")

CTE["records"] = """
  SELECT doc_id, o, kind, invoice_number AS code, date, total_amount, currency, n_lines AS items, goods AS item_total FROM invoice
  UNION ALL SELECT doc_id, o, kind, patient_id, bill_date, total_amount, currency, n_lines, goods FROM medical_bill
  UNION ALL SELECT doc_id, o, kind, patient_age, prescription_date, NULL, NULL, n_lines, 0.0 FROM prescription"""
put("parse_typed_response", f"""
SELECT doc_id, kind AS doc_type, code, date, total_amount, currency, items, {r6('item_total')} AS item_total
FROM records WHERE o // 3 % 10 IN (0, 1, 3) AND o % 40 <> 0""")
#: Shapes whose second reply holds one JSON object.
FREE = "(c IN (2, 4, 5, 6, 7) AND NOT (c = 5 AND o % 4 = 0))"
put("response_rejects", """
SELECT doc_id, kind AS doc_type, c AS "case" FROM shapes WHERE c NOT IN (0, 1, 3) AND o % 40 <> 0""")
put("fallback_json", f"""
SELECT doc_id, c <> 8 AS has_span, {FREE} AS is_json,
  CASE WHEN {FREE} THEN CASE WHEN o % 2 = 0 THEN 'sales@example.com' ELSE 'sales at example' END END AS vendor_email,
  CASE WHEN {FREE} THEN CASE WHEN o % 5 = 0 THEN '12' ELSE '+1 555-123-4567' END END AS contact_phone,
  CASE WHEN {FREE} THEN 1500.0::DOUBLE END AS level
FROM shapes WHERE c NOT IN (0, 1, 3)""")


def outcome(known: str) -> str:
    return (f"CASE WHEN NOT ({known}) THEN 'failed' WHEN c IN (0, 1, 3) THEN 'llm_structured' "
            f"WHEN {FREE} THEN 'fallback_json' ELSE 'failed' END")


put("extraction_outcome", f"""
SELECT doc_id, CASE WHEN o % 40 = 0 THEN 'unknown' ELSE kind END AS doc_type,
  {outcome('o % 40 <> 0')} AS extraction_method,
  CASE WHEN o % 40 = 0 THEN 'Unknown document type: unknown' WHEN c = 8 THEN
    'All extraction methods failed: No valid JSON found in response' WHEN c = 9 OR c = 5 AND o % 4 = 0 THEN
    'All extraction methods failed: Invalid JSON' END AS error FROM shapes""")
put("model_apply_stub", f"""
SELECT doc_id, 'invoice' AS doc_type, 0.5::DOUBLE AS confidence,
  (length({text_literal(fv.ROUTING_USER_PROMPT)}) + least(length(text), 2003))::VARCHAR AS reasoning
FROM (SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text FROM documents)
WHERE NOT regexp_matches(text, {text_literal(BLANK)})""")
put("extract_phones", f"""
SELECT doc_id, 'phone' AS kind, value, pos::BIGINT AS pos
FROM shapes CROSS JOIN (VALUES ('555-123-4567', 0), ('+1 555-123-4567', 1)) v(value, pos)
WHERE {FREE} AND o % 5 <> 0""")

CTE["last_events"] = """
  SELECT '/in/u' || user_id AS path, max(event_id) AS entry, arg_max(CASE event_id % 3 WHEN 0 THEN 'Invoice total '
    WHEN 1 THEN 'patient, hospital: ' ELSE '' END || event_type || ' ' || props, event_id) AS text FROM events GROUP BY user_id"""
CTE["event_hits"] = f"""
  SELECT path AS doc_id, entry, text, {", ".join(f"{hits(t, 'lower(text)')} AS {t}" for t in fv.DOC_TYPES)}, 0 AS words FROM last_events"""
CTE["event_routed"] = routed("event_hits")
put("stream_dedup", """
SELECT h.doc_id AS path, entry, doc_type, CASE WHEN doc_type = 'unknown' THEN 0.5::DOUBLE ELSE 0.35 END AS overall_confidence
FROM event_hits h JOIN event_routed r ON h.doc_id = r.doc_id""")

CTE["claims"] = """
  SELECT doc_id, unnest([vendor_name, customer_address, vendor_address || ' depot nowhere']) AS value FROM invoice
  UNION ALL SELECT doc_id, unnest([hospital_name, doctor_name, 'Doctor ' || doctor_name]) FROM medical_bill
  UNION ALL SELECT doc_id, unnest([clinic_address, diagnosis]) FROM prescription"""
put("evidence_confidence", f"""
SELECT c.doc_id, value, {r6(evidence('value', 'lt'))} AS confidence FROM claims c JOIN lowered t ON c.doc_id = t.doc_id
WHERE value IS NOT NULL""")

# --- fields ---------------------------------------------------------------------------------------------------

for _query, _type in (("flatten_invoice", fv.INVOICE), ("flatten_medical", fv.MEDICAL_BILL),
                      ("flatten_prescription", fv.PRESCRIPTION)):
    put(_query, f"""
SELECT doc_id, pos, path, key, value, {r6('llm_conf')} AS llm_conf FROM supported WHERE doc_type = '{_type}'""")

put("result_fields", f"""
SELECT doc_id, path AS name, value, {r6('confidence')} AS confidence, 1::BIGINT AS page, 0.0::DOUBLE AS x0,
  0.0::DOUBLE AS y0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1 FROM scored""")
put("fields_long", f"SELECT doc_id, pos, path AS field, value, {r6('confidence')} AS confidence FROM scored")
put("line_items_long", "SELECT doc_id, pos, description, quantity, unit_price, total_price, confidence FROM line_items")
put("medicines_long", "SELECT doc_id, pos, name, dosage, frequency, duration, confidence FROM medicines")

# --- validation -------------------------------------------------------------------------------------------------

for _query, _type in (("validate_invoice", fv.INVOICE), ("validate_medical", fv.MEDICAL_BILL),
                      ("validate_prescription", fv.PRESCRIPTION)):
    put(_query, f"""
SELECT r.doc_id, r.pos::BIGINT AS pos, rule, outcome, coalesce(n, 0) AS warnings
FROM rules r LEFT JOIN warned w ON r.doc_id = w.doc_id AND r.pos = w.pos WHERE doc_type = '{_type}'""")
put("validation_notes", "SELECT doc_id, doc_type, notes, failed = 0 AS overall_valid FROM checked")
put("validation_warnings", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1 AS pos, warning FROM rule_warnings""")

CTE["contacts"] = """
  SELECT event_id AS e, event_id::VARCHAR AS doc_id, user_id, event_type, props, event_id % 3 AS m, event_id % 4 AS p FROM events"""
_common_counts = ("(m = 0)::INT + (p = 0)::INT", "(m = 1)::INT", "(p = 1)::INT")
put("validate_common", f"""
SELECT doc_id, concat_ws(',', CASE WHEN m = 0 THEN 'email_format_valid' END, CASE WHEN p = 0 THEN 'phone_format_valid' END) AS passed,
  CASE WHEN m = 1 THEN 'email_format_invalid' ELSE '' END AS failed,
  CASE WHEN p = 1 THEN 'Unusual phone number format: 12-34' ELSE '' END AS warnings,
  {note(*[f"({c})" for c in _common_counts])} AS notes FROM contacts""")

SQL["validate_unreadable"] = f"""
SELECT doc_id, CASE WHEN cut THEN 'validation_system_error' ELSE failed END AS failed,
  CASE WHEN cut THEN 'Validation system error: unreadable record' ELSE warnings END AS warnings,
  CASE WHEN cut THEN 'Validation could not be completed due to system error' ELSE notes END AS notes,
  NOT cut AND failed = '' AS overall_valid
FROM (SELECT *, doc_id::BIGINT % 6 = 0 AS cut FROM ({SQL["validate_common"]}))"""


def looks(value: str) -> str:
    shape = (f"CASE WHEN regexp_matches(regexp_replace({value}, '[.,]', '', 'g'), '^[\\p{{Nd}}²³¹]+$') THEN 0.9::DOUBLE "
             f"WHEN regexp_matches({value}, '[\\p{{Nd}}²³¹]') AND regexp_matches({value}, '[/ -]') THEN 0.8 "
             f"WHEN regexp_matches(replace({value}, ' ', ''), '^\\p{{L}}+$') AND length({value}) > 3 THEN 0.7 ELSE 0.5 END")
    return f"least(1.0::DOUBLE, (least(1.0::DOUBLE, length({value}) / 20.0::DOUBLE) + {shape}) / 2.0::DOUBLE)"


_bare = lambda v: f"regexp_replace({v}, {pattern('^' + fv.WHITESPACE + '+|' + fv.WHITESPACE + '+$')}, '', 'g')"
_event_leaves = [
    ("k", "k", "json_extract_string(props, '$.k')", "(e % 100) / 100.0::DOUBLE"),
    ("kind", "kind", "event_type", "0.25::DOUBLE"),
    ("kindConfidence", "kindConfidence", "'0.25'", None),
    ("email", "email", "CASE m WHEN 0 THEN 'user@example.org' WHEN 1 THEN 'user at example' END", None),
    ("phone", "phone", "CASE p WHEN 0 THEN '(555) 123-4567' WHEN 1 THEN '12-34' END", None),
    ("inner.user", "user", "'u' || user_id", None),
    ("inner.seen", "seen", "'True'", None),
    ("inner.list[0].n", "n", "(e % 7)::VARCHAR", None),
]
CTE["event_leaves"] = "\n  UNION ALL ".join(
    f"SELECT doc_id, {i} AS ord, '{path}' AS path, '{key}' AS key, {value} AS value, {conf or 'NULL'} AS stated FROM contacts"
    for i, (path, key, value, conf) in enumerate(_event_leaves))
put("flatten_freeform", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos, path, key, value,
  {r6(f"coalesce(stated, CASE WHEN key = 'n' AND value = '0' THEN 0.0::DOUBLE ELSE {looks('value')} END)")} AS llm_conf
FROM event_leaves WHERE value IS NOT NULL""")

# --- scoring -----------------------------------------------------------------------------------------------------

put("score_fields", f"SELECT doc_id, pos, path, {r6('confidence')} AS confidence FROM scored")
put("score_custom_weights", f"""
SELECT c.doc_id, {r6('coalesce(a, 0.5)')} AS avg_field_confidence,
  {r6(overall('coalesce(a, 0.5)', 'critical', "'llm_structured'"))} AS overall_confidence
FROM rule_counts c LEFT JOIN (SELECT doc_id AS s_id, avg({score('0.5', '0.25', '0.25')}) AS a FROM scored GROUP BY doc_id)
ON doc_id = s_id""")
CTE["names"] = """
  SELECT doc_id, customer_name AS value FROM invoice UNION ALL SELECT doc_id, patient_name FROM medical_bill
  UNION ALL SELECT doc_id, patient_name FROM prescription"""
put("score_text_match", f"""
SELECT doc_id, {r6("least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, llm * (0.5::DOUBLE + 0.5::DOUBLE * match)) + 0.2::DOUBLE * quality + 0.2::DOUBLE * 0.7::DOUBLE))")} AS confidence
FROM (SELECT n.doc_id, quality, {evidence('value', 'lt')} AS llm,
  CASE WHEN lt = '' THEN 0.0::DOUBLE ELSE len(list_intersect(list_distinct(string_split(lower(value), '')), list_distinct(string_split(lt, ''))))
    / len(list_distinct(list_concat(string_split(lower(value), ''), string_split(lt, '')))) END AS match
  FROM names n JOIN lowered t ON n.doc_id = t.doc_id JOIN docs d ON n.doc_id = d.doc_id WHERE value IS NOT NULL)""")
put("estimate_confidence", f"""
SELECT id, value, {r6(f"CASE WHEN value = '' THEN 0.0::DOUBLE ELSE {looks('bare')} END")} AS confidence FROM (
  SELECT id, value, {_bare('value')} AS bare FROM (
    SELECT o_orderkey::VARCHAR AS id, unnest([strftime(o_orderdate, '%Y-%m-%d'), o_totalprice::VARCHAR, o_orderpriority,
      o_orderkey::VARCHAR]) AS value FROM orders
    UNION ALL SELECT c_name, unnest([c_mktsegment, c_name, 'N/A']) FROM customer
    UNION ALL SELECT doc_id::VARCHAR, text FROM documents))""")
put("field_rule_status", "SELECT doc_type, key, status, count(*) AS fields FROM statuses GROUP BY doc_type, key, status")
put("score_documents", f"""
SELECT doc_id, doc_type, field_count, {r6('avg_conf')} AS avg_field_confidence, critical AS critical_failures,
  {r6('overall')} AS overall_confidence FROM results""")
put("confidence_distribution", f"""
SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
  count(*) FILTER (confidence < 0.5) AS low, {r6('min(confidence)')} AS min_confidence,
  {r6('max(confidence)')} AS max_confidence, {r6('stddev_pop(confidence)')} AS std_deviation FROM scored""")
put("document_distribution", f"""
SELECT doc_id, high, medium, low, {r6('min_c')} AS min_confidence, {r6('max_c')} AS max_confidence,
  {r6('std_c')} AS std_deviation FROM results""")

CTE["reweighted"] = f"""
  SELECT s.doc_id AS w_id, count(*) AS fields, avg({score('0.5', '0.25', '0.25')}) AS mean
  FROM statuses s JOIN docs d ON s.doc_id = d.doc_id GROUP BY s.doc_id"""
put("scoring_metadata", f"""
SELECT doc_id, CASE WHEN lost THEN 0 ELSE coalesce(fields, 0) END AS field_count,
  CASE WHEN lost THEN 0.5::DOUBLE ELSE {r6('coalesce(mean, 0.5)')} END AS avg_field_confidence,
  CASE WHEN lost THEN 0.5::DOUBLE ELSE {r6(overall('coalesce(mean, 0.5)', 'critical', "'llm_structured'"))} END AS overall_confidence,
  CASE WHEN NOT lost THEN {r6('quality')} END AS ocr_quality, CASE WHEN NOT lost THEN 'llm_structured' END AS extraction_method,
  CASE WHEN NOT lost THEN failed = 0 END AS validation_passed, CASE WHEN NOT lost THEN 0.5::DOUBLE END AS llm_weight,
  CASE WHEN NOT lost THEN 0.25::DOUBLE END AS ocr_weight, CASE WHEN NOT lost THEN 0.25::DOUBLE END AS validation_weight,
  CASE WHEN lost THEN 'the record has no readable leaves' END AS error
FROM (SELECT c.doc_id, failed, critical, fields, mean, quality, o % 50 = 0 AS lost FROM checked c JOIN docs d ON c.doc_id = d.doc_id
      LEFT JOIN reweighted ON c.doc_id = w_id)""")
CTE["own_rules"] = """
  SELECT doc_id, 0 AS pos, 'date_real' AS rule, CASE WHEN date = 'n/a' THEN 'error' ELSE 'passed' END AS outcome, NULL AS warning FROM invoice
  UNION ALL SELECT doc_id, 1, 'tax_share_usual', CASE WHEN share IS NULL THEN 'error' WHEN share < 25 THEN 'passed' ELSE 'failed' END,
    CASE WHEN share >= 20 THEN 'Low tax: ' || floor(share)::INT END
    FROM (SELECT doc_id, CASE WHEN tax_amount <> 0 AND subtotal % 2 >= 1 THEN subtotal / tax_amount END AS share FROM invoice)
  UNION ALL SELECT doc_id, 2, rule, outcome, NULL FROM rules WHERE doc_type = 'invoice' AND rule = 'vendor_name_present'
  UNION ALL SELECT doc_id, 0, 'bill_date_real', CASE WHEN bill_date = 'soon' THEN 'error' ELSE 'passed' END, NULL FROM medical_bill
  UNION ALL SELECT doc_id, pos + 1, rule, outcome, NULL FROM rules WHERE doc_type = 'medical_bill'
  UNION ALL SELECT doc_id, 0, 'age_usual', CASE WHEN patient_age::INT < 75 THEN 'passed' ELSE 'failed' END, NULL FROM prescription"""
CTE["own_warnings"] = "SELECT doc_id AS x_id, string_agg(warning, ',') AS warned FROM rule_warnings JOIN medical_bill USING (doc_id) GROUP BY doc_id"
put("validate_own_rules", """
SELECT doc_id, doc_type, coalesce(passed, '') AS passed, coalesce(failed, '') AS failed, coalesce(warned, own, '') AS warnings, failed IS NULL AS overall_valid
FROM (SELECT doc_id, any_value(kind) AS doc_type, string_agg(rule, ',' ORDER BY pos) FILTER (outcome = 'passed') AS passed,
        string_agg(CASE outcome WHEN 'error' THEN rule || ' (error)' ELSE rule END, ',' ORDER BY pos) FILTER (outcome <> 'passed') AS failed,
        string_agg(warning, ',') AS own FROM own_rules JOIN (SELECT doc_id AS k, kind FROM docs) ON doc_id = k GROUP BY doc_id)
  LEFT JOIN own_warnings ON doc_id = x_id""")

put("structural_check", """
SELECT doc_id, issues = '' AS is_valid, issues FROM (
  SELECT doc_id, concat_ws('; ', CASE WHEN s THEN 'Missing required key: doc_type' END,
    CASE WHEN s THEN 'Missing required key: fields' END,
    CASE WHEN NOT s AND o % 11 IN (0, 1) THEN 'Overall confidence not between 0 and 1' END,
    CASE WHEN NOT s AND o % 5 = 0 THEN 'Field ' || field_count || ' missing key: value; Field ' || field_count || ' missing key: confidence' END,
    CASE WHEN NOT s AND o % 5 = 1 THEN 'Field ' || field_count || ' is not a dictionary' END) AS issues
  FROM (SELECT r.doc_id, field_count, o, o % 7 = 0 AS s FROM results r JOIN docs d ON r.doc_id = d.doc_id))""")

# --- the whole chain ----------------------------------------------------------------------------------------------

CTE["chain"] = f"""
  SELECT s.doc_id, s.o, kind, quality, c, regexp_matches(text, {text_literal(BLANK)}) AS blank,
    CASE WHEN regexp_matches(text, {text_literal(BLANK)}) THEN 'unknown' ELSE doc_type END AS doc_type,
    {outcome("doc_type <> 'unknown' AND NOT regexp_matches(text, " + text_literal(BLANK) + ")")} AS method
  FROM shapes s JOIN routed r ON s.doc_id = r.doc_id JOIN (SELECT doc_id AS q_id, quality FROM docs) ON s.doc_id = q_id"""

_EMPTY_RULES = [(t, i, name) for t, rules in _RULE_SQL.items() for i, (name, _, _) in enumerate(rules)]
_empty_values = ", ".join(
    f"('{t}', {i}, '{name}', '{'passed' if name == 'medicine_dosages_valid' else 'failed'}')" for t, i, name in _EMPTY_RULES)

CTE["chain_rules"] = f"""
  SELECT c.doc_id, pos, rule, outcome FROM chain c JOIN rules r ON c.doc_id = r.doc_id
  WHERE method IN ('llm_structured', 'fallback_json')
  UNION ALL SELECT c.doc_id, v.pos, v.rule, v.outcome
  FROM chain c JOIN (VALUES {_empty_values}) v(t, pos, rule, outcome) ON c.doc_type = v.t WHERE method = 'failed'
  UNION ALL SELECT doc_id, 10, CASE WHEN o % 2 = 0 THEN 'vendor_email_format_valid' ELSE 'vendor_email_format_invalid' END,
    CASE WHEN o % 2 = 0 THEN 'passed' ELSE 'failed' END FROM chain WHERE method = 'fallback_json'
  UNION ALL SELECT doc_id, 11, 'contact_phone_format_valid', 'passed' FROM chain
  WHERE method = 'fallback_json' AND o % 5 <> 0"""

CTE["chain_counts"] = """
  SELECT doc_id AS k_id, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed,
    count(*) FILTER (outcome = 'failed' AND regexp_matches(rule, 'total|amount|balance|required|present')) AS critical,
    coalesce(string_agg(rule, ',' ORDER BY pos) FILTER (outcome = 'passed'), '') AS passed_rules,
    coalesce(string_agg(rule, ',' ORDER BY pos) FILTER (outcome = 'failed'), '') AS failed_rules
  FROM chain_rules GROUP BY doc_id"""

_extras = [("vendor_email", "CASE WHEN o % 2 = 0 THEN 'sales@example.com' ELSE 'sales at example' END"),
           ("contact_phone", "CASE WHEN o % 5 = 0 THEN '12' ELSE '+1 555-123-4567' END"),
           ("checked", "'True'"), ("level", "'1500.0'")]

CTE["chain_leaves"] = f"""
  SELECT l.doc_id, key, llm_conf FROM supported l JOIN chain c ON l.doc_id = c.doc_id WHERE method = 'llm_structured'
  UNION ALL SELECT l.doc_id, key, CASE WHEN contains(path, '[') THEN 0.0::DOUBLE WHEN key = 'total_amount' THEN 0.85
    WHEN regexp_matches(value, '^-?0(\\.0)?$') AND key IN ('subtotal', 'tax_amount', 'amount_paid', 'balance_due') THEN 0.0
    ELSE {looks(_bare('value'))} END
  FROM leaves l JOIN chain c ON l.doc_id = c.doc_id WHERE method = 'fallback_json'
  UNION ALL """ + "\n  UNION ALL ".join(
    f"SELECT doc_id, '{key}', {looks('v')} FROM (SELECT doc_id, {value} AS v FROM chain WHERE method = 'fallback_json')"
    for key, value in _extras)

CTE["chain_scores"] = f"""
  SELECT doc_id AS s_id, count(*) AS field_count, avg({score('0.6', '0.2', '0.2')}) AS base FROM (
    SELECT l.doc_id, llm_conf, quality, CASE WHEN contains(failed_rules, lower(key)) THEN 'false'
      WHEN contains(passed_rules, lower(key)) THEN 'true' ELSE 'none' END AS status
    FROM chain_leaves l JOIN chain c ON l.doc_id = c.doc_id JOIN chain_counts k ON l.doc_id = k.k_id)
  GROUP BY doc_id"""

CTE["chain_results"] = f"""
  SELECT doc_id, doc_type, CASE WHEN NOT blank THEN method END AS extraction_method, coalesce(field_count, 0) AS field_count,
    CASE WHEN blank THEN '' ELSE coalesce(passed_rules, '') END AS passed_rules,
    CASE WHEN blank THEN 'processing_error' ELSE coalesce(failed_rules, '') END AS failed_rules,
    CASE WHEN blank THEN 'Processing failed: {fv.NO_TEXT_ERROR}' ELSE
      {note('coalesce(passed, 0)', 'coalesce(failed, 0)', '(coalesce(CASE WHEN method <> ' + "'failed'" + ' THEN warnings END, 0) + (method = ' + "'fallback_json'" + ' AND o % 5 = 0)::BIGINT)')} END AS notes,
    CASE WHEN blank THEN 0.0::DOUBLE ELSE {overall('coalesce(base, 0.5)', 'coalesce(critical, 0)', 'method')} END AS overall,
    CASE WHEN blank THEN '{fv.NO_TEXT_ERROR}' END AS error
  FROM chain LEFT JOIN chain_counts ON doc_id = k_id LEFT JOIN chain_scores ON doc_id = s_id
  LEFT JOIN (SELECT doc_id AS w_id, warnings FROM warning_counts) ON doc_id = w_id"""

put("document_results", f"""
SELECT doc_id, doc_type, extraction_method, field_count, passed_rules, failed_rules, notes,
  {r6('overall')} AS overall_confidence, error FROM chain_results""")
put("stream_ingest", f"""
SELECT doc_id, doc_type, extraction_method, {r6('overall')} AS overall_confidence, notes FROM chain_results""")
put("error_rows", """
SELECT doc_id, doc_type, overall AS overall_confidence, failed_rules, notes, field_count
FROM chain_results WHERE error IS NOT NULL""")
put("batch_summary", f"""
SELECT count(*) AS total_files, count(*) FILTER (overall > 0) AS successful, count(*) FILTER (overall <= 0) AS failed,
  {r6('count(*) FILTER (overall > 0) / count(*)')} AS success_rate,
  {r6('avg(overall) FILTER (overall > 0)')} AS average_confidence FROM chain_results""")
SQL["batch_run"] = SQL["batch_summary"]
put("stream_summary", f"""
SELECT count(*) AS total_files, count(*) FILTER (overall > 0) AS successful, count(*) FILTER (overall <= 0) AS failed,
  {r6('count(*) FILTER (overall > 0) / count(*)')} AS success_rate,
  {r6('avg(overall) FILTER (overall > 0)')} AS average_confidence FROM results""")
put("doc_type_counts", "SELECT doc_type, count(*) AS documents FROM chain_results GROUP BY doc_type")
put("batch_digest", f"""
SELECT '/in/' || doc_id || '.pdf' AS path, doc_type, {r6('overall')} AS confidence, field_count FROM chain_results""")
put("batch_dedup", """
SELECT '/in/u' || user_id AS path, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
  arg_max(value, event_id) AS value FROM events GROUP BY user_id""")


def band(c: str) -> str:
    return f"CASE WHEN {c} >= 0.8 THEN 'high' WHEN {c} >= 0.5 THEN 'medium' ELSE 'low' END"


put("confidence_band", f"""
SELECT doc_id, confidence, {band('confidence')} AS band FROM (SELECT doc_id, {r6('overall')} AS confidence FROM results)""")
CTE["rounded"] = f"SELECT {r6('confidence')} AS c FROM scored"
put("band_shares", f"""
SELECT b AS band, coalesce(n, 0) AS fields, {r6('coalesce(n, 0) / total')} AS share
FROM (VALUES ('high'), ('medium'), ('low')) v(b)
LEFT JOIN (SELECT {band('c')} AS band, count(*) AS n FROM rounded GROUP BY 1) ON b = band,
(SELECT count(*) AS total FROM rounded)""")
put("confidence_histogram", """
SELECT bin, (SELECT count(*) FROM rounded WHERE c > lo AND c <= hi) AS fields FROM (VALUES """ + ", ".join(
    f"({lo}::DOUBLE, {hi}::DOUBLE, '{name}')" for lo, hi, name in fv.HISTOGRAM_BINS) + ") v(lo, hi, bin)")
put("rule_pass_rates", f"""
SELECT rule, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed,
  {r6("count(*) FILTER (outcome = 'passed') / count(*)")} AS pass_rate FROM rules GROUP BY rule""")
put("overview", f"""
SELECT doc_id, CASE doc_type WHEN 'invoice' THEN 'Invoice' WHEN 'medical_bill' THEN 'Medical Bill'
    ELSE 'Prescription' END AS document_type, confidence, {band('confidence')} AS band, field_count AS fields, passed, failed,
  CASE WHEN passed > 0 THEN 'Valid' ELSE 'Issues' END AS status
FROM (SELECT *, {r6('overall')} AS confidence FROM results)""")
put("valid_invoices", f"""
SELECT failed = 0 AS overall_valid, count(*) AS invoices, {r6('avg(overall)')} AS average_confidence
FROM results WHERE doc_type = 'invoice' GROUP BY 1""")
