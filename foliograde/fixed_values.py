"""Fixed values.

Everything in this module is data that results depend on literally: word
lists, patterns, labels, thresholds, prompt texts and message texts.  No logic
lives here.
"""

# --- fixed values: document types and labels --------------------------------

INVOICE = "invoice"
MEDICAL_BILL = "medical_bill"
PRESCRIPTION = "prescription"
UNKNOWN = "unknown"

#: In the order in which routing breaks ties.
DOC_TYPES = [INVOICE, MEDICAL_BILL, PRESCRIPTION]

METHOD_TYPED = "llm_structured"
METHOD_FALLBACK = "fallback_json"
METHOD_FAILED = "failed"

# --- fixed values: routing keywords ------------------------------------------

ROUTING_KEYWORDS = {
    INVOICE: [
        "invoice", "bill", "purchase order", "vendor", "customer", "total",
        "amount due", "line item", "quantity", "price", "subtotal", "tax",
        "payment terms",
    ],
    MEDICAL_BILL: [
        "hospital", "clinic", "patient", "medical", "healthcare", "insurance",
        "diagnosis", "treatment", "service date", "provider", "physician",
    ],
    PRESCRIPTION: [
        "prescription", "doctor", "dr.", "medicine", "medication", "dosage",
        "pharmacy", "rx", "take", "tablet", "capsule", "mg", "ml",
    ],
}

KEYWORD_CONFIDENCE_CAP = 0.8
WORDS_PER_KEYWORD = 50

# --- fixed values: character classes and patterns ----------------------------
# Java regular expressions; character classes are spelled out because Java's
# \s, \w, \d and \b are ASCII-only.

WHITESPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
NOT_WHITESPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]"
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
DELETED_BY_CLEANING = r"""[^\p{L}\p{N}_ .,;:!?\-@#$%&*()+=\[\]{}|\\/<>"]"""

NUMBER_PATTERN = r"[\p{Nd},]+\.?\p{Nd}*"

DATE_PATTERNS = [
    r"\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4}",
    r"\p{Nd}{2,4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}",
    rf"(?i){WORD_EDGE}\p{{Nd}}{{1,2}}{WHITESPACE}+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{WHITESPACE}+\p{{Nd}}{{2,4}}{WORD_EDGE}",
    rf"(?i){WORD_EDGE}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{WHITESPACE}+\p{{Nd}}{{1,2}},?{WHITESPACE}+\p{{Nd}}{{2,4}}{WORD_EDGE}",
]

EMAIL_PATTERN = rf"{WORD_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{WORD_EDGE}"

PHONE_PATTERNS = [
    rf"{WORD_EDGE}\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{4}}{WORD_EDGE}",
    rf"\(\p{{Nd}}{{3}}\){WHITESPACE}*\p{{Nd}}{{3}}[-.]?\p{{Nd}}{{4}}",
    r"\+\p{Nd}{1,3}[-.\s\p{Z}\x0B\x1C-\x1F\x85]?\p{Nd}{3,4}[-.\s\p{Z}\x0B\x1C-\x1F\x85]?\p{Nd}{3,4}[-.\s\p{Z}\x0B\x1C-\x1F\x85]?\p{Nd}{3,4}",
]

#: A date as the rules accept it: any one of these anywhere in the value.
DATE_RULE_PATTERNS = [
    r"\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4}",
    r"\p{Nd}{2,4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}",
    rf"\p{{Nd}}{{1,2}}{WHITESPACE}+{WORD_CHAR}+{WHITESPACE}+\p{{Nd}}{{2,4}}",
    rf"{WORD_CHAR}+{WHITESPACE}+\p{{Nd}}{{1,2}},?{WHITESPACE}+\p{{Nd}}{{2,4}}",
]

EMAIL_RULE_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\n?\z"

DOSAGE_PATTERN = rf"(?i)\p{{Nd}}+{WHITESPACE}*(mg|ml|g|mcg|units?|tablets?|capsules?)"

# --- fixed values: file kinds --------------------------------------------------

PDF_EXTENSION = ".pdf"
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif"]

# --- fixed values: limits and thresholds ---------------------------------------

ROUTING_TEXT_LIMIT = 2000
EXTRACTION_TEXT_LIMIT = 4000
FALLBACK_TEXT_LIMIT = 2000
RENDERED_TABLE_ROWS = 5
SCAN_CHECK_PAGES = 3
SCAN_CHARS_PER_PAGE = 50

DEFAULT_OCR_QUALITY = 0.8
TEXT_LAYER_QUALITY = 1.0
DEFAULT_FIELD_CONFIDENCE = 0.5
UNSCORED_ERROR = "the record has no readable leaves"
DEFAULT_CURRENCY = "USD"
MONEY_TOLERANCE = 0.01

LLM_WEIGHT = 0.6
OCR_WEIGHT = 0.2
VALIDATION_WEIGHT = 0.2

RULE_PASSED_SCORE = 1.0
RULE_FAILED_SCORE = 0.0
RULE_ABSENT_SCORE = 0.7

HIGH_CONFIDENCE = 0.8
MEDIUM_CONFIDENCE = 0.5

CRITICAL_RULE_WORDS = ["total", "amount", "balance", "required", "present"]
CRITICAL_PENALTY = 0.1
CRITICAL_PENALTY_CAP = 0.3
FALLBACK_FACTOR = 0.8
TYPED_FACTOR = 1.05

EMAIL_FIELDS = ["email", "contact_email", "vendor_email"]
PHONE_FIELDS = ["phone", "contact_phone", "vendor_phone"]

HISTOGRAM_BINS = [
    (0.0, 0.2, "0-20%"),
    (0.2, 0.4, "20-40%"),
    (0.4, 0.6, "40-60%"),
    (0.6, 0.8, "60-80%"),
    (0.8, 1.0, "80-100%"),
]

# --- fixed values: messages ----------------------------------------------------

NO_KEYWORDS = "No matching keywords found"
KEYWORD_REASON = "Keyword-based classification: {score} matching keywords"
OCR_FAILED_PAGE = "[OCR failed: {error}]"
TABLE_TITLE = "Table {number} (Page {page}):\n"
TABLE_HEADERS = "Headers: {headers}\n"
TABLE_ROW = "Row {number}: {cells}\n"
TABLE_MORE_ROWS = "... and {count} more rows\n"
NO_TEXT_CONTENT = "No text content found"
CLASSIFICATION_FAILED = "Classification failed: "
NO_TEXT_ERROR = "No text could be extracted from the document"
UNKNOWN_TYPE_ERROR = "Unknown document type: "
FALLBACK_FAILED_ERROR = "All extraction methods failed: "
NO_JSON_ERROR = "No valid JSON found in response"
NO_TABLES = "No tables found"
PROCESSING_ERROR_RULE = "processing_error"
PROCESSING_FAILED_NOTE = "Processing failed: "
SYSTEM_ERROR_RULE = "validation_system_error"
SYSTEM_ERROR_NOTE = "Validation could not be completed due to system error"

# --- fixed values: request texts -------------------------------------------------

ROUTING_SYSTEM_PROMPT = """You are an expert document classifier. Your task is to classify documents into one of three categories:

1. **invoice** - Business invoices, bills for goods/services, purchase orders
   - Keywords: Invoice, Bill, Purchase Order, Vendor, Customer, Line Items, Total, Due Date, Tax
   - Contains: Business addresses, item descriptions, quantities, prices, totals

2. **medical_bill** - Hospital bills, medical service charges, healthcare invoices
   - Keywords: Hospital, Clinic, Patient, Medical, Healthcare, Insurance, Diagnosis, Treatment
   - Contains: Patient information, medical services, insurance details, healthcare provider info

3. **prescription** - Medical prescriptions, medication orders
   - Keywords: Prescription, Doctor, Patient, Medicine, Medication, Dosage, Pharmacy, Dr.
   - Contains: Doctor information, patient details, medication names, dosages, instructions

Classification Guidelines:
- Look for specific keywords and document structure
- Consider the context and purpose of the document
- Invoice: Focus on commercial transactions
- Medical Bill: Focus on healthcare services and charges
- Prescription: Focus on medication orders and instructions

Provide your response as JSON with:
- doc_type: One of "invoice", "medical_bill", or "prescription"
- confidence: Float between 0.0 and 1.0
- reasoning: Brief explanation for your classification

Examples:

Text containing "Invoice #12345, Vendor: ABC Corp, Total: $1,500"
→ {"doc_type": "invoice", "confidence": 0.95, "reasoning": "Contains invoice number, vendor information, and commercial total"}

Text containing "Patient: John Doe, Hospital: City Medical Center, Services: Surgery"
→ {"doc_type": "medical_bill", "confidence": 0.90, "reasoning": "Contains patient information, hospital name, and medical services"}

Text containing "Dr. Smith, Prescription for: Amoxicillin 500mg, Take twice daily"
→ {"doc_type": "prescription", "confidence": 0.92, "reasoning": "Contains doctor name, medication, and dosage instructions"}"""

ROUTING_USER_PROMPT = "Please classify the following document text:\n\n"

EXTRACTION_BASE_PROMPT = """You are an expert document data extractor. Your task is to extract structured information from the provided document text.

IMPORTANT INSTRUCTIONS:
1. Extract information EXACTLY as it appears in the document
2. Do not invent or hallucinate any information
3. If a field is not found, set it to null
4. For confidence scores: use 0.9+ for clearly visible text, 0.7-0.8 for partially visible, 0.5-0.6 for uncertain
5. For dates: preserve the original format when possible
6. For amounts: extract numeric values without currency symbols
7. For line items: extract all items you can identify

"""

EXTRACTION_TYPE_PROMPTS = {
    INVOICE: """
This is an INVOICE document. Focus on extracting:
- Invoice identification (number, date, due date)
- Vendor/supplier information (name, address)
- Customer/buyer information (name, address)
- Line items (description, quantity, unit price, total)
- Financial totals (subtotal, tax, total amount)
- Currency information

Pay special attention to:
- Tables with itemized charges
- Total amounts and calculations
- Payment terms and due dates
""",
    MEDICAL_BILL: """
This is a MEDICAL BILL document. Focus on extracting:
- Patient information (name, ID)
- Healthcare provider information (hospital/clinic name, address)
- Service information (dates, attending doctor)
- Medical services and charges (line items)
- Insurance and payment information
- Financial totals (total amount, paid amount, balance due)

Pay special attention to:
- Patient demographics
- Service dates vs billing dates
- Insurance coverage details
- Medical service descriptions
""",
    PRESCRIPTION: """
This is a PRESCRIPTION document. Focus on extracting:
- Patient information (name, age, address)
- Doctor information (name, license, clinic)
- Prescription details (date, diagnosis)
- Medications (name, dosage, frequency, duration)
- Instructions and notes

Pay special attention to:
- Medication names and dosages
- Frequency and duration instructions
- Doctor credentials and signatures
- Pharmacy information if present
""",
}

EXTRACTION_REQUEST_CLOSING = (
    "Extract the information and return it in the specified JSON format. "
    "Be thorough but accurate."
)

FALLBACK_REQUEST = """
Extract information from this {doc_type} document and return it as valid JSON.

Document Text:
{text}

Return a JSON object with the relevant fields for a {doc_type}. 
Include confidence scores (0.0 to 1.0) for each field.
Use null for missing information.
"""
