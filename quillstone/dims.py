"""Constant dimensions: document types with their keywords, and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. The order of the types decides ties between equal scores.
DOC_TYPES: list[tuple[str, str, list[str]]] = [
    ("Invoice", "🧾", [
        "invoice", "bill", "total amount", "amount due", "payment", "subtotal", "tax", "gst",
        "invoice no", "invoice number", "due date", "bill to", "sold to", "item", "qty", "quantity",
    ]),
    ("Receipt", "🛒", [
        "receipt", "thank you for your purchase", "cash", "change", "cashier", "store", "shop",
        "purchased", "transaction", "order", "paid",
    ]),
    ("Certificate", "🏆", [
        "certificate", "certify", "awarded", "achievement", "completion", "hereby", "authorized",
        "accredited", "diploma", "degree", "congratulations",
    ]),
    ("Identity Document", "🪪", [
        "date of birth", "dob", "gender", "nationality", "passport", "id card", "aadhar",
        "driving license", "pan card", "voter id", "expiry", "address",
    ]),
    ("Medical Report", "🏥", [
        "diagnosis", "patient", "doctor", "hospital", "prescription", "medicine", "dosage",
        "symptoms", "treatment", "laboratory", "test results", "blood", "report", "clinical",
        "physician",
    ]),
    ("Legal Document", "⚖️", [
        "agreement", "contract", "terms and conditions", "hereby agrees", "parties", "clause",
        "pursuant", "jurisdiction", "litigation", "plaintiff", "defendant", "whereas",
        "witnesseth", "notary", "affidavit", "deed",
    ]),
    ("Academic", "🎓", [
        "student", "marks", "grade", "examination", "school", "college", "university", "subject",
        "semester", "result", "pass", "fail", "cgpa", "gpa", "roll number",
    ]),
    ("Business Letter", "📄", [
        "dear", "sincerely", "regards", "yours faithfully", "to whom it may concern", "subject:",
        "reference:", "kindly", "enclosed", "attached",
    ]),
    ("Bank Statement", "🏦", [
        "account number", "ifsc", "balance", "debit", "credit", "transaction", "statement",
        "bank", "withdraw", "deposit", "account holder", "branch",
    ]),
]
NO_TYPE_ICON = "📃"
BLANK_TYPE = "Unknown"
UNMATCHED_TYPE = "General Document"
SATURATING_HITS = 3

# Translation targets, name to code.
LANGUAGES: list[tuple[str, str]] = [
    ("Hindi", "hi"), ("French", "fr"), ("Spanish", "es"), ("German", "de"), ("Arabic", "ar"),
    ("Chinese (Simplified)", "zh-CN"), ("Japanese", "ja"), ("Korean", "ko"),
    ("Portuguese", "pt"), ("Russian", "ru"), ("Italian", "it"), ("Tamil", "ta"),
    ("Telugu", "te"), ("Marathi", "mr"), ("Bengali", "bn"), ("Gujarati", "gu"), ("Urdu", "ur"),
    ("English", "en"),
]

# Recognition-language shorthands that also need the Latin script.
OCR_LANGUAGE_SHORTHAND: dict[str, str] = {
    "hin": "hin+eng", "guj": "guj+eng", "tel": "tel+eng", "tam": "tam+eng",
}


def doc_types(spark: SparkSession) -> DataFrame:
    """``ord, type, icon``: nine rows, safe to broadcast."""
    rows = [(i, name, icon) for i, (name, icon, _) in enumerate(DOC_TYPES)]
    return spark.createDataFrame(rows, "ord int, type string, icon string")


def languages(spark: SparkSession) -> DataFrame:
    """``name, code``: eighteen rows, safe to broadcast."""
    return spark.createDataFrame(LANGUAGES, "name string, code string")
