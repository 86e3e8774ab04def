"""Key-information operators: the whole struct, its tidy form, analysis, autofill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyinfo as k
from ..functions.text import effective_text, or_default
from .classification import classify
from .lookup import find_documents

LIST_FIELDS = (
    "dates", "emails", "phone_numbers", "amounts", "pan_numbers", "aadhaar_numbers",
    "percentages", "urls",
)
FORM_FIELDS = ("name", "dob", "address", "gender")
NOT_AVAILABLE = "Not Available"


def extract_key_info(docs: DataFrame, text: str = "text", out: str = "key_info") -> DataFrame:
    """Add the key-information struct: eight nullable lists and ``form_fill``.

    Values used more than once (lower-cased text, dates, date of birth, lines)
    are staged as columns so that each is computed once. No shuffle.
    """
    t: Column = F.col(text)
    staged = docs.withColumns({
        "_low": F.lower(t), "_dates": k.extract_dates(t), "_listed": k.extract_phones(t),
    })
    low = F.col("_low")
    staged = staged.withColumns({
        "_dob": k.form_dob(t, F.col("_dates"), low),
        "_label": k.labelled_name(t, low),
        "_mobile": k.labelled_mobile(t, low),
    })
    use_lines = (F.col("_label") == "") & (F.col("_dob") != "")
    staged = staged.withColumn("_lines", F.when(use_lines, F.split(t, "\n", -1)))
    above = k.name_above(F.col("_lines"), F.col("_dob"))
    info = F.struct(
        F.col("_dates").alias("dates"),
        k.extract_emails(t).alias("emails"),
        k.with_labelled_mobile(F.col("_listed"), F.col("_mobile")).alias("phone_numbers"),
        k.extract_amounts(t).alias("amounts"),
        k.extract_pan(t).alias("pan_numbers"),
        k.extract_aadhaar(t).alias("aadhaar_numbers"),
        k.extract_percentages(t).alias("percentages"),
        k.extract_urls(t, low=low).alias("urls"),
        F.struct(
            F.when(use_lines, above).otherwise(F.col("_label")).alias("name"),
            F.col("_dob").alias("dob"),
            k.form_address(t).alias("address"),
            k.form_gender(t, low).alias("gender"),
        ).alias("form_fill"),
    )
    return staged.withColumn(out, info).drop(
        "_low", "_dates", "_listed", "_dob", "_label", "_mobile", "_lines")


def key_info_long(df: DataFrame, keys: list[str], info: str = "key_info") -> DataFrame:
    """Tidy form ``keys, kind, ord, value``: every list value and every filled form field."""
    def listed(field: str) -> Column:
        values = F.coalesce(F.col(f"{info}.{field}"), F.array().cast("array<string>"))
        return F.transform(values, lambda v, i: _entry(field, i, v))

    def filled(field: str) -> Column:
        value = F.col(f"{info}.form_fill.{field}")
        return F.filter(F.array(_entry(field, F.lit(0), value)), lambda e: e["value"] != "")

    entries = [listed(f) for f in LIST_FIELDS] + [filled(f) for f in FORM_FIELDS]
    return df.select(*keys, F.explode(F.concat(*entries)).alias("_e")).select(*keys, "_e.*")


def _entry(kind: str, ordinal: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), ordinal.alias("ord"), value.alias("value"))


def analyze(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Look up requested documents by id and owner, then classify and extract.

    Requests that find nothing keep status 404 and a NULL analysis. A document
    is analysed once, however often it is requested.
    """
    chosen = effective_text(F.col("corrected_text"), F.col("raw_text"))

    def analysed(found: DataFrame) -> DataFrame:
        return extract_key_info(classify(found, "_text"), "_text").drop("_text")

    texts = docs.select("doc_id", "user_id", "filename", chosen.alias("_text"))
    return find_documents(requests, texts, analysed).select(
        "doc_id", "user_id", "status", "filename", "classification", "key_info")


def autofill_form(df: DataFrame, info: str = "key_info") -> DataFrame:
    """Flatten key information to six form values; ``filled`` when any is really there."""
    first_email = F.get(F.col(f"{info}.emails"), F.lit(0))
    first_phone = F.get(F.col(f"{info}.phone_numbers"), F.lit(0))
    form = {f: F.col(f"{info}.form_fill.{f}") for f in FORM_FIELDS}
    filled = first_email.isNotNull() | first_phone.isNotNull()
    for value in form.values():
        filled = filled | (F.coalesce(value, F.lit("")) != "")
    values = {f"fill_{f}": or_default(v, NOT_AVAILABLE) for f, v in form.items()}
    return df.withColumns({
        **values,
        "fill_email": F.coalesce(first_email, F.lit(NOT_AVAILABLE)),
        "fill_phone": F.coalesce(first_phone, F.lit(NOT_AVAILABLE)),
        "filled": filled,
    })


def autofill_json(df: DataFrame) -> DataFrame:
    """The six form values of :func:`autofill_form` as one JSON object."""
    order = ("name", "dob", "gender", "phone", "email", "address")
    body = F.struct(*[F.col(f"fill_{f}").alias(f) for f in order])
    return df.withColumn("form_json", F.to_json(body))
