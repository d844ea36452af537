"""What is shown of verdicts: small tables that outcomes and error codes are looked up in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outcome to name, sign and tone; an outcome that is not known is shown as not compared.
SHOWN = {
    "match": ("Match", "tick", "match"),
    "needs_review": ("Needs review", "triangle", "review"),
    "mismatch": ("Does not match", "cross", "mismatch"),
    "not_compared": ("Not compared", "dash", "neutral"),
    "present": ("Contains", "carried", "match"),
    "artwork_derived": ("Read from the artwork", "artwork", "artwork"),
    "not_certified": ("Present, not certified", "look", "review"),
}
#: Error codes and what to do about them, in our own words.
SAID = {
    "unreadable_image": "The label can't be read; a clearer picture may help.",
    "no_text_found": "The picture shows no text; a clearer one may help.",
    "unsupported_media_type": "The file is no picture of a kind that is read.",
    "file_too_large": "The file is too large.",
    "submission_too_large": "The files are too large together.",
    "batch_envelope_too_large": "The batch is too large to send at once.",
    "no_label_to_check": "There is no picture of a label to check.",
    "too_many_application_documents": "Several files are applications.",
    "all_photos_unreadable": "None of the pictures can be read.",
    "too_many_photos": "There are more pictures than one label may have.",
    "batch_too_large": "The batch has too many labels.",
    "duplicate_application_document": "Several files of this name are applications.",
    "duplicate_label_stem": "Several files of this name are labels.",
    "unreadable_application_document": "The application can't be read.",
}
UNKNOWN = "The label could not be checked."


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.coalesce(key, F.lit("")))


def shown(outcome: Column) -> Column:
    """struct (label, glyph, tone) of an outcome."""
    parts = ("label", "glyph", "tone")
    return F.struct(*[F.coalesce(_looked_up({k: v[i] for k, v in SHOWN.items()}, outcome), F.lit(SHOWN["not_compared"][i])).alias(n) for i, n in enumerate(parts)])


def said(code: Column, message: Column) -> Column:
    """The sentence of an error code; a message tells which of three limits file_too_large means."""
    large = F.when(message.rlike("(?i)fewer photographs"), "submission_too_large").when(message.rlike("(?i)smaller batches"), "batch_envelope_too_large")
    return F.coalesce(_looked_up(SAID, F.when(code == "file_too_large", F.coalesce(large, code)).otherwise(code)), F.lit(UNKNOWN))


def without_suffix(reason: Column, sentence: str) -> Column:
    """A reason without a sentence that it ends in exactly."""
    return F.when(F.endswith(reason, F.lit(sentence)), F.trim(F.left(reason, F.length(reason) - len(sentence)))).otherwise(reason)
