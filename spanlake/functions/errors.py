"""Error texts: kind, severity, advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an error text and its kind; the first kind that fits counts.
KINDS = (
    ("timeout", ("timeout", "timed out")),
    ("connection_error", ("connection", "refused", "unavailable")),
    ("data_error", ("key", "index", "attribute")),
    ("context_loss", ("context", "propagat")),
)

ADVICE = {
    "timeout": ("Look at the called service's response times", "Review the time limit", "Retry with growing pauses"),
    "connection_error": ("See that the called service runs and can be reached", "Check names and routes", "Fail fast after repeated refusals"),
    "data_error": ("Validate the input", "Guard against missing keys", "Agree on the data between the services"),
    "context_loss": ("Hand the context over to pools", "Keep the context in new tasks", "Check the context at boundaries"),
}
OTHER_ADVICE = ("Read the error and its stack", "Look at recent changes")


def classify_error(error: Column) -> Column:
    """the kind of an error text, `error_trace` if none fits."""
    text, out = F.lower(error), F.lit("error_trace")
    for kind, words in reversed(KINDS):
        fits = text.contains(words[0])
        for w in words[1:]:
            fits = fits | text.contains(w)
        out = F.when(fits, kind).otherwise(out)
    return out


def assess_severity(error: Column, in_degree: Column) -> Column:
    """critical at a root, high for connections and timeouts, else medium."""
    return F.when(in_degree == 0, "critical").when(classify_error(error).isin("connection_error", "timeout"), "high").otherwise("medium")


def recommendations_for(kind: Column) -> Column:
    """what to do about an error of this kind."""
    out = F.array(*map(F.lit, OTHER_ADVICE))
    for k, texts in ADVICE.items():
        out = F.when(kind == k, F.array(*map(F.lit, texts))).otherwise(out)
    return out
