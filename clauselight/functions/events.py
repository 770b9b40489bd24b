"""Usage events built from rows that say what happened.

Each builder projects a DataFrame to the event schema. The input carries the
columns named in the builder; ``timestamp`` is taken from the input when it is
there and is the time of the query otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselight.schemas import SYSTEM_DOCUMENT, USAGE_ANALYTICS

DEFAULTS = {
    "file_size": 0,
    "file_type": "unknown",
    "processing_time": 0.0,
    "simplification_level": "standard",
    "confidence_score": 0.0,
}


def build(df: DataFrame, action: Column | str, **values: Column) -> DataFrame:
    """Project to the event schema; columns not given are NULL."""
    values = dict(values)
    values["action"] = F.lit(action) if isinstance(action, str) else action
    values.setdefault("document_id", _given(df, "document_id"))
    values.setdefault("user_id", _given(df, "user_id"))
    values.setdefault("metadata", F.lit("{}"))
    if "timestamp" not in values:
        values["timestamp"] = (
            F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()
        )
    out = []
    for field in USAGE_ANALYTICS.fields:
        value = values.get(field.name, F.lit(None))
        # Event times keep the caller's timestamp type.
        out.append((value if field.name == "timestamp" else value.cast(field.dataType)).alias(field.name))
    return df.select(*out)


def _given(df: DataFrame, name: str) -> Column:
    """A column of the input, its default where it is missing or NULL."""
    default = F.lit(DEFAULTS.get(name))
    return F.coalesce(F.col(name), default) if name in df.columns else default


def _json(**values: Column) -> Column:
    pairs = [value.alias(name) for name, value in values.items()]
    return F.to_json(F.struct(*pairs), {"ignoreNullFields": "false"})


def uploads(df: DataFrame) -> DataFrame:
    size, kind = _given(df, "file_size").cast("bigint"), _given(df, "file_type")
    return build(df, "document_upload", metadata=_json(file_size=size, file_type=kind), file_size=size)


def processing(df: DataFrame) -> DataFrame:
    level, score = _given(df, "simplification_level"), _given(df, "confidence_score").cast("double")
    return build(
        df,
        "document_processing",
        metadata=_json(simplification_level=level, confidence_score=score),
        processing_time=_given(df, "processing_time"),
        simplification_level=level,
        confidence_score=score,
    )


def views(df: DataFrame) -> DataFrame:
    duration = _given(df, "view_duration").cast("double")
    return build(df, "document_view", metadata=_json(view_duration=duration))


def deletions(df: DataFrame) -> DataFrame:
    return build(df, "document_deletion")


def feedback(df: DataFrame) -> DataFrame:
    rating = _given(df, "rating").cast("bigint")
    return build(
        df, "user_feedback", metadata=_json(rating=rating), user_feedback=F.col("feedback")
    )


def _account(df: DataFrame, action: str, metadata: Column) -> DataFrame:
    return build(df, action, document_id=F.lit(SYSTEM_DOCUMENT), metadata=metadata)


def registrations(df: DataFrame) -> DataFrame:
    return _account(df, "user_registration", _json(email=F.col("email")))


def logins(df: DataFrame) -> DataFrame:
    return _account(df, "user_login", _json(email=F.col("email")))


def logouts(df: DataFrame) -> DataFrame:
    return _account(df, "user_logout", F.lit("{}"))


def questions(df: DataFrame) -> DataFrame:
    """Question events never name a user."""
    return build(
        df,
        "document_qa",
        user_id=F.lit(None),
        metadata=_json(question=F.col("question")),
        confidence_score=F.col("confidence_score"),
    )


def track(df: DataFrame) -> DataFrame:
    """Events whose action, metadata and feedback the caller supplies."""
    return build(
        df,
        F.col("action"),
        metadata=F.coalesce(_given(df, "metadata"), F.lit("{}")),
        user_feedback=_given(df, "user_feedback"),
    )


def user_id(email: Column) -> Column:
    """Account name of an e-mail address."""
    return F.concat(F.lit("user_"), F.translate(email, "@.", "__"))
