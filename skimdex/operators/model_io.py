"""Batch requests to, and responses from, an embedding model."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimdex.functions.paths import data_url

# --- fixed values: wire format of the two request protocols ---
INSTRUCTION = "Represent the user's input."
PROTOCOLS = ("chat", "contents")
# --- end of fixed values ---


def _object_or_none(params: str | None) -> dict | None:
    try:
        value = json.loads(params) if params else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def build_embedding_requests(
    items: DataFrame, protocol: str, model: str, params: str | None = None
) -> DataFrame:
    """Add ``request``, the model's JSON body, to items with a ``text`` or an image ``content``.

    Items hold ``text``, or ``file_path`` and ``content``. ``params`` is injected only when it is a
    JSON object. Write the column with ``.write.text`` for offline inference.
    """
    if protocol not in PROTOCOLS:
        protocol = PROTOCOLS[0]
    is_text = "text" in items.columns
    payload = F.col("text") if is_text else data_url(F.col("file_path"), F.col("content"))

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias(kind))

    def message(role: str, content: Column) -> Column:
        return F.to_variant_object(F.struct(F.lit(role).alias("role"), F.array(content).alias("content")))

    if protocol == "chat":
        user = part("text", payload) if is_text else part("image_url", F.struct(payload.alias("url")))
        fields = [
            F.lit(model).alias("model"),
            F.array(
                message("system", part("text", F.lit(INSTRUCTION))),
                message("user", user),
                message("assistant", part("text", F.lit(""))),
            ).alias("messages"),
            F.lit("float").alias("encoding_format"),
            F.lit(True).alias("continue_final_message"),
            F.lit(True).alias("add_special_tokens"),
        ]
    else:
        content = F.array(F.struct(payload.alias("text" if is_text else "image")))
        fields = [F.lit(model).alias("model"), F.struct(content.alias("contents")).alias("input")]
    extra = _object_or_none(params)
    if extra is not None:
        fields.append(F.parse_json(F.lit(json.dumps(extra))).alias("parameters"))
    return items.withColumn("request", F.to_json(F.struct(*fields)))


def parse_embedding_responses(responses: DataFrame) -> DataFrame:
    """Add ``vector`` and ``error`` from a ``response`` JSON string.

    Accepted: ``{"data": [{"embedding": [..]}]}``, an array of such objects (in both the embedding
    may be nested once), ``[[..]]``, ``[..]`` and ``{"output": {"embeddings": [{"embedding": [..]}]}}``.
    """
    doc = F.col("_doc")
    at = lambda path: F.try_variant_get(doc, path, "variant")
    has_data = at("$.data").isNotNull()
    wrapped = F.when(has_data, at("$.data[0].embedding")).otherwise(
        at("$.output.embeddings[0].embedding")
    )
    first = F.schema_of_variant(at("$[0]"))
    listed = (
        F.when(F.startswith(first, F.lit("OBJECT")), at("$[0].embedding"))
        .when(F.startswith(first, F.lit("ARRAY")), at("$[0]"))
        .otherwise(doc)
    )
    is_array = F.startswith(F.schema_of_variant(doc), F.lit("ARRAY"))
    found = F.when(is_array, listed).otherwise(wrapped)
    # the first two shapes may wrap the embedding once more: [[..]]
    may_nest = (~is_array & has_data) | (is_array & F.startswith(first, F.lit("OBJECT")))
    inner = F.try_variant_get(F.col("_found"), "$[0]", "variant")
    nested = F.startswith(F.schema_of_variant(inner), F.lit("ARRAY"))
    numbers = F.expr("try_variant_get(_emb, '$', 'array<variant>')")
    numeric = F.forall(
        F.col("_items"),
        lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
    )
    vector = F.transform("_items", lambda v: F.try_variant_get(v, "$", "float"))
    return (
        responses.withColumn("_doc", F.try_parse_json("response"))
        .withColumn("_nest", F.coalesce(may_nest, F.lit(False)))
        .withColumn("_found", found)
        .withColumn("_emb", F.when(F.col("_nest") & nested, inner).otherwise(F.col("_found")))
        .withColumn("_items", numbers)
        .withColumn(
            "error",
            F.when(F.col("_doc").isNull(), "not JSON")
            .when(F.col("_items").isNull(), "no embedding array")
            .when(F.size("_items") == 0, "empty embedding")
            .when(~numeric, "embedding entry is not a number"),
        )
        .withColumn("vector", F.when(F.col("error").isNull(), vector))
        .select(*responses.columns, "vector", "error")
    )
