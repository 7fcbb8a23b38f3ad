"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(name: Column, content: Column) -> Column:
    return F.concat(F.lit("pdf_"), F.substr(F.md5(F.concat(name, F.lit(":"), F.substr(F.md5(content), F.lit(1), F.lit(16))).cast("binary")), F.lit(1), F.lit(16)))


def policy_id(file_id: Column, document_key: Column) -> Column:
    seed = F.when(document_key == "", file_id).otherwise(F.concat(file_id, F.lit(":"), document_key))
    return F.concat(F.lit("policy_"), F.substr(F.sha2(seed, 256), F.lit(1), F.lit(24)))


def document_key(title: Column) -> Column:
    return F.substr(F.sha2(title, 256), F.lit(1), F.lit(24))


def clause_id(policy: Column, version: Column, sequence_no: Column, raw_text: Column) -> Column:
    seed = F.concat_ws(":", policy, version, sequence_no.cast("string"), F.substr(F.sha2(raw_text, 256), F.lit(1), F.lit(16)))
    return F.concat(F.lit("clause_"), F.substr(F.sha2(seed, 256), F.lit(1), F.lit(32)))


def assertion_id(*parts: Column) -> Column:
    return F.concat(F.lit("assertion_"), F.substr(F.sha2(F.concat_ws("␟", *parts), 256), F.lit(1), F.lit(24)))


def matter_id(run: Column, clause: Column) -> Column:
    return F.concat(F.lit("matter_"), F.substr(F.sha2(F.concat_ws(":", run, clause), 256), F.lit(1), F.lit(24)))


def owner_hash(token: Column) -> Column:
    return F.sha2(token, 256)
