"""Explicit schemas for every landed input (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, B, TS, BIN = (T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(),
                       T.TimestampType(), T.BinaryType())


def f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


USER = T.StructType([f("login", S)])
REF = T.StructType([f("ref", S)])
COORDS = [f("owner", S), f("repo", S), f("pr_number", L)]

# One JSON document per fetched PR record (the /pulls/{n} response) plus its coordinates.
PULL_REQUEST_EXPORT = T.StructType(COORDS + [
    f("title", S), f("body", S), f("base", REF), f("head", REF), f("user", USER),
    f("commits", I), f("additions", I), f("deletions", I), f("changed_files", I)])

FILE_ITEM = T.StructType([f("filename", S), f("status", S), f("additions", I), f("deletions", I),
                          f("patch", S), f("blob_url", S)])
REVIEW_ITEM = T.StructType([f("user", USER), f("state", S), f("body", S), f("submitted_at", S)])
REVIEW_COMMENT_ITEM = T.StructType([f("user", USER), f("body", S), f("path", S), f("line", I),
                                    f("position", I), f("created_at", S)])
ISSUE_COMMENT_ITEM = T.StructType([f("user", USER), f("body", S), f("created_at", S)])


def list_export(item: T.StructType) -> T.StructType:
    """One JSON document per fetched list response: coordinates + the array in API order."""
    return T.StructType(COORDS + [f("items", T.ArrayType(item))])


# Stored settings documents; secrets arrive here and are turned into flags on read.
SETTINGS_EXPORT = T.StructType([
    f("tenant", S), f("githubToken", S), f("aiService", S),
    f("openaiSettings", T.StructType([f("apiKey", S), f("apiEndpoint", S), f("model", S)])),
    f("anthropicSettings", T.StructType([f("apiKey", S), f("model", S)])),
    f("reviewSettings", T.StructType([f("reviewPrompt", S), f("maxTokens", L),
                                      f("ignoreFiles", T.ArrayType(S))])),
])

STREAM_CHUNK = T.StructType([f("request_id", S, False), f("seq", I, False), f("service", S),
                             f("payload", BIN), f("is_last", B)])

PAGE_VISIT = T.StructType([f("tab_id", L), f("page_load_id", L), f("seq", L), f("ts", TS), f("url", S)])

DELTA = T.StructType([f("request_id", S), f("line_no", L), f("content", S), f("done", B)])

DEAD_LETTER = T.StructType([f("request_id", S), f("line_no", L), f("kind", S), f("line", S)])
