"""Request functions: F19 F20 F21 F22 F23 (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import col, js_length, or_default

_D = C.INSTALL_DEFAULTS
JSON_OPTS = {"ignoreNullFields": "false"}


def resolve_endpoint(service="ai_service", openai_endpoint="openai_endpoint") -> Column:
    """F20 (endpoint): dialect A configured-or-default; dialect B fixed."""
    s = col(service)
    return (F.when(s == "openai", or_default(openai_endpoint, _D["openai"]["apiEndpoint"]))
            .when(s == "anthropic", F.lit(C.ANTHROPIC_ENDPOINT)))


def resolve_model(service="ai_service", openai_model="openai_model",
                  anthropic_model="anthropic_model") -> Column:
    """F20 (model): dialect A falls back to the default; dialect B is used as stored."""
    s = col(service)
    return (F.when(s == "openai", or_default(openai_model, _D["openai"]["model"]))
            .when(s == "anthropic", col(anthropic_model)))


def request_body_struct(service, model, prompt, max_tokens) -> Column:
    """F19 as a struct: the two request dialects, field order as sent."""
    s, m, p, mt = col(service), col(model), col(prompt), col(max_tokens)
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    a = F.struct(m.alias("model"),
                 F.array(msg("system", F.lit(C.SYSTEM_PROMPT)), msg("user", p)).alias("messages"),
                 mt.alias("max_tokens"), F.lit(C.OPENAI_TEMPERATURE).alias("temperature"),
                 F.lit(True).alias("stream"))
    b = F.struct(m.alias("model"), F.array(msg("user", p)).alias("messages"),
                 mt.alias("max_tokens"), F.lit(C.SYSTEM_PROMPT).alias("system"),
                 F.lit(True).alias("stream"))
    return F.when(s == "openai", F.to_json(a, JSON_OPTS)).when(s == "anthropic", F.to_json(b, JSON_OPTS))


def build_request_body(service, model, prompt, max_tokens) -> Column:
    """the JSON request body text, or null for an unsupported service."""
    return request_body_struct(service, model, prompt, max_tokens)


def header_names(service) -> Column:
    s = col(service)
    return (F.when(s == "openai", F.array(*[F.lit(h) for h in C.OPENAI_HEADER_NAMES]))
            .when(s == "anthropic", F.array(*[F.lit(h) for h in C.ANTHROPIC_HEADER_NAMES])))


def message_audit(service, prompt) -> Column:
    """F21 messages part: role and content length per message, never the content."""
    s, p = col(service), col(prompt)
    sys_len = js_length(F.lit(C.SYSTEM_PROMPT))
    item = lambda role, n: F.struct(F.lit(role).alias("role"), n.alias("content_length"))
    return (F.when(s == "openai", F.array(item("system", sys_len), item("user", js_length(p))))
            .when(s == "anthropic", F.array(item("user", js_length(p)))))


def uses_default_endpoint(service="ai_service", openai_endpoint="openai_endpoint") -> Column:
    """dialect A compares the stored endpoint with the default, else ``N/A``."""
    return F.when(col(service) == "openai",
                  F.coalesce(col(openai_endpoint) == _D["openai"]["apiEndpoint"], F.lit(False))
                  .cast("string")).otherwise(F.lit(C.NOT_AVAILABLE_TEXT))


def uses_default_model(service="ai_service", openai_model="openai_model",
                       anthropic_model="anthropic_model") -> Column:
    """stored model equals the service's default model."""
    return F.coalesce(F.when(col(service) == "openai", col(openai_model) == _D["openai"]["model"])
                      .otherwise(col(anthropic_model) == _D["anthropic"]["model"]), F.lit(False))


_API_PATHS = {
    "pull": "/pulls/{n}",
    "files": "/pulls/{n}/files",
    "reviews": "/pulls/{n}/reviews",
    "review_comments": "/pulls/{n}/comments",
    "issue_comments": "/issues/{n}/comments",
    "submit_review": "/pulls/{n}/reviews",
}


def api_endpoint(kind: str, owner="owner", repo="repo", number="pr_number") -> Column:
    """code-hosting API resource path for one PR."""
    head, tail = _API_PATHS[kind].split("{n}")
    return F.concat(F.lit("/repos/"), col(owner), F.lit("/"), col(repo), F.lit(head),
                    col(number).cast("string"), F.lit(tail))
