"""Settings operators: M1-M5, J3, P11, P12, X3.

A *flat* settings table has one row per tenant:
``tenant, has_token, has_openai_key, has_anthropic_key, ai_service,
openai_endpoint, openai_model, anthropic_model, review_prompt, max_tokens,
ignore_files``. Secrets never appear: sources turn them into flags.

A *stored* settings table keeps the layered form for install/update
merges: ``tenant, top MAP, openai MAP, anthropic MAP, review MAP`` with
string values (``maxTokens`` as text, ``ignoreFiles`` newline-joined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import constants as C
from reviewlake.functions.text import (clamp_max_tokens, mask_secret, or_default,
                                       parse_ignore_list, parse_int_prefix)

GROUPS = ("top", "openai", "anthropic", "review")
SECRET_KEYS = {"top": "githubToken", "openai": "apiKey", "anthropic": "apiKey"}


# ------------------------------------------------------------------ M4 / M3 / M5
def normalize_settings(form: DataFrame) -> DataFrame:
    """M4: save-time normalisation of a settings form row.

    Endpoint and OpenAI model fall back to the form defaults; the Anthropic
    model has no fallback; the token cap is parsed as a leading integer and
    bounded; the ignore list is split, trimmed and blank lines dropped.
    """
    d = C.FORM_DEFAULTS
    return form.select(
        "tenant",
        F.coalesce(F.col("has_token"), F.lit(False)).alias("has_token"),
        F.coalesce(F.col("has_openai_key"), F.lit(False)).alias("has_openai_key"),
        F.coalesce(F.col("has_anthropic_key"), F.lit(False)).alias("has_anthropic_key"),
        F.coalesce(F.col("ai_service"), F.lit("")).alias("ai_service"),
        or_default("openai_endpoint", d["openai"]["apiEndpoint"]).alias("openai_endpoint"),
        or_default("openai_model", d["openai"]["model"]).alias("openai_model"),
        F.coalesce(F.col("anthropic_model"), F.lit("")).alias("anthropic_model"),
        F.coalesce(F.col("review_prompt"), F.lit("")).alias("review_prompt"),
        clamp_max_tokens(parse_int_prefix(F.col("max_tokens").cast("string"))).alias("max_tokens"),
        parse_ignore_list("ignore_files").alias("ignore_files"),
    )


def settings_with_fallback(flat: DataFrame) -> DataFrame:
    """M3: read-time fallback as the settings form shows it."""
    d = C.FORM_DEFAULTS
    return flat.select(
        "tenant", "has_token", "has_openai_key", "has_anthropic_key",
        or_default("ai_service", "openai").alias("ai_service"),
        F.coalesce(F.col("openai_endpoint"), F.lit("")).alias("openai_endpoint"),
        F.coalesce(F.col("openai_model"), F.lit("")).alias("openai_model"),
        or_default("anthropic_model", d["anthropic"]["model"]).alias("anthropic_model"),
        or_default("review_prompt", d["reviewPrompt"]).alias("review_prompt"),
        F.coalesce(F.nullif(F.col("max_tokens"), F.lit(0)), F.lit(d["maxTokens"])).alias("max_tokens"),
        F.coalesce(F.col("ignore_files"), F.array().cast("array<string>")).alias("ignore_files"),
    )


def reset_review_settings(flat: DataFrame) -> DataFrame:
    """M5: prompt, token cap and ignore list back to the form defaults; the rest kept."""
    d = C.FORM_DEFAULTS
    return flat.withColumns({
        "review_prompt": F.lit(d["reviewPrompt"]),
        "max_tokens": F.lit(d["maxTokens"]),
        "ignore_files": F.array().cast("array<string>"),
    })


def fixture_settings(settings_raw: DataFrame) -> DataFrame:
    """Flat settings from the driver's ``settings_raw`` rows (one model per tenant).

    The single ``model`` goes to the tenant's chosen service; the prompt is
    the installed default; one ``has_key`` flag stands for both keys.
    """
    form = settings_raw.select(
        "tenant", "has_token",
        F.col("has_key").alias("has_openai_key"), F.col("has_key").alias("has_anthropic_key"),
        "ai_service",
        F.lit(None).cast("string").alias("openai_endpoint"),
        F.when(F.col("ai_service") == "openai", F.col("model")).alias("openai_model"),
        F.when(F.col("ai_service") == "anthropic", F.col("model")).alias("anthropic_model"),
        F.lit(C.INSTALL_DEFAULTS["review"]["reviewPrompt"]).alias("review_prompt"),
        "max_tokens", "ignore_files")
    return normalize_settings(form)


# ------------------------------------------------------------------ J3 / P11 / P12
def resolve_run_settings(runs: DataFrame, settings: DataFrame) -> DataFrame:
    """A run's override beats the stored service and prompt only.

    Settings are one row per tenant and carry free-text prompts: the join has no
    hint, Spark picks broadcast or shuffle from their measured bytes.
    """
    s = (settings.withColumnRenamed("tenant", "_st")
         .withColumnRenamed("ai_service", "_svc")
         .withColumnRenamed("review_prompt", "_prompt"))
    j = runs.join(s, runs["tenant"] == s["_st"], "left")
    return (j.withColumn("ai_service", or_default("temp_ai_service", F.col("_svc")))
            .withColumn("review_prompt", or_default("temp_review_prompt", F.col("_prompt")))
            .drop("_st", "_svc", "_prompt"))


def eligibility_error() -> Column:
    """P11, first checks: forge token, then the chosen service's key."""
    svc = F.col("ai_service")
    return (F.when(~F.coalesce(F.col("has_token"), F.lit(False)), F.lit("NO_FORGE_TOKEN"))
            .when((svc == "openai") & ~F.coalesce(F.col("has_openai_key"), F.lit(False)),
                  F.lit("NO_OPENAI_KEY"))
            .when((svc == "anthropic") & ~F.coalesce(F.col("has_anthropic_key"), F.lit(False)),
                  F.lit("NO_ANTHROPIC_KEY")))


def flag_review_eligibility(runs: DataFrame, file_count_col: str | None = None) -> DataFrame:
    """Ordered checks into ``error_code`` / ``error_message``; rows are kept."""
    err = eligibility_error()
    if file_count_col is not None:
        err = F.coalesce(err, F.when(F.coalesce(F.col(file_count_col), F.lit(0)) == 0,
                                     F.lit("NO_FILES")))
    return runs.withColumn("error_code", err).withColumn("error_message", error_message("error_code"))


def error_message(code: Column | str) -> Column:
    items = []
    for k, v in (C.ERRORS | C.OWN_ERRORS).items():
        items += [F.lit(k), F.lit(v)]
    c = F.col(code) if isinstance(code, str) else code
    return F.element_at(F.create_map(*items), c)


def flag_settings_quality(df: DataFrame, service_col: str = "ai_service",
                          key_col: str = "api_key") -> DataFrame:
    """Key format check per chosen service; the raw key is dropped here."""
    svc, key = F.col(service_col), F.coalesce(F.col(key_col), F.lit(""))
    ok = (F.when(svc == "anthropic", key.startswith("sk-") & (F.length(key) >= 20))
          .when(svc == "openai", (F.length(key) > 0) & (F.length(key) >= 20))
          .otherwise(F.lit(False)))
    code = (F.when(svc == "anthropic", F.when(~ok, F.lit("INVALID_ANTHROPIC_KEY")))
            .when(svc == "openai", F.when(~ok, F.lit("INVALID_OPENAI_KEY")))
            .otherwise(F.lit("UNSUPPORTED_SERVICE")))
    others = [c for c in df.columns if c != key_col]
    present, length = mask_secret(key)
    return df.select(*others, present.alias("has_key"), length.alias("key_length"),
                     ok.alias("key_ok"), code.alias("key_error"))


# ------------------------------------------------------------------ M1 / M2
def _defaults_maps() -> dict[str, Column]:
    d = C.INSTALL_DEFAULTS

    def m(items: dict) -> Column:
        kv = []
        for k, v in items.items():
            kv += [F.lit(k), F.lit(v if isinstance(v, str) else
                                   "\n".join(v) if isinstance(v, list) else str(v))]
        return F.create_map(*kv)

    return {"top": m({"aiService": d["aiService"]}), "openai": m(d["openai"]),
            "anthropic": m(d["anthropic"]), "review": m(d["review"])}


def _overlay(base: Column, over: Column) -> Column:
    """Keys present in ``over`` win, even when empty; other keys of both kept."""
    over = F.coalesce(over, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(base, over,
                          lambda k, x, y: F.when(F.map_contains_key(over, k), y).otherwise(x))


def merge_settings(existing: DataFrame, reason: Column | str = "reason") -> DataFrame:
    """M1 + M2: install / update merge of stored settings with the defaults.

    ``install`` writes the defaults over their own top-level groups (other
    stored keys survive); ``update`` layers existing values over defaults
    per key inside each group, then keeps non-empty stored secrets;
    browser / shared-module updates leave the row untouched.
    """
    r = F.col(reason) if isinstance(reason, str) else reason
    d = _defaults_maps()
    out = {}
    for g in GROUPS:
        cur = F.coalesce(F.col(g), F.create_map().cast("map<string,string>"))
        install = d[g] if g != "top" else _overlay(cur, d["top"])
        update = _overlay(d[g], cur)
        if g in SECRET_KEYS:
            key = SECRET_KEYS[g]
            kept = F.nullif(F.try_element_at(cur, F.lit(key)), F.lit(""))
            update = F.when(kept.isNotNull(),
                            F.map_concat(F.map_filter(update, lambda k, v: k != F.lit(key)),
                                         F.create_map(F.lit(key), kept))).otherwise(update)
        out[g] = (F.when(r == "install", install).when(r == "update", update).otherwise(F.col(g)))
    return existing.withColumns(out)


def flatten_settings(stored: DataFrame) -> DataFrame:
    """Stored layered maps to the flat settings table (secret refs become flags)."""
    def get(g: str, k: str) -> Column:
        return F.try_element_at(F.col(g), F.lit(k))

    return stored.select(
        "tenant",
        F.coalesce(F.length(get("top", "githubToken")) > 0, F.lit(False)).alias("has_token"),
        F.coalesce(F.length(get("openai", "apiKey")) > 0, F.lit(False)).alias("has_openai_key"),
        F.coalesce(F.length(get("anthropic", "apiKey")) > 0, F.lit(False)).alias("has_anthropic_key"),
        get("top", "aiService").alias("ai_service"),
        get("openai", "apiEndpoint").alias("openai_endpoint"),
        get("openai", "model").alias("openai_model"),
        get("anthropic", "model").alias("anthropic_model"),
        get("review", "reviewPrompt").alias("review_prompt"),
        parse_int_prefix(get("review", "maxTokens")).try_cast("int").alias("max_tokens"),
        parse_ignore_list(get("review", "ignoreFiles")).alias("ignore_files"),
    )
